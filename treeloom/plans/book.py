"""Knowledge books and step chains: registries of functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import validate as V
from ..operators.cut import written
from . import builds as B
from . import openapi, render


@dataclass(frozen=True)
class Processor:
    """`run` takes builds and gives a section per build: (build, page)."""

    id: str
    title: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A step of a plan; takes tables by name and returns those that it adds or replaces."""

    id: str
    title: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def run_steps(steps: list[Step], tables: dict[str, DataFrame], phase: str | None = None, always: tuple = ("scaffold",)) -> dict[str, DataFrame]:
    """Steps in order; with a phase only those whose id begins with it, and the ones that always run."""
    state = dict(tables)
    for s in steps:
        if phase is None or s.id.startswith(phase) or s.id in always:
            state |= s.run(state)
    return state


def _overview(b: DataFrame) -> DataFrame:
    f = B.facts(b)
    return f.select("build", F.format_string("%s %s: %d flows, %d attribute sets, %d error codes, %d actions\nFlows: %s", "domain", "version", "n_flows", "n_attribute_sets", "n_errors", "n_actions", F.array_join("flows", ", ")).alias("page"))


def _flows(b: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), F.col("id"), F.lit(" ("), F.col("usecase"), F.lit("): "), F.coalesce("description", F.lit("")))
    return B.flows(b).groupBy("build").agg(render.ordered_lines(line, "ord").alias("page"))


PROCESSORS = [Processor("overview", "Overview", _overview), Processor("flows", "Flows", _flows), Processor("errors", "Error codes", lambda b: render.error_page(B.error_codes(b)))]


def book(b: DataFrame, processors: list[Processor] | None = None) -> DataFrame:
    """build, page: the sections of all processors in order."""
    parts = None
    for i, p in enumerate(PROCESSORS if processors is None else processors):
        rows = p.run(b).select("build", F.lit(i).alias("ord"), F.concat(F.lit(f"# {p.title}\n\n"), F.col("page")).alias("line"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("build").agg(render.ordered_lines(F.col("line"), "ord", "\n\n").alias("page"))


def payloads(b: DataFrame, defaults: bool = True) -> DataFrame:
    return flow_payloads(B.flows(b), defaults)


def flow_payloads(f: DataFrame, defaults: bool = True) -> DataFrame:
    """Example payloads of steps (with default payloads on request) and recorded ones: build, usecase, flow_id, action, payload, ord.

    `ord` is an ARRAY<BIGINT>: position of the flow, then steps before recorded payloads, then step or position, then
    the default payload before the examples. Such labels compare number by number.
    """
    own = B.read_configs(f.select("build", "usecase", F.col("id").alias("flow_id"), "ord", "config"))
    none = F.array().cast("array<string>")
    listed = lambda s: F.coalesce(s["examples"]["payload"], none)
    shown = F.transform(F.coalesce("read.steps", F.array()), lambda s, i: F.struct(F.lit(0).alias("recorded"), i.alias("i"), s["api"].alias("action"), (F.concat(F.array(s["mock"]["defaultPayload"]), listed(s)) if defaults else listed(s)).alias("payloads")))
    recorded = F.transform(F.coalesce("read.transaction_history", F.array()), lambda h, i: F.struct(F.lit(1).alias("recorded"), i.alias("i"), h["action"].alias("action"), F.array(h["payload"]).alias("payloads")))
    rows = own.select("build", "usecase", "flow_id", "ord", F.inline(F.concat(shown, recorded))).where("coalesce(action, '') <> ''")
    rows = rows.select("build", "usecase", "flow_id", "action", "ord", "recorded", "i", F.posexplode("payloads").alias("k", "payload")).where("payload is not null")
    k = F.col("k") if defaults else F.col("k") + 1 - F.col("recorded")
    return rows.select("build", "usecase", "flow_id", "action", "payload", F.array(*[x.cast("long") for x in (F.col("ord"), F.col("recorded"), F.col("i"), k)]).alias("ord"))


def observe(b: DataFrame, defaults: bool = True) -> DataFrame:
    return observe_flows(B.flows(b), defaults)


def _number(label: Column) -> Column:
    """A label of payloads as one number, in the same order: its first part is any, the second 0 or 1, the others are positions in arrays."""
    rest = F.get(label, F.lit(1)) * (1 << 62) + F.get(label, F.lit(2)) * (1 << 32) + F.get(label, F.lit(3))
    return F.get(label, F.lit(0)).cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + rest


def observe_flows(f: DataFrame, defaults: bool = True, count_flows: bool = True) -> DataFrame:
    """Profiles of all payload paths by use case and action; the path begins with the action.

    What is seen first is so by flow, step, payload and place in the payload: the payload's label with the node's
    positions in its arrays. Equal payloads are walked once, with the first one's label; n_flows is left out on request, as
    it takes a row per flow and path.
    """
    ids, own = ["build", "usecase", "action"], ["payload"] * count_flows
    p = flow_payloads(f, defaults)
    once = p.groupBy(*ids, "payload").agg(F.min(_number(F.col("ord"))).alias("ord"), F.count(F.lit(1)).alias("n")).withColumn("json", F.col("payload"))
    nodes = P.observations(once, [*ids, *own, "ord", "n"], "json")
    nodes = written(nodes.withColumns({"path_key": F.concat_ws(".", F.array("action"), F.col("path")), "ord": F.struct("ord", "place")}).drop("place"), "nodes")
    keys = [*ids, "path_key"]
    found = P.leaf_profile(nodes, keys, "value", None, "ord", "kind", "in_array", times="n")
    if not count_flows:
        return found
    same = lambda a, b, names: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names])
    paths = nodes.select(*keys, "payload").distinct()
    flows = p.select(*ids, "payload", "flow_id").distinct().alias("f").join(paths.alias("p"), same("f", "p", [*ids, "payload"])).select(*[f"p.{k}" for k in keys], "f.flow_id")
    flows = flows.groupBy(*keys).agg(F.count_distinct("flow_id").alias("n_flows"))
    return found.alias("o").join(flows.alias("n"), same("o", "n", keys)).select(*[f"o.{k}" for k in keys], "value_type", "samples", "n_flows", "is_leaf", "is_array_indexed", "n_values")


def reconstructed(b: DataFrame) -> DataFrame:
    """The union of all example shapes per use case and action, default payloads left out."""
    return observe_flows(B.flows(b), defaults=False, count_flows=False).select("build", "usecase", "action", "path_key", "value_type", "is_leaf")


def coverage(bundles: DataFrame) -> DataFrame:
    """How many paths have references, saved data and a schema."""
    return bundles.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_refs") > 0).alias("with_refs"), F.count_if(F.col("n_saved") > 0).alias("with_saved"), F.count_if(F.col("has_schema")).alias("with_schema"))


def checked(b: DataFrame) -> DataFrame:
    return V.run_checks(b)


def schema_overlay(b: DataFrame) -> DataFrame:
    return openapi.with_schema(observe_flows(B.flows(b), count_flows=False).select("build", "usecase", F.split("path_key", r"\.").alias("path")), b)
