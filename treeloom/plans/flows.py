"""Flows and recorded payloads: references of steps, retrieval of transaction groups, files of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import profile as P
from ..sources import paged
from . import builds as B

#: What a drafting input shows of an observation. Fixed values.
INPUT_SAMPLES, INPUT_FLOWS = 8, 5


def step_references(b: DataFrame) -> DataFrame:
    """A row per step with the session keys that earlier steps of its flow have saved."""
    s = B.steps(B.flows(b)).withColumn("k", F.concat_ws("/", "build", "flow_id"))
    rows = P.prior_values(s, "k", "step_index", F.map_keys("save_data"))
    return rows.drop("k").withColumnRenamed("prior", "prior_keys")


def draft_input(observations: DataFrame, samples: str = "samples", flows: str = "flows", refs: str = "refs") -> DataFrame:
    """Observations cut to what a prompt shows; writes that stand under a condition are listed apart."""
    gated = F.transform(F.filter(refs, lambda r: (r["role"] == "write") & r["gate"].isNotNull()), lambda r: r["gate"])
    return observations.withColumns({"gated_writes": gated, samples: F.slice(samples, 1, INPUT_SAMPLES), flows: F.slice(flows, 1, INPUT_FLOWS)})


def payload_groups(payloads: DataFrame, domain: str, version: str, flow_id: str, actions: list[str], least: int) -> DataFrame:
    """For each usable transaction group the first payload of every required action, in their order."""
    wanted = [a.strip().upper() for a in actions]
    rows = paged.filter_payloads(payloads, domain, version, flow_id, wanted)
    groups = P.valid_groups(rows, "transaction_id", "action", wanted, least).select("transaction_id")
    kept = rows.join(groups, "transaction_id", "left_semi")
    return M.action_slots(kept, "transaction_id", "action", ["created_at", "payload_id"], wanted, "json_request")


def convert(flows: DataFrame, summaries: DataFrame, steps: DataFrame, payloads: DataFrame) -> DataFrame:
    """Steps of flows with the payloads of the latest transaction, and each flow's nearest summary."""
    named = M.nearest_name(flows, "flow_id", summaries, "summary", "ord")
    latest = payloads.groupBy("flow_id", "transaction_id").agg(F.min_by("at", "ord").alias("first_at"), F.min("ord").alias("first"))
    best = latest.groupBy("flow_id").agg(F.max_by("transaction_id", F.struct(F.coalesce("first_at", F.lit("1970-01-01").cast("timestamp")), -F.col("first"))).alias("transaction_id"))
    own = payloads.join(best, ["flow_id", "transaction_id"], "left_semi")
    matched = M.kth_occurrence(steps, own, ["flow_id", "action"], ["step_index"], [F.col("at").desc_nulls_last(), "ord"], ["payload"])
    return matched.join(named.select("flow_id", F.col("nearest").alias("summary")), "flow_id", "left")


def flow_files(flows: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each flow: as the index says, else the first file whose own meta names the flow."""
    by_meta = files.groupBy(F.col("meta_flow_id").alias("id")).agg(F.min("file").alias("found"))
    return flows.join(index.select("id", F.col("file").alias("listed")), "id", "left").join(by_meta, "id", "left").withColumn("file", F.coalesce("listed", "found")).drop("listed", "found")


def first_file(files: DataFrame, name: str) -> DataFrame:
    """The first file of a name, in order of path."""
    return files.where(F.element_at(F.split("path", "/"), -1) == name).orderBy("path").limit(1)


def review_filter(threshold: float, query: str | None = None, low: bool = False, open_only: bool = False, blob: tuple = ("path", "draft")) -> Column:
    """What a review shows: low scores, open rows, rows that contain a text."""
    shown = F.lit(True)
    if low:
        shown = shown & (F.col("score") < threshold)
    if open_only:
        shown = shown & ~F.col("approved")
    return shown & F.contains(F.lower(F.concat_ws(" ", *blob)), F.lit(query.lower())) if query else shown


def split_build(b: DataFrame) -> dict[str, DataFrame]:
    """A build as files, by section: (build, file, page). Each section is one projection and one write."""
    section = lambda key, file: b.select("build", F.lit(file).alias("file"), B.part(F.col("doc"), key).alias("page")).where("page is not null")
    flow = B.flows(b).select("build", F.concat(F.lit("flows/"), F.regexp_replace("id", r"[^a-zA-Z0-9\-_]", "-"), F.lit(".json")).alias("file"), F.to_json(F.struct("type", "id", "usecase", "tags", "description", F.try_parse_json("config").alias("config"))).alias("page"))
    sets = B.attribute_sets(b).select("build", F.concat(F.lit("attributes/"), F.regexp_replace("use_case", r"[^a-zA-Z0-9_-]", "_"), F.lit(".json")).alias("file"), F.to_json(F.struct(F.try_parse_json("meta").alias("meta"), F.try_parse_json("tree").alias("attribute_set"))).alias("page"))
    docs = B.docs(b).select("build", F.concat(F.lit("docs/"), "slug", F.lit(".md")).alias("file"), F.col("content").alias("page"))
    return {
        "info": section("info", "index.json"), "paths": section("paths", "paths.json"), "components": section("components", "components.json"), "flows": flow, "attributes": sets,
        "validations": section("x-validations", "validations/index.json"), "errors": section("x-errorcodes", "error_codes.json"), "actions": section("x-supported-actions", "supported_actions.json"), "docs": docs,
    }
