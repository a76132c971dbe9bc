"""Profiles of observed values, and grouping of recorded transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct samples kept per path. A fixed value.
SAMPLES = 5


def first_seen(df: DataFrame, keys: list[str], value: str, ord_: str) -> DataFrame:
    """The value of the first row of each group."""
    return df.groupBy(*keys).agg(F.min_by(value, ord_).alias(value))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, ord_: str) -> DataFrame:
    """Most frequent value per group, of equally frequent ones the first seen. Two partial aggregations, no sort."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ord_).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value"), "n"), F.struct("n", -F.col("first"))).alias("m")).select(*keys, F.col("m.value").alias("most_common"), F.col("m.n").alias("count"))


def leaf_profile(df: DataFrame, keys: list[str], value: str, flow: str | None, ord_: str, kind: str, in_array: str, samples: int = SAMPLES, times: str | None = None) -> DataFrame:
    """Per key: first type, distinct samples in first-seen order, number of flows, leaf and array flags.

    Values are reduced to one row per distinct value first, so a list never holds repeats. Containers
    have kind `object`; whether a path is a leaf follows its first sighting. Without `flow` flows aren't numbered;
    `times` has how often a row was seen.
    """
    scalar = F.col(kind) != "object"
    n_values = F.count_if(scalar) if times is None else F.coalesce(F.sum(F.when(scalar, F.col(times))), F.lit(0).cast("long"))
    n_flows = [] if flow is None else [F.count_distinct(flow).alias("n_flows")]
    own = df.groupBy(*keys).agg(F.min_by(kind, ord_).alias("value_type"), *n_flows, F.bool_or(F.col(in_array) & scalar).alias("later_array"), F.min_by(in_array, ord_).alias("first_array"), n_values.alias("n_values"))
    ranked = df.where(scalar).groupBy(*keys, value).agg(F.min(ord_).alias("first")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).where(F.col("rank") <= samples)
    kept = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(value).alias("v")))), lambda s: s["v"]).alias("samples"))
    s = [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    cond = s[0]
    for c in s[1:]:
        cond = cond & c
    return own.alias("o").join(kept.alias("s"), cond, "left").select(
        *[F.col(f"o.{k}") for k in keys], "value_type", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), *["n_flows"] * len(n_flows), (F.col("value_type") != "object").alias("is_leaf"), (F.col("first_array") | F.col("later_array")).alias("is_array_indexed"), "n_values"
    )


def flows_per_action(df: DataFrame, action: str, flow: str) -> DataFrame:
    return df.groupBy(action).agg(F.count_distinct(flow).alias("n_flows"))


def valid_groups(df: DataFrame, group: str, action: str, actions: list[str], least: int) -> DataFrame:
    """Groups with enough rows and all required actions; if there is none, every group. Rows without a group are left out."""
    wanted = sorted(set(actions))
    has = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col(action) == a).alias(f"h{i}") for i, a in enumerate(wanted)])
    valid = F.col("n") >= least
    for i in range(len(wanted)):
        valid = valid & F.col(f"h{i}")
    marked = has.select(group, "n", valid.alias("valid"))
    some = marked.agg(F.coalesce(F.bool_or("valid"), F.lit(False)).alias("some"))
    return marked.crossJoin(F.broadcast(some)).where("valid or not some").select(group, "n", "valid")


def latest_group(df: DataFrame, group: str, when: str, ord_: str) -> DataFrame:
    """The group whose first row is the latest; of equal ones the first in order."""
    first = df.groupBy(group).agg(F.min_by(when, ord_).alias("at"), F.min(ord_).alias("first"))
    return first.agg(F.max_by(F.struct(F.col(group), F.col("at")), F.struct(F.coalesce("at", F.lit("1970-01-01").cast("timestamp")), -F.col("first"))).alias("g")).select(f"g.{group}", "g.at")


def prior_values(df: DataFrame, group: str, ord_: str, values: Column) -> DataFrame:
    """Distinct values of the rows before each row of its group, in order of their first sighting.

    Values are reduced to their first row first, so that the running list never holds one twice; what
    is left grows only as the result does. `ord_` orders the rows of a group without ties.
    """
    seen = df.select(F.col(group).alias("g"), F.col(ord_).alias("o"), F.posexplode(values).alias("p", "v"))
    first = seen.groupBy("g", "v").agg(F.min(F.struct("o", "p")).alias("at")).groupBy("g", F.col("at.o").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at.p", "v"))), lambda r: r["v"]).alias("new"))
    w = Window.partitionBy(group).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(first, F.col(group).eqNullSafe(F.col("g")) & (F.col(ord_) == F.col("o")), "left")
    return joined.withColumn("prior", F.flatten(F.collect_list("new").over(w))).select(*df.columns, "prior")


def observations(payloads: DataFrame, ids: list[str], json: str) -> DataFrame:
    """Nodes of payloads as rows for leaf_profile: ids, path, kind, value, in_array, place. Arrays add no segment."""
    from . import diff

    nodes = diff.shred(payloads, ids, json, arrays=True)
    kind = (
        F.when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape") == "STRING", "string").when(F.col("shape") == "BOOLEAN", "boolean").when(F.col("shape") == "VOID", "null").otherwise("number")
    )
    rows = nodes.where(~F.col("shape").startswith("ARRAY"))
    return rows.select(*ids, "path", F.array_join("path", ".").alias("path_key"), kind.alias("kind"), F.col("canon").alias("value"), (F.col("depth") > F.size("path")).alias("in_array"), "place")
