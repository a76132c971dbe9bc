"""The drafting plan: find gaps, group them, draft once per group, score, approve, write back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import evidence as E

#: A draft without evidence, and tries of a draft. Fixed values.
NO_DATA, TRIES = "<no-enough-data>", 2


def gaps(observations: DataFrame, leaves: DataFrame, keys: list[str], force_all: bool = False) -> DataFrame:
    """Observations with the reason why they are drafted or not."""
    at = lambda k: F.get_json_object("leaf", f"$.{k}")
    joined = observations.join(leaves.select(*keys, "leaf"), keys, "left")
    incomplete = R.incomplete_leaf(at("info"), at("usage"), at("owner"), at("type"))
    return joined.withColumn("reason", R.gap_reason(F.col("leaf").isNotNull(), incomplete, force_all))


def draft(groups: DataFrame, prompt: str, complete: Callable[[str], str]) -> DataFrame:
    """A draft per row. `complete` is tried again once; then the row has the sentinel and its error.

    Give one row per group: a completion is dear, and members share it afterwards.
    """
    schema = groups.select("*", F.lit(None).cast("string").alias("draft"), F.lit(None).cast("string").alias("error")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf[prompt]:
                error = None
                for _ in range(TRIES):
                    try:
                        out.append((complete(text), None))
                        break
                    except Exception as e:  # a provider's failure belongs to its row
                        error = str(e)
                else:
                    out.append((NO_DATA, error))
            yield pdf.assign(draft=[o[0] for o in out], error=[o[1] for o in out])

    return groups.mapInPandas(run, schema)


def fan_out(members: DataFrame, drafts: DataFrame, ord_: str) -> DataFrame:
    """Group drafts for all members; slots without a draft get the sentinel."""
    return E.clone_members(members, ord_, drafts, "representative", "draft").withColumn("draft", F.coalesce("draft", F.lit(NO_DATA)))


def approve_visible(rows: DataFrame, threshold: float = R.APPROVE_FROM, query: str | None = None, only_low: bool = False, only_open: bool = False) -> DataFrame:
    """Approve every row that the filters of a review show."""
    shown = F.lit(True)
    if only_low:
        shown = shown & (F.col("score") < threshold)
    if only_open:
        shown = shown & ~F.col("approved")
    if query:
        shown = shown & F.contains(F.lower(F.concat_ws(" ", "path", "draft")), F.lit(query.lower()))
    return rows.withColumn("approved", F.when(shown, True).otherwise(F.col("approved")))


def overlay(leaves: DataFrame, approved: DataFrame, keys: list[str]) -> DataFrame:
    """Approved drafts over existing leaves; drafts for new paths are added."""
    a = approved.where("approved").select(*keys, F.col("leaf").alias("new_leaf"))
    return leaves.join(a, keys, "full_outer").select(*keys, F.coalesce("new_leaf", "leaf").alias("leaf"))
