"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; within its source documents
are taken in ascending order of the key until the source's budget of words is used up. A target of
more than the source's size takes complete epochs first, and the sampled order decides the rest.
The document at the border gives only the words that are still missing.

The order inside a source is never sorted in one task: keys fall into slices of about equal weight
(a fixed, monotone function of the key), slices are summed up first, and the running sum inside a
slice starts from the sum of the slices before it.

Only DataFrame functions are used. Nulls: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; a null doc_id draws a key like an id of its own. Ties of keys go by doc_id, then size.
Repeated rows are drawn and counted one by one. Documents of size 0 take nothing. Empty table: no
rows. Extra columns are ignored by mix and kept by apply_mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; share of all sizes that targets sum up to; most epochs.
WEIGHTS, SHARE_PERCENT, MOST_EPOCHS = (3, 1, 2), 150, 2
#: Slices of a source's keys; a slice is what one task sorts.
SLICES = 4096
#: Hexadecimal digits of the hash that become a uniform number.
_DIGITS = 13


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the id alone, so that reruns agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 4 * _DIGITS)


def quality_weight(size: Column) -> Column:
    """Quality weight of a document where no model gives one: longer texts up to 200 words count more, from 0.5 to 1.5."""
    return 0.5 + F.least(size, F.lit(200)) / F.lit(200.0)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """sources: source, source_size. Adds target: shares by weight, capped at `most` sizes, the excess reshared.

    The final level L gives every source min(cap, L * weight). Sources are sorted by cap per weight;
    the first k are capped, for the smallest k whose level stays under the next source's cap per
    weight. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(kinds, (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    sorted_ = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    by = sorted_.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({"capped": F.coalesce(F.sum("cap").over(by), F.lit(0)), "used": F.coalesce(F.sum("weight").over(by), F.lit(0)), "budget": F.sum("source_size").over(every) * share_percent, "all_weight": F.sum("weight").over(every)})
    level = (F.col("budget") - F.col("capped") * 100) / (F.lit(100.0) * (F.col("all_weight") - F.col("used")))
    rows = rows.withColumns({"level": level, "place": F.row_number().over(sorted_)})
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)
    return rows.withColumn("final", final["level"]).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS, quality: Column | None = None, seed: int = 0, slices: int = SLICES, row: str | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each document; `quality` is a positive expression over doc_id and size.

    `row` names a column with a number per row, to carry along as `row`.
    """
    number = F.col(row).cast("long") if row else F.lit(0).cast("long")
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    rows = common.materialize(spark, rows, "mix-sizes")
    weight = quality if quality is not None else quality_weight(F.col("size"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    rows = rows.withColumn("key", key).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices).cast("int"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    # One row per source and slice at most; their number doesn't grow with the documents.
    sums = common.materialize(spark, sums, "mix-slices")
    goal = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share_percent, most)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    starts = starts.join(goal, starts.source.eqNullSafe(goal.source)).select(starts.source.alias("s"), F.col("slice").alias("k"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, rows.source.eqNullSafe(F.col("s")) & (rows.slice == F.col("k")))
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size") - F.col("start") - F.col("within")
    return rows.select(*["row"] * bool(row), "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: documents repeated as often as they are taken, the one at the border cut to the words it gives.

    Columns are those of docs. Rows are numbered first and mixed under their number, so that rows
    with equal or null ids are each taken as planned; the key is still drawn from doc_id.
    """
    name = {k: common.free_name(f"_mix_{k}", docs) for k in ("row", "size", "taken", "copy")}
    row, size, taken, copy = name["row"], F.col(name["size"]), F.col(name["taken"]), F.col(name["copy"])
    rows = common.materialize(spark, docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(spark, rows, row=row, **options).where("taken > 0").select(F.col("row").alias(row), F.col("size").alias(name["size"]), F.col("taken").alias(name["taken"]))
    copies = F.floor((taken + size - 1) / size).cast("long")
    joined = rows.join(plan, row).withColumn(name["copy"], F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    left = taken - copy * size
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), "")
    return joined.withColumn("text", F.when(left >= size, F.col("text")).otherwise(cut)).select(*docs.columns)


#: The same in SQL: keys come from the same digits of the same hash.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
              / (0.5 + least(size, 200) / 200.0::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS capped, coalesce(sum(weight) OVER b, 0)::BIGINT AS used,
             row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place,
             (sum(source_size) OVER () * 150)::BIGINT AS budget, (sum(weight) OVER ())::BIGINT AS all_weight FROM w
      WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - capped * 100)::DOUBLE / (100.0::DOUBLE * (all_weight - used)) AS level FROM c),
g AS (SELECT arg_min(level, place) AS final FROM l WHERE level * weight <= cap),
f AS (SELECT l.*, g.final FROM l, g),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(final * weight, cap::DOUBLE)) AS target FROM f),
r AS (SELECT k.*, source_size, target, floor(target + 0.5)::BIGINT AS words,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
        + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM r"""
