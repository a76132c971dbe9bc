"""The corpus pipeline: five stages over documents, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
as Parquet in the shared folder, reads it again as the next one's docs and then deletes the stage's
work folders. A stage itself deletes only folders of its own that its result doesn't read.

1. language: rows whose language prediction is rejected (no letters, or a score under the
   calibrated bound) go. The model learns from the labelled rows of docs themselves.
2. near_duplicates: of each component of near-duplicate texts the row with the smallest doc_id
   stays (of repeated ids the first row); texts without words are no copies of each other.
3. decontaminate: rows with a passage of the benchmark go.
4. mix: rows are repeated, kept or left out so that sources meet their targets; the row at a
   source's border is cut to the words it gives.
5. tokens: the mixed corpus as token files in the order of doc_id, described by a row per document.

Null texts are rejected by stage 1; null ids, sources and labels pass through all stages. Empty
documents give an empty result. The columns of documents are kept up to stage 4, whatever their names;
helper columns take names that documents don't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import common, jaccard, langid, mixing, positional, token_files


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, so that rows with equal or null ids stay apart; and the number's name."""
    row = common.free_name("_pipeline_row", docs)
    return common.materialize(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _settled(spark: SparkSession, df: DataFrame, name: str, first: int) -> DataFrame:
    """df written, and the work folders since the first-th deleted: only df reads them, and no other stage or caller has them."""
    own = common.CREATED[first:]
    out = common.materialize(spark, df, name)
    for path in own:
        common.remove(spark, path)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(spark, docs, F.lit(True))
    names = tuple(common.free_name(k, docs) for k in ("_lang_pred", "_lang_score", "_lang_rejected"))
    return langid.predict(spark, docs, model, names).where(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(spark, docs)
    first = len(common.CREATED)
    found = jaccard.join(spark, rows.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0 and component_id <> doc_id")
    # Row numbers stand for ids in the join; the row that stays is the one with the smallest doc_id.
    members = found.select(F.col("doc_id").alias("_member"), F.col("component_id").alias("_group"))
    heads = members.select(F.col("_group").alias("_member"), "_group").distinct()
    grouped = members.unionByName(heads).join(rows.select(F.col(row).alias("_member"), "doc_id"), "_member")
    grouped = _settled(spark, grouped, "near-groups", first)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_member").alias("row"))
    kept = grouped.groupBy(F.col("_group").alias("_g")).agg(F.min(order)["row"].alias("_keep"))
    kept = common.materialize(spark, kept, "near-kept")  # a plain exchange on both sides, so that a hot group is split
    gone = grouped.join(kept, F.col("_group") == F.col("_g")).where("_member <> _keep").select(F.col("_member").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(spark, docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first = len(common.CREATED)
    hit = positional.decontaminate(spark, rows.select(F.col(row).alias("doc_id"), "text"), benchmark).where("n_hit > 0").select(F.col("doc_id").alias(row))
    hit = _settled(spark, hit, "hits", first)
    return rows.join(hit, row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Learned languages and similarity groups have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        past, path = path, common.work_path(spark, f"stage-{name}")
        first = len(common.CREATED)
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        for folder in [*common.CREATED[first:], *[past] * bool(past)]:
            common.remove(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
