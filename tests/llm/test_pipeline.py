"""The pipeline against brute force, on a small corpus."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from treeloom.llm import mixing, token_files  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1][:200])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, rows, folder):
    from .test_operators import jaccard_truth

    one, two, three, four, five = [f for _, f in corpus_pipeline.STAGES]
    kept = one(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    letterless = [r[0] for r in rows if r[1] is None or not any(c.isalpha() for c in r[1])]
    assert not set(ids) & set(letterless) and len(ids) == len(rows) - len(letterless)
    left = two(spark, kept, folder)
    sound = [r for r in rows if r[0] not in letterless]
    # ids stand for themselves here but for the repeated and null ones, which copy nothing
    groups = {c for (_, n, c, _), k in jaccard_truth(sound).items() for _ in range(k) if c is not None}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= groups
    assert left.count() == len(groups) + 1 + 2  # the second row of id 5, and two null ids whose texts are like no other
    clean = three(spark, left, folder)
    assert {r.doc_id for r in left.collect()} - {r.doc_id for r in clean.collect()} == {7}
    mixed = four(spark, clean, folder)
    assert mixed.columns == docs.columns
    taken = mixing.mix(spark, clean).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == taken
    assert five(spark, mixed, folder).count() == mixed.count()


def test_run_and_empty_input(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert token_files.END_ID == 2


def test_earlier_results_stay_readable(spark, docs, folder):
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    n = left.count()
    first = corpus_pipeline.run(spark, folder)
    tokens = first.count()
    corpus_pipeline.decontaminate(spark, docs, folder)
    corpus_pipeline.run(spark, folder)
    assert left.count() == n and first.count() == tokens


def test_odd_columns_and_repeated_runs(spark, docs, folder, tmp_path):
    """Null sources and ids pass, clashing names stay, and a second run gives the same rows."""
    odd = docs.selectExpr("doc_id", "text", "lang", "CAST(NULL AS string) AS source", "n_chars", "1 AS _pipeline_row", "'mine' AS _lang_pred", "2 AS _keep")
    one, two, three, four, _ = [f for _, f in corpus_pipeline.STAGES]
    out = four(spark, three(spark, two(spark, one(spark, odd, folder), folder), folder), folder)
    assert out.columns == odd.columns
    assert {(r._pipeline_row, r._lang_pred, r._keep, r.source) for r in out.collect()} == {(1, "mine", 2, None)}
    runs = [sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
