"""Functions, matching, evidence, sources and the code scanner on small inputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from treeloom.functions import code, rules
from treeloom.functions import text as T
from treeloom.operators import evidence as E
from treeloom.operators import match as M
from treeloom.sources import documents, paged, sinks


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.snake_to_camel(F.lit("transaction_id_x2_")), "transactionIdX2_"),
        (lambda: T.camel_to_snake(F.lit("bapId")), "bap_id"),
        (lambda: T.array_minus(F.array(*map(F.lit, "aab")), F.array(F.lit("b"))), ["a", "a"]),
        (lambda: T.kb_suffix(F.lit("D:RET.1.2.0.search.context.city")), "search.context.city"),
        (lambda: T.kb_suffix(F.lit("D.1.2")), None),
        (lambda: T.jsonpath_segments(F.lit("$.message.items[0].id")), ["message", "items", "id"]),
        (lambda: T.pointer_segments(F.lit("#/paths/~1search/post")), ["paths", "/search", "post"]),
        (lambda: T.decode_base64(F.lit("%%%")), ""),
        (lambda: T.title_slug(F.lit("release-notes")), "Release Notes"),
        (lambda: T.canonical(F.lit('{"b":1,"a":[2,{"d":1,"c":2}]}')), '{"a":[2,{"c":2,"d":1}],"b":1}'),
        (lambda: T.preview(F.lit(json.dumps("x" * 130))), "x" * 120 + "…"),
        (lambda: T.preview(F.lit(None).cast("string")), "(empty)"),
        (lambda: T.strip_fence(F.lit('```json\n{"a":1}\n```')), '{"a":1}'),
        (lambda: T.match_tails(F.array(*map(F.lit, "abcd"))), [list("abcd"), list("bcd")]),
        (lambda: T.proper_prefixes(F.array(*map(F.lit, "abc"))), [["a"], ["a", "b"]]),
        (lambda: T.snippet(F.lit("1\n2\n3\n4\n5\n6"), F.lit(4), 1), "3\n4\n5"),
        (lambda: rules.overview_stub(F.lit("# Title\nAdd an overview of the X specification here.")), True),
        (lambda: rules.normal_required(F.lit(" Not Required ")), False),
        (lambda: rules.band(F.lit(0.5)), "yellow"),
        (lambda: rules.type_of(F.lit(False), F.lit(True), F.lit("2024-01-01T00:00:00Z"), F.lit("string")), "date-time"),
    ],
)
def test_function(value, column, want):
    assert value(column()) == want


def test_attribute_score(value):
    yes, no = F.lit(True), F.lit(False)
    score = lambda fallback: rules.attribute_score(openapi=yes, custom=yes, enums=yes, tags=yes, refs=F.lit(2), saved=yes, samples=F.lit(3), round_trip=yes, persisted=yes, info=F.lit("x" * 80), is_anchored=yes, fallback=fallback)[0]
    assert value(score(no)) == 1.0 and value(score(yes)) == 0.0


def test_suffix_and_ancestor_joins(spark):
    paths = spark.createDataFrame([(1, ["context", "city"]), (2, ["message", "order", "items", "price"])], "id int, path array<string>")
    chains = spark.createDataFrame([(10, ["payload", "context", "city"]), (11, ["order", "items", "price"]), (12, ["price"])], "c int, chain array<string>")
    assert {(r.id, r.c) for r in E.suffix_join(paths, "path", chains, "chain").collect()} == {(1, 10), (2, 11)}
    saved = spark.createDataFrame([(5, ["message"]), (6, ["context", "city"])], "s int, saved array<string>")
    assert {(r.id, r.s) for r in E.ancestor_join(paths, "path", saved, "saved").collect()} == {(2, 5)}


def test_alias_and_producer(spark):
    sources = spark.createDataFrame([(1, "use(txn_id)"), (2, "txn_id; other_txn_id")], "step int, src string")
    keys = spark.createDataFrame([("txn_id", "g")], "key string, g string")
    assert [r.step for r in E.alias_hits(keys, "key", ["g"], sources, "src", ["step"]).collect()] == [1]
    reads = spark.createDataFrame([("k", ["a", "b"])], "key string, path array<string>")
    made = spark.createDataFrame([("k", ["a"], i) for i in range(6)] + [("k", ["b"], 9)], "pkey string, ppath array<string>, i int")
    assert [r.i for r in E.producer_join(reads, "key", "path", made, "pkey", "ppath", ["i"]).orderBy("i").collect()] == [0, 1, 2, 3]


def test_a_key_that_is_read_and_saved_often_is_cut_before_the_join(spark):
    """Nine hundred million pairs of reads and producers for each path, of which four are wanted."""
    n = 30_000
    paths = spark.createDataFrame([(1, ["m", "a"]), (2, ["m", "b"])], "id int, path array<string>")
    reads = spark.range(n).select("id", F.when(F.col("id") < 10, F.concat(F.lit("open"), "id")).otherwise("k").alias("key"), F.array(F.lit("x"), F.lit("m"), F.lit("b")).alias("chain")).withColumnRenamed("id", "r")
    made = spark.range(n).select(F.col("id").alias("s"), F.lit("k").alias("pkey"), F.when(F.col("id") % 2 == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("a"))).alias("segs"))
    began = time.time()
    got = E.session_reads(reads, "key", "chain", paths, "path", ["id"], made, "pkey", "segs", ["r", "s"])
    assert sorted((x.id, x.r, x.s) for x in got.collect()) == [(1, 10, 0), (1, 10, 1), (1, 10, 2), (1, 10, 3), (2, 0, None), (2, 1, None), (2, 2, None), (2, 3, None)]
    got = E.producer_join(reads.withColumn("path", F.array(F.lit("m"), F.lit("a"))), "key", "path", made, "pkey", "segs", ["r", "s"])
    assert sorted((x.r, x.s) for x in got.collect()) == [(10, 0), (10, 1), (10, 2), (10, 3)]
    assert time.time() - began < 60


def test_reference_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {(r.root, r.node, r.hops) for r in M.resolve_refs(e).collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("a", "c", 2)}


def test_references_beyond_the_row_limit(spark):
    edges = spark.range(300).selectExpr("concat('c', id) AS src", "concat('n', id % 7) AS dst").union(spark.range(7).selectExpr("concat('n', id)", "'world'"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = {(r.root, r.node, r.hops) for r in M.resolve_refs(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(f"c{i}", f"n{i % 7}", 1) for i in range(300)} | {(f"c{i}", "world", 2) for i in range(300)} | {(f"n{i}", "world", 1) for i in range(7)}


def test_split_document(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "index.yaml").write_text("openapi: 3.0.0\ninfo: {domain: D}\nx-flows:\n  - $ref: flows.yaml\nx-docs: {$ref: docs}\npaths: {a: {$ref: '#/nowhere'}}\n")
    (tmp_path / "flows.yaml").write_text("- {id: f1, when: 2024-01-01}\n- {id: f2}\n")
    (tmp_path / "docs" / "guide.md").write_text("# G")
    doc = json.loads(documents.read_split(spark, str(tmp_path / "index.yaml")).first().doc)
    assert [f["id"] for f in doc["x-flows"]] == ["f1", "f2"] and doc["x-docs"] == {"guide": "# G"} and doc["paths"]["a"] == {"$ref": "#/nowhere"}


def test_builds_and_broken_files(spark, tmp_path):
    for d, text in (("A/1.0", "info: {domain: A}"), ("B/2.0", "a: [")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "build.yaml").write_text(text)
    good, bad = paged.split_errors(documents.read_builds(spark, str(tmp_path)))
    assert [r.build for r in good.collect()] == ["A/1.0"] and [r.build for r in bad.collect()] == ["B/2.0"]


def test_paged_source(spark):
    def fetch(page, size):
        return [{"name": f"{'draft' if i % 2 else 'main'}-{i}"} for i in range(page * size, min(page * size + size, 450))]

    assert paged.read(spark, "listing", fetch, "name string", prefix=("name", "draft-")).count() == 225


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "# A\nx"), ("b", "# B")], "file string, page string")
    sinks.write_pages(df, f"{tmp_path}/pages")
    assert {r.file: r.value for r in spark.read.text(f"{tmp_path}/pages", wholetext=True).collect()} == {"a": "# A\nx\n", "b": "# B\n"}
    sinks.append_timings(df, f"{tmp_path}/log")
    sinks.append_timings(df, f"{tmp_path}/log")
    assert spark.read.option("sep", "\t").option("header", True).option("multiLine", True).csv(f"{tmp_path}/log").count() == 4


def test_access_records(spark):
    src = "const order = payload.message.order;\nif (order.paid) { order.state = 'x'; }\norder.items.forEach(it => it.id);\nsession.txn = 1;"
    code.register(spark)
    spark.createDataFrame([(src,)], "src string").createOrReplaceTempView("sources")
    got = [(".".join(r.path), r.role, r.gate, r.session_key) for r in spark.sql("SELECT r.* FROM sources, LATERAL access_records(src) r").collect()]
    assert ("message.order.state", "write", "order.paid", None) in got
    assert ("message.order.items.[*].id", "read", None, None) in got
    assert ("txn", "write", None, "txn") in got
