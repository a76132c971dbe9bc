"""Schema lookup, books, flows and the guard of the entry module."""

import copy
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from treeloom.operators import profile
from treeloom.plans import book, builds, flows, openapi
from treeloom.sources import schemas

from .test_builds import BASE


def build():
    b = copy.deepcopy(BASE)
    b["paths"] = {"/search": {"post": {"requestBody": {"content": {"application/json": {"schema": {"allOf": [{"$ref": "#/components/schemas/Loop"}, {"properties": {"context": {"$ref": "#/components/schemas/Ctx"}}}]}}}}}}}
    b["components"] = {"schemas": {"Ctx": {"description": " c ", "properties": {"city": {"type": "string", "enum": [1, "x"]}, "list": {"type": "array", "items": {"properties": {"deep": {}}}}}}, "Loop": {"allOf": [{"$ref": "#/components/schemas/Loop"}], "properties": {"own": {"type": "number"}}}}}
    b["x-flows"][0]["config"]["steps"] = [
        {"api": "search", "owner": "BAP", "mock": {"saveData": {"txn": "$.context.transaction_id"}, "defaultPayload": {"only": {"default": 1}}, "generate": "eA=="}, "examples": [{"payload": {"context": {"city": "A"}}}]},
        {"api": "", "mock": {}}, {"api": "on_search", "mock": {"saveData": {"x": "$.a"}}, "examples": [{"payload": {"context": {"city": "B"}}}]},
    ]
    return b


def frame(spark):
    return spark.createDataFrame([("b", json.dumps(build()))], "build string, doc string")


def test_schema_paths(spark):
    got = {(r.action, ".".join(r.path)): r for r in openapi.schema_paths(frame(spark)).collect()}
    assert set(got) == {("search", p) for p in ("own", "context", "context.city", "context.list")}
    assert got[("search", "context")].description == "c" and got[("search", "context.city")].enums == ["1", "x"]


def test_steps_and_observations(spark):
    refs = {r.step_index: r for r in flows.step_references(frame(spark)).collect()}
    assert refs[0].prior_keys == [] and refs[2].prior_keys == ["txn"] and refs[0].generate_source == "x"
    seen = {r.path_key for r in book.observe(frame(spark)).collect()}
    assert {"search.only.default", "search.context.city", "on_search.context.city"} <= seen
    assert "search.only.default" not in {r.path_key for r in book.reconstructed(frame(spark)).collect()}


def test_flows_as_rows_are_observed_like_a_build(spark):
    payload = lambda i, k: {"a": [i % 3, {"b": k}], "c": None if i else {"d": 1}}
    steps = lambda i: [{"api": a, "examples": [{"payload": payload(i, k)} for k in (1, 1, 2)], "mock": {"defaultPayload": payload(9, i)}} for a in ("x", "y", "x")]
    own = [{"id": f"f{i // 2}", **({"usecase": f"u{i % 2}"} if i < 6 else {}), "config": {"steps": steps(i), "transaction_history": [{"action": "x", "payload": payload(0, i)}]}} for i in range(9)]
    doc = spark.createDataFrame([("b", json.dumps({"x-flows": own}))], "build string, doc string")
    rows = spark.createDataFrame([("b", i * 2**59 - 2**62, json.dumps(f)) for i, f in enumerate(own)], "build string, ord bigint, flow string")
    whole = sorted(map(tuple, book.observe(doc).collect()), key=str)
    assert sorted(map(tuple, book.observe_flows(builds.flow_rows(rows)).collect()), key=str) == whole
    got = {(r.usecase, r.path_key): r for r in book.observe(doc).collect()}
    x = got[(None, "x.a")]
    assert (x.n_flows, x.n_values, x.samples, x.is_array_indexed) == (2, 27, ["0", "1", "2"], True)
    assert got[("u0", "x.c")].value_type == "null" and got[("u0", "x")].n_flows == 3
    nodes = profile.observations(book.payloads(doc), ["build", "usecase", "action", "flow_id", "ord"], "payload")  # each payload by itself
    nodes = nodes.withColumns({"path_key": F.concat_ws(".", F.array("action"), F.col("path")), "ord": F.concat("ord", "place")})
    each = profile.leaf_profile(nodes, ["build", "usecase", "action", "path_key"], "value", "flow_id", "ord", "kind", "in_array")
    assert sorted(map(tuple, each.collect()), key=str) == whole
    assert book.flow_payloads(builds.flow_rows(rows)).count() == 9 * 13


def test_payloads_come_by_one_look_at_a_flow(spark, tmp_path):
    odd = ['{"steps":[null,1,"s",{},{"api":5,"mock":"m","examples":[{"payload":{"b":1}},7,null]}],"transaction_history":[{"action":"h","payload":{"q":1}},{"payload":4}]}']
    odd += ['{"steps":[{"api":"a","api":"b","examples":[{"payload":1,"payload":2}]}]}', '{"steps":{"api":"a"}}', '"x"', "null"]
    odd += ['{"steps":[{"api":"a","mock":{"defaultPayload":{"z":1}},"examples":[{"payload":2}]}],"transaction_history":[{"action":"x","payload":"3"}]}']
    rows = spark.createDataFrame([("b", i, f'{{"id":"f","usecase":"u","config":{c}}}') for i, c in enumerate(odd)], "build string, ord bigint, flow string")
    rows.write.parquet(str(tmp_path / "flows"))
    read = book.flow_payloads(builds.flow_rows(spark.read.parquet(str(tmp_path / "flows"))))
    assert read._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    x = [("5", '{"b":1}', [0, 0, 4, 1]), ("h", '{"q":1}', [0, 1, 0, 0]), ("a", "1", [1, 0, 0, 1]), ("a", '{"z":1}', [5, 0, 0, 0]), ("a", "2", [5, 0, 0, 1]), ("x", "3", [5, 1, 0, 0])]
    assert sorted(tuple(r) for r in read.select("ord", "action", "payload").collect()) == sorted((o, a, p) for a, p, o in x)
    shown = book.flow_payloads(builds.flow_rows(rows), defaults=False)
    assert sorted(r.ord for r in shown.collect()) == sorted(o for _, p, o in x if p != '{"z":1}')


def test_book_and_split(spark):
    page = book.book(frame(spark)).first().page
    assert page.index("# Overview") < page.index("# Flows") < page.index("# Error codes")
    files = {r.file for part in flows.split_build(frame(spark)).values() for r in part.collect()}
    assert {"index.json", "flows/flow-1.json", "attributes/uc-alpha.json", "docs/overview.md", "error_codes.json"} <= files


def test_step_phases():
    from treeloom.plans.book import Step, run_steps

    steps = [Step(i, i, lambda t, i=i: {i: t}) for i in ("scaffold", "attributes-detect", "flows-detect")]
    assert set(run_steps(steps, {}, "flows")) == {"scaffold", "flows-detect"}


def test_payload_groups(spark):
    rows = [(f"m{k}", t, "F", f"p{k}", a, None, None, None, json.dumps({"context": {"domain": "D", v: "1.0"}}), None, 200, None, "s", None, None) for k, (t, a, v) in enumerate([("t1", "SEARCH", "version"), ("t1", "SELECT", "core_version"), ("t2", "SEARCH", "version"), (None, "SEARCH", "version")])]
    got = flows.payload_groups(spark.createDataFrame(rows, schemas.PAYLOADS), "D ", "1.0", "F", ["search", " select"], 2).where(F.col("json_request").isNotNull())
    assert [(r.transaction_id, r.action) for r in got.orderBy("slot").collect()] == [("t1", "SEARCH"), ("t1", "SELECT")]


def test_entry_without_corpus_operators(tmp_path):
    """The entry module and the rest work where the corpus operators are gone."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "treeloom", tmp_path / "treeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'keyed_diff' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent
    for f in (root / "treeloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text()


def test_bodies_come_by_route_and_meet_the_references_of_their_build(spark):
    routes = spark.range(3000).selectExpr("concat('b', id % 3) AS build", "concat('/r', id) AS route", """'{"properties":{"a":{"$ref":"#/s"},"again":{"properties":{"b":{}}}}}' AS body""")
    rests = spark.createDataFrame([("b0", '{"s":{"type":"x"}}'), ("b1", '{"s":{"type":"y"}}')], "build string, doc string")
    got = openapi.body_paths(routes, rests).groupBy("build", F.array_join("path", ".").alias("path"), "type").agg(F.countDistinct("action").alias("n")).collect()
    assert {tuple(r) for r in got} == {(b, p, t if p == "a" else None, 1000) for b, t in (("b0", "x"), ("b1", "y"), ("b2", None)) for p in ("a", "again", "again.b")}


def test_references_into_paths_are_followed(spark):
    doc = {"paths": {"/x": {"post": {"requestBody": {"content": {"application/json": {"schema": {"properties": {"a": {"$ref": "#/paths/~1y/own"}}}}}}}}, "/y": {"own": {"type": "number"}}}}
    got = openapi.schema_paths(spark.createDataFrame([("b", json.dumps(doc)), ("c", "["), ("d", "[]"), ("e", None)], "build string, doc string")).collect()
    assert [(r.build, r.action, r.path, r.type) for r in got] == [("b", "x", ["a"], "number")]


def test_info_meets_its_other_side_in_one_row(spark):
    row = lambda name, info: (name, json.dumps({"openapi": "3.0.0" if name == "a" else None, "info": info}))
    old = spark.createDataFrame([row("a", {"title": "t", "domain": "d", "x-usecases": ["u", "u"]}), row("b", {"title": "x"}), ("c", None)], "build string, doc string")
    new = spark.createDataFrame([row("a", {"title": "T", "domain": "d", "description": "e", "x-usecases": ["v"]}), row("b", {"version": "1"}), ("c", None)], "build string, doc string")
    log = builds.diff_info(old, new)
    assert sorted((r.build, r.kind, r.path, r.before, r.after) for r in log.where("path <> 'info.x-usecases'").collect()) == [("a", "modified", "info.description", "", "e"), ("a", "modified", "info.title", "t", "T"), ("b", "modified", "info.title", "x", ""), ("b", "modified", "info.version", "", "1")]
    assert sorted((r.kind, r.summary) for r in log.where("path = 'info.x-usecases'").collect()) == [("added", 'Use case added: "v"'), *[("removed", 'Use case removed: "u"')] * 2]
    lines = log._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    joins = [k for k, x in enumerate(lines) if x.lstrip(" :+-").startswith("Join")]
    assert joins
    for k in joins:  # no row per field goes into a join
        inside = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        assert not any("Generate" in x for x in lines[k + 1 : inside])


def test_changelog_makes_a_document_once(spark):
    side = lambda t: spark.range(2).selectExpr("concat('b', id) AS build", f"""concat('{{"info":{{"title":"{t}"}},"x-docs":{{"a":"{t}', id, '"}}}}') AS doc""")
    log = builds.changelog(side("x"), side("yz"), ("info", "docs", "errors"))
    assert "Range (" not in log._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.build, r.section, r.path, r.before) for r in log.collect()) == [(b, *e) for b in ("b0", "b1") for e in (("docs", "x-docs.a", "2 chars"), ("info", "info.title", "x"))]
