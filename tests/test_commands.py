"""Commands end to end, public names, and parts that have no table of the driver's to run over."""

import base64
import json

import pytest
from pyspark.sql import functions as F

import treeloom
from treeloom.__main__ import COMMANDS, main
from treeloom.functions import rules
from treeloom.operators import ordering
from treeloom.plans import convert
from treeloom.sources import documents, sinks

CODE = base64.b64encode(b"payload.message.id = 1; // message.id is new").decode()
BUILD = {
    "openapi": "3.0.0", "info": {"domain": "D", "version": "1", "x-usecases": ["u"]}, "paths": {}, "x-docs": {"guide": "# G"}, "x-errorcodes": {"code": [{"code": 1, "Event": "e"}]},
    "x-supported-actions": {"supportedActions": {"search": []}, "apiProperties": {}},
    "x-attributes": [{"meta": {"use_case_id": "u"}, "attribute_set": {"search": {"message": {"id": {"_description": {"info": "short", "usage": "x", "owner": "BAP", "type": "string", "required": True}}}}}}],
    "x-flows": [{"type": "playground", "id": "f", "usecase": "u", "description": "d", "tags": [], "config": {"steps": [{"api": "search", "mock": {"generate": CODE, "saveData": {"k": "$.message.id"}}, "examples": [{"payload": {"message": {"id": "7", "name": "n"}}}]}]}}],
}


@pytest.fixture
def build(tmp_path):
    folder = tmp_path / "builds" / "D" / "1"
    folder.mkdir(parents=True)
    (folder / "build.yaml").write_text(json.dumps(BUILD))
    return str(folder / "build.yaml")


def lines(spark, path):
    return [json.loads(r.value) for r in spark.read.text(str(path)).collect()]


def test_commands(spark, build, tmp_path):
    out = lambda name: str(tmp_path / name)
    assert main(["validate", build]) == 0
    for name in ("facts", "flows", "observe", "gaps", "mine"):
        assert main([name, build, out(name)]) == 0
    assert lines(spark, out("facts"))[0]["n_flows"] == 1 and lines(spark, out("flows"))[0]["actions"] == ["search"]
    assert {r["path_key"] for r in lines(spark, out("observe"))} == {"message", "message.id", "message.name"}
    assert {r["path_key"]: r["reason"] for r in lines(spark, out("gaps"))} == {"message.id": "incomplete_existing_leaf", "message.name": "no_existing_leaf"}
    mined = {r["path_key"]: r for r in lines(spark, out("mine"))}
    assert [r["kind"] for r in mined["message.id"]["refs"]] == ["generate", "comment"] and mined["message.id"]["save_data"][0]["key"] == "k" and "refs" not in mined["message.name"]
    (tmp_path / "drafts.json").write_text(json.dumps({"use_case": "u", "path": "search.message.name", "leaf": "{}", "score": 0.9}) + "\n" + json.dumps({"use_case": "u", "path": "search.x", "leaf": "{}", "score": 0.2}))
    main(["enrich", build, str(tmp_path / "drafts.json"), out("enriched")])
    assert {r["path"]: "leaf" in r for r in lines(spark, out("enriched"))} == {"search.message.id": True, "search.message.name": True}
    main(["format-all", str(tmp_path / "builds"), out("formatted")])
    assert lines(spark, f"{out('formatted')}/flows")[0]["file"] == "flows/f.json" and lines(spark, f"{out('formatted')}/docs")[0]["page"] == "# G"
    (tmp_path / "rows.json").write_text("\n".join(json.dumps({"domain": "D", "version": "1", "action": a, "rows": "[]"}) for a in ("search", "select")))
    main(["validation-table", str(tmp_path / "rows.json"), out("store")])
    assert spark.read.parquet(f"{out('store')}/validation_table").count() == 2
    assert len(COMMANDS) == 16


def test_whole_builds_are_converted(spark, tmp_path):
    old = {"info": {"domain": "D"}, "list": [1, "a"], "x-attributes": {"search": {"item": {"required": "yes", "usage": "u", "description": "an item"}, 'a "b"': {"required": "no"}}}, "x-enum": {"search": {"item": [{"code": "A", "description": "x"}]}}}
    docs = spark.createDataFrame([("1", json.dumps(old)), ("2", json.dumps({"info": {}}))], "build string, doc string")
    got = {r.build: json.loads(r.doc) for r in convert.convert_build(docs).collect()}
    assert got["2"] == {"info": {}} and got["1"]["list"] == [1, "a"] and "x-enum" not in got["1"]
    tree = got["1"]["x-attributes"][0]["attribute_set"]
    assert tree["search"]["item"]["_description"]["type"] == "enum" and tree["search"]["item"]["_description"]["enums"][0]["code"] == "A"
    assert tree["search"]["_description"] == {"required": False, "usage": "--", "info": "<placeholder description>", "owner": "BAP", "type": "object"}
    assert tree["search"]['a "b"']["_description"]["required"] is False
    assert convert.build_trees(spark.createDataFrame([], "build string, path array<string>, leaf string")).count() == 0


def test_public_names():
    for name in treeloom.__all__:
        assert getattr(treeloom, name) is not None
    with pytest.raises(AttributeError):
        treeloom.nothing  # noqa: B018


def test_settings_are_bounded():
    assert [rules.threshold_of(x) for x in (None, "0.6", "2", "-1", "x", "0")] == [0.8, 0.6, 0.8, 0.8, 0.8, 0.0]
    assert [rules.concurrency_of(x) for x in (None, "3", "0", "900", "x", "2.9")] == [8, 3, 8, 64, 8, 2]


def test_first_of_an_order(spark):
    rows = spark.range(5)
    assert [r.id for r in ordering.first_n(rows, [F.desc("id")], 2).collect()] == [4, 3]
    assert ordering.first_n(rows, ["id"], 0).count() == ordering.first_n(rows, ["id"], None).count() == 5


def test_yaml_and_broken_metadata(spark, tmp_path):
    import yaml

    doc = {"z": 1, "a": ["ü", {"b": None}]}
    sinks.write_yaml(spark.createDataFrame([("one", json.dumps(doc))], "build string, doc string"), f"{tmp_path}/yaml")
    text = spark.read.text(f"{tmp_path}/yaml", wholetext=True).first().value
    assert yaml.safe_load(text) == doc and text.index("z:") < text.index("a:")
    flows_ = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "id string")
    meta = spark.createDataFrame([("f1", '{"title": "t"}'), ("f2", "{broken")], "id string, raw string")
    got = documents.with_metadata(flows_, meta, "id", {"title": F.lit("none"), "tag": F.lit("x")}, json="raw")
    assert {r.id: (r.title, r.tag) for r in got.collect()} == {"f1": ("t", "x"), "f2": ("none", "x"), "f3": ("none", "x")}
