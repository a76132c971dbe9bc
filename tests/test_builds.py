"""Change logs, ingest, checks and rendering of a pair of builds."""

import copy
import json

import pytest

from treeloom.operators import diff as D
from treeloom.operators import profile as P
from treeloom.operators import validate as V
from treeloom.operators.store import Store
from treeloom.plans import builds as B
from treeloom.plans import convert, polish, render


def leaf(info):
    return {"required": True, "usage": "u", "info": info, "owner": "BAP", "type": "string"}


def config(**more):
    return {"meta": {}, "transaction_history": [], "steps": [], **more}


BASE = {
    "openapi": "3.0.0",
    "info": {"title": "T", "domain": "D", "description": "d", "version": "1.0.0", "x-usecases": ["uc-alpha", "uc-beta"], "x-branch-name": "b", "x-reporting": False},
    "paths": {"/search": {"post": {"description": "s"}}, "/select": {"post": {"description": "s"}}},
    "components": {"schemas": {"Item": {"id": 1}}},
    "x-flows": [
        {"type": "p", "id": "flow-1", "usecase": "uc-alpha", "tags": ["a", "b"], "description": "one", "config": config()},
        {"type": "p", "id": "flow-2", "usecase": "uc-beta", "tags": [], "description": "two", "config": config()},
    ],
    "x-attributes": [{"meta": {"use_case_id": u}, "attribute_set": {"search": {"context": {"_description": leaf(u)}}}} for u in ("uc-alpha", "uc-beta")],
    "x-validations": {"rules": [1, 2]},
    "x-errorcodes": {"code": [{"Event": "e", "Description": "d", "From": "f", "code": 40001}, {"Event": "e2", "Description": "d2", "From": "f", "code": 40002}]},
    "x-supported-actions": {"supportedActions": {"search": ["select"], "select": []}, "apiProperties": {"search": {"async_predecessor": None, "transaction_partner": []}}},
    "x-docs": {"overview": "# O", "release-notes": "r"},
}


def updated():
    new = copy.deepcopy(BASE)
    new["info"].update({"version": "1.1.0", "x-reporting": True, "x-usecases": ["uc-alpha", "uc-beta", "uc-gamma"]})
    new["x-flows"] = [dict(new["x-flows"][0], description="changed", tags=["a", "b", "v2"]), {"type": "p", "id": "flow-3", "usecase": "uc-gamma", "tags": [], "description": "three", "config": config()}]
    new["x-errorcodes"]["code"] = [{"Event": "e", "Description": "changed", "From": "f", "code": 40001}, {"Event": "e3", "Description": "d3", "From": "f", "code": 40003}]
    new["x-supported-actions"]["supportedActions"]["confirm"] = []
    new["x-supported-actions"]["apiProperties"]["confirm"] = {"async_predecessor": "search", "transaction_partner": []}
    new["x-docs"] = {"overview": "# O2", "api-guide": "g"}
    return new


@pytest.fixture
def frame(spark):
    return lambda *docs: spark.createDataFrame([(f"b{i}", json.dumps(d)) for i, d in enumerate(docs)], "build string, doc string")


def test_changelog_counts(frame):
    rows = B.changelog(frame(BASE), frame(updated())).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in rows} == {"info": 3, "flows": 4, "errors": 3, "actions": 2, "docs": 3}


def test_no_change_no_entries(frame):
    assert B.changelog(frame(BASE), frame(BASE)).count() == 0


def test_added_one_way_is_removed_the_other(frame):
    pick = lambda d, k: {(r.section, r.path) for r in d.collect() if r.kind == k}
    there, back = B.changelog(frame(BASE), frame(updated())), B.changelog(frame(updated()), frame(BASE))
    assert pick(there, "added") == pick(back, "removed")


def test_deep_diff_of_arrays_shapes_and_roots(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id int, j string")
    old = mk([(1, '{"a":{"b":[1,2]},"c":1,"x.y":{"z":1}}'), (2, "[1]"), (3, '{"a":{"b":1}}'), (4, '{"a":null}')])
    new = mk([(1, '{"a":{"b":[2,1]},"c":{"d":1},"x.y":{"z":2}}'), (2, "[2]"), (3, '{"a":2}'), (4, '{"a":null}')])
    got = {(r.id, tuple(r.path), r.kind) for r in D.deep_diff(old, new, ["id"], "j").collect()}
    assert got == {(1, ("a", "b"), "modified"), (1, ("c",), "modified"), (1, ("x.y", "z"), "modified"), (2, (), "modified"), (3, ("a",), "modified")}


def test_section_cap(spark):
    old, new = spark.createDataFrame([("x", "{}")], "build string, v string"), spark.createDataFrame([("x", json.dumps({f"k{i:03}": i for i in range(130)}))], "build string, v string")
    entries = D.deep_diff(old, new, ["build"], "v")
    top = D.cap_sections(entries, ["build"], ["path"]).collect()
    assert len(top) == 100 and top[0].total_changes == 130 and top[0].truncated and top[0].truncated_count == 30


def test_checks(frame):
    bad = copy.deepcopy(BASE)
    bad["x-flows"][1]["usecase"] = "nope"
    bad["x-attributes"].append({"meta": {}, "attribute_set": {}})
    broken = copy.deepcopy(BASE)
    broken["openapi"] = "2.0"
    del broken["info"]["domain"], broken["x-flows"][0]["id"]
    broken["x-errorcodes"]["code"] = {}
    got = {(r.build, r.check): [i.path for i in (r.issues or [])] for r in V.run_checks(frame(BASE, bad, broken)).collect()}
    assert got[("b0", "schema")] == got[("b0", "usecases")] == []
    assert got[("b1", "usecases")] == ["x-flows[1].usecase"]
    assert got[("b2", "schema")] == ["info.domain", "openapi", "x-errorcodes.code", "x-flows[0].id"]


def test_ingest_lifecycle(spark, frame, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.ingest(frame(BASE))
    assert (first["skipped"], first["changes"], first["docs"], first["flows"], first["attributes"], first["validations"]) == (False, 0, 2, 2, 2, 1)
    assert store.ingest(frame(BASE))["skipped"]
    new = copy.deepcopy(BASE)
    new["x-flows"] = [dict(new["x-flows"][0], id="flow-9")]
    new["x-docs"] = {"overview": "# O"}
    second = store.ingest(frame(new))
    assert second["changes"] > 0 and second["docs"] == 1
    assert {r.id for r in store.read("flows", "D", "1.0.0").collect()} == {"flow-9", "flow-2"}  # flow-2's use case is gone as a whole


def test_profile_of_payloads(spark):
    rows = spark.createDataFrame([(1, "f1", '{"a":{"b":"x"},"l":[{"c":1},{"c":2}]}'), (2, "f2", '{"a":{"b":"y"},"l":[{"c":2}]}')], "ord int, flow string, j string")
    obs = P.observations(rows, ["ord", "flow"], "j")
    got = {r.path_key: r for r in P.leaf_profile(obs, ["path_key"], "value", "flow", "ord", "kind", "in_array").collect()}
    assert got["a.b"].samples == ['"x"', '"y"'] and got["a.b"].n_flows == 2 and not got["a.b"].is_array_indexed
    assert got["l.c"].is_array_indexed and got["l.c"].n_values == 3 and got["a"].value_type == "object" and not got["a"].is_leaf


def test_pages(frame):
    b = frame(BASE)
    assert "| 40001 | e | d | f |" in render.error_page(B.error_codes(b)).first().page
    assert "Flows: 2" in render.index_page(B.facts(b), B.docs(b)).first().page
    assert "context._description" in render.attribute_page(B.leaves(B.attribute_sets(b))).first().page


def test_convert_overlays_trees(spark):
    old = {"x-attributes": {"search": {"context": {"city": {"required": "mandatory", "description": "City of the request", "usage": "std:080", "type": "string"}, "ttl": {"required": "Optional"}}}}, "x-enum": {"search": {"context": {"city": [{"code": "std:080", "description": "d"}]}}}}
    got = {".".join(r.path): json.loads(r.leaf) for r in convert.convert_attributes(spark.createDataFrame([("b", json.dumps(old))], "build string, doc string")).collect()}
    assert got["search.context.city"]["type"] == "enum" and got["search.context.city"]["required"] is True
    assert got["search.context.ttl"]["info"] == convert.NO_INFO and got["search.context.ttl"]["required"] is False


def test_drafts_are_retried_and_shared(spark):
    groups = spark.createDataFrame([("s1", "p1"), ("s2", "bad")], "representative string, prompt string")

    def complete(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    got = {r.representative: (r.draft, r.error) for r in polish.draft(groups, "prompt", complete).collect()}
    assert got == {"s1": ("P1", None), "s2": (polish.NO_DATA, "no")}
