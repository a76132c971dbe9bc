"""Scripts, deep documents, patterns, nearest names and snapshots."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from treeloom.functions import code, nested
from treeloom.functions.script import Bad, parse
from treeloom.operators import cut, trie
from treeloom.operators import diff as D
from treeloom.operators import match as M
from treeloom.operators.matcher import contained
from treeloom.operators.store import Conflict, Store

from .test_builds import BASE

# scripts -----------------------------------------------------------------------------------------


def seen(src):
    return [(".".join(path), role[0], gate, key) for path, role, gate, key, _ in code.scan(src)]


@pytest.mark.parametrize(
    "src, want",
    [
        ("const re = /a\\/[/]b/g.test(x.y); `q ${m.n} ${`${z.w}`} /`", [("y", "r", None, None), ("n", "r", None, None), ("w", "r", None, None)]),
        ("return a.b / c.d / 2", [("b", "r", None, None), ("d", "r", None, None)]),
        ("x = {a, b: c.d, ...e.f, get g() { return h.i }, async *j() { yield k.l }, ['m' + n.o]: 1}", [(x, "r", None, None) for x in "dfilo"]),
        ("class A extends B.C { #p = 1; static q = r.s; t() { return this.#p + u.v } }", [("C", "r", None, None), ("s", "r", None, None), ("v", "r", None, None)]),
        ("(a, {b = 1}, ...c) => ({c: a.d}); async (x) => x.y; async z => z.w; () => {}", [(x, "r", None, None) for x in "dyw"]),
        ("const p = a.b\nconst q = p.c\nq.d", [("b", "r", None, None), ("b.c", "r", None, None), ("b.c.d", "r", None, None)]),
        ("if (x) { const f = () => { a.b.c = typeof d.e } }", [("b.c", "w", "x", None), ("e", "r", None, None)]),
        ("if (a) { if (!b) { c.d = 1 } e.f = a ? (g.h = 1) : 2 }", [("d", "w", "! b", None), ("f", "w", "a", None), ("h", "w", "a", None)]),
        ("delete a.b; delete a?.c; a.b++", [("b", "d", None, None), ("c", "d", None, None), ("c", "r", None, None), ("b", "r", None, None)]),
        ("list.a.find(({id}) => id.x); list.b.find(function (it) { return it.y }); it.z", [("a.find", "r", None, None), ("x", "r", None, None), ("b.find", "r", None, None), ("b.[*].y", "r", None, None), ("z", "r", None, None)]),
        ("for (const k in o.p) {} do { a.b } while (c.d); label: for (;;) { break label }", [("p", "r", None, None), ("b", "r", None, None), ("d", "r", None, None)]),
        ("switch (a.b) { case c.d: e.f(); default: try { g.h } catch { i.j } finally { k.l } }", [(x, "r", None, None) for x in "bdfhjl"]),
        ("new Foo.Bar(a.b).baz.q; new.target; (a.b, c).d; import('x').y", [("Bar", "r", None, None), ("b", "r", None, None), ("b", "r", None, None)]),
        ("a.b = ", []),
        ("if (", []),
        ("", []),
        (None, []),
    ],
)
def test_accesses(src, want):
    assert seen(src) == want


def test_conditions_are_short_and_near():
    long = " || ".join(f"name{k}.value" for k in range(40))
    (gate,) = {r[2] for r in seen(f"if ({long}) a.b = 1") if r[1] == "w"}
    assert len(gate) == 160 and gate.endswith("…")
    assert seen("if (f([x])) a.b = 1")[0][2] == "f(…)" and seen("if (`t`) { a.b = 1 }")[0][2] is None


def test_scripts_may_be_long_and_nested():
    assert len(code.scan("x.y = a.b;\n" * 3000)) == 6000 and code.scan("x.y = a.b;\n" * 3000)[-1][4] == 3000
    assert len(code.scan("a.b" + " + a.b" * 5000)) == 5001 and len(code.scan("(" * 800 + "a.b" + ")" * 800)) == 1
    with pytest.raises(Bad):
        parse("a b c @")


def test_each_source_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, "o.a = 1"), (2, "o.a = 1"), (3, "x["), (4, None), (5, "")], "id int, src string")
    got = code.access_table(rows)
    assert sorted((r.id, r.path, r.role, r.place) for r in got.collect()) == [(1, ["a"], "write", 0), (2, ["a"], "write", 0)]
    assert got.columns == ["id", "src", "path", "role", "gate", "session_key", "line", "place"]


def test_sources_that_differ_in_words_only_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(code, "parse", lambda src: parsed.append(src) or parse(src))
    own = code.Templates()
    for k in range(10, 60):
        t = own.of(f"o.f{k} = 'x{k} y'; g{k}.h[{k}]; const {{ a: z1 }} = p.q{k}; z1.b")
        assert t.paths == [f"f{k}", "h", str(k), f"q{k}", f"q{k}", "a", "b"] and t.sizes == [1, 2, 1, 3]
    assert len(parsed) == 1


def test_templates_give_what_a_scan_does():
    rng = random.Random(5)
    base = """o.a5.b["c d7"].e[0] = x12[h.g9.w].y|if (s1.a2 === 'k9 x5' && d[12] > 7) { q5.r5 = 3 }|const o1 = payload.m12.n; o1.id; o12.id|const {a1: b2, b2: a1} = z9; a1.c; b2.c|for (const t5 of o3.list) { t5.f; t4.f }
sessionData.key44.list = session['k5 z'].x|a[1e3].b[2024] = c[10]|1 .b5; x[5] . b6|x ? (a5.b = 1) : (a6.b = 2)|if (v10 + v11 * w12345678901234567890 + v10 + v11 * w12345678901234567890 + v10 + v11 * w12345678901234567890 + v10 + v11 * w1234567890123456789 + v12345678) a.b = 1
a['q\\x41b5'].c|delete u5.v6; u6?.v5|a[05].b; a[5].c|a.b3[`x5`].c; `${p5.q6}`|o5.map(i7 => i7.price); o5.reduce((s1, x1) => s1.h + x1.j, 0)|é5.x6; _9.b; $1.c2|/* c5.d */ x1.y|if ( 12 |a[12345678901234567].b; a[123456789012345].c
if (2 /*c*/ .b5 > 1) a.b = 2|a.b > 3.14 ? c.d5 = 1 : 0|class K5 { #p1 = a5.b; m2() { return this.#p1 + K5.q } }|a[0 .x]; '2024-01-05'.x; o["1.5 x.7 7.x"]""".replace("\n", "|").split("|")
    own = code.Templates()
    for _ in range(3000):
        src = "; ".join(rng.choice(base) for _ in range(rng.randint(1, 3)))
        src = re.sub(r"(?<!\de)\d+", lambda m: m[0] if rng.random() < 0.4 else str(rng.randrange(10 ** rng.choice([1, 1, 2, 3]))), src)
        t, at, got = own.of(src), 0, []
        for size, *rest in zip(t.sizes, t.roles, t.gates, t.keys, t.lines, strict=True):
            got.append((t.paths[at : at + size], *rest))
            at += size
        assert got == code.scan(src), src


# deep documents ----------------------------------------------------------------------------------


def test_canonical_texts_are_the_readers(spark):
    texts = ["[1.50, 1e10, 0.1, 100, 1E2, -0.0, 1e-7, 3.0, 123456789012345678901234567890123456789012]", '{"b":[1,{"c":null}],"a":"x\\u00e9\\n","é":true}', ' "t" ', "[]", "{}", "[1,]", '{"a":1,"a":2}', '{"a"}', "7 8", "", "[tru]", '{"a":[}', "-", "[01]"]
    known = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(F.to_json(F.try_parse_json("t"))).collect()]
    assert [(v := nested.parse(t)) and v[0].canon for t in texts] == known


def test_nodes_of_deep_documents(spark):
    levels, wide = 3000, 4000
    deep = '{"a":' * levels + '{"x":[1.50,{"y":[2,3]}],"z":"s"}' + "}" * levels
    flat = json.dumps({"a": {f"k{i:04}": i for i in range(wide)}})
    table = spark.createDataFrame([("deep", deep), ("flat", flat), ("bad", "{"), ("none", None), ("longbad", "[" * 5000)], "id string, j string")
    rows = D.shred(table, ["id"], "j", arrays=True, beyond_reader=True)
    got = {r.id: r.n for r in rows.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {"deep": levels + 8, "flat": wide + 2}
    leaf = rows.where("id = 'deep' and try_element_at(path, -1) = 'y' and not shape like 'ARRAY%'").orderBy("place").collect()
    assert [(r.canon, r.place, r.depth, len(r.path)) for r in leaf] == [("2", [1, 0], levels + 4, levels + 2), ("3", [1, 1], levels + 4, levels + 2)]
    middling = spark.createDataFrame([("m", '{"a":' * 150 + "1" + "}" * 150)], "id string, j string")
    assert D.shred(middling, ["id"], "j").count() == 151


def test_differences_of_deep_documents(spark):
    wrap = lambda inner, n=2000: '{"a":' * n + inner + "}" * n
    old = spark.createDataFrame([("d", wrap('{"x":1,"y":[1],"w":{"v":1}}')), ("s", '{"x":1}'), ("g", "[" * 1500 + "]" * 1500), ("b", "[")], "id string, j string")
    new = spark.createDataFrame([("d", wrap('{"x":2,"y":[1],"w":3,"n":null}')), ("s", '{"x":2}'), ("g", "{}"), ("b", "[")], "id string, j string")
    got = {(r.id, ".".join(r.path[2000:] if r.id == "d" else r.path), r.kind, r.before, r.after) for r in D.deep_diff(old, new, ["id"], "j", beyond_reader=True).collect()}
    assert {g[:3] for g in got} == {("d", "x", "modified"), ("d", "w", "modified"), ("d", "n", "added"), ("s", "x", "modified"), ("g", "", "modified")}
    assert ("d", "x", "modified", "1", "2") in got


# patterns and names ------------------------------------------------------------------------------


@pytest.mark.parametrize("slot_bytes", [1 << 20, 1])
def test_contained_patterns(spark, slot_bytes):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé.") for _ in range(n))
    texts = [(g, word(rng.randint(0, 30))) for g in ("x", "y", None) for _ in range(30)] + [("x", None), ("z", "abc")]
    patterns = [(g, word(rng.randint(0, 4))) for g in ("x", "y", None, "w") for _ in range(20)] + [("x", None)]
    got = contained(spark.createDataFrame(texts, "g string, t string"), spark.createDataFrame(patterns, "g string, p string"), ["g"], "t", "p", slot_bytes).collect()
    want = {(g, t, p) for g, t in texts for h, p in patterns if g == h and t and p and p in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_names_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(M, "DICTIONARY_ROWS", 40)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))
    words, names = [word(9) for _ in range(250)], [word(13) for _ in range(120)] + [None, "", "zzzzzzzzzzzzzzzzzzzzzz"]
    table = spark.createDataFrame([*enumerate(words), (999, None)], "o int, w string")
    got = {r.i: (r.nearest, r.distance) for r in M.nearest_name(spark.createDataFrame([*enumerate(names)], "i int, n string"), "n", table, "w", "o").collect()}
    best = lambda x: min((edits(x, w), k, w) for k, w in enumerate(words))
    assert got == {i: (None, None) if x is None else (best(x)[2], best(x)[0]) for i, x in enumerate(names)}
    assert [r.nearest for r in M.nearest_name(spark.createDataFrame([("a",)], "n string"), "n", table.limit(0), "w", "o").collect()] == [None]


@pytest.mark.parametrize("m, n", [(0, 2), (3, 3), (4, 2), (2, 4), (5, 5)])
@pytest.mark.parametrize("bound", [1, 2, 3])
def test_near_strings_are_equal_without_some_letters(m, n, bound):
    from itertools import combinations, product

    without = lambda text, out: set(combinations(text, len(text) - out))
    if abs(m - n) <= bound:
        x, y = M._left_out(m, n, bound)
        for a, b in product(product("ab", repeat=m), product("ab", repeat=n)):
            assert edits(a, b) > bound or without(a, x) & without(b, y)


def test_words_with_a_common_beginning_make_no_product(spark, monkeypatch):
    made, own = [], M._by_letters
    monkeypatch.setattr(M, "_by_letters", lambda *a: made.append(own(*a)) or made[-1])
    words = spark.range(20_000).selectExpr("id", "concat('Customer#', lpad(id, 9, '0')) AS w")
    names = spark.range(300).selectExpr("id AS i", "concat('Customer#', lpad(id * 37, 9, '0'), CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'yz' END) AS n")
    assert M.nearest_name(names, "n", words, "w", "id").where("nearest <> substr(n, 1, 18) or distance <> i % 3").count() == 0
    assert 0 < made[0].count() < 100_000


def test_a_large_dictionary_is_searched_by_parts(spark):
    words = spark.range(60_000).selectExpr("id", "concat(hex(id * 2654435761), '-', id % 97) AS w")
    names = words.where("id % 6000 = 5").selectExpr("id AS i", "concat(substr(w, 1, 3), '#', substr(w, 4)) AS n")
    assert M.DICTIONARY_ROWS < 60_000
    assert all(r.distance == 1 for r in M.nearest_name(names, "n", words, "w", "id").collect())


@pytest.mark.parametrize("cells", [40, trie.CELLS])
@pytest.mark.parametrize("letters", ["ab", "abcdé😀"])
def test_names_go_down_a_trie(monkeypatch, cells, letters):
    monkeypatch.setattr(trie, "CELLS", cells)
    rng = random.Random(cells)
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    words, names = list({word(9) for _ in range(60)}), [word(13) for _ in range(40)] + ["", "zzzzzzzzzzzzzzzzzzzzzz"]
    rank = rng.sample(range(len(words)), len(words))
    tree, best = trie.Trie(words, rank), [min((edits(n, w), rank[k], k) for k, w in enumerate(words)) for n in names]
    distance, at = tree.nearest(names)
    assert [(d, k) for d, k in zip(distance, at, strict=True)] == [(b[0], b[2]) for b in best]
    for bound in (0, 2, 6):
        distance, at = tree.within(names, bound)
        assert [k for k in at] == [b[2] if b[0] <= bound else -1 for b in best]
    assert list(trie.Trie([], []).nearest(["a"])[1]) == [-1]


def test_names_meet_all_blocks_of_a_dictionary(spark, monkeypatch):
    for k, v in (("DICTIONARY_ROWS", 40), ("TRIE_WORDS", 30), ("NEAR", (0,)), ("TRIE_NAMES", (20, 50))):
        monkeypatch.setattr(M, k, v)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))
    words, names = [word(9) for _ in range(250)], [word(13) for _ in range(120)] + ["", "zzzzzzzzzzzzzzzzzzzzzz"]
    table = spark.createDataFrame([(f"o{k:03d}", w) for k, w in enumerate(words)], "o string, w string")
    got = {r.i: (r.nearest, r.distance) for r in M.nearest_name(spark.createDataFrame([*enumerate(names)], "i int, n string"), "n", table, "w", "o").collect()}
    best = lambda x: min((edits(x, w), k, w) for k, w in enumerate(words))
    assert got == {i: (best(x)[2], best(x)[0]) for i, x in enumerate(names)}


def test_far_names_make_few_rows_and_no_broadcast(spark, monkeypatch):
    made, own = [], M._by_letters
    monkeypatch.setattr(M, "_by_letters", lambda *a: made.append(own(*a)) or made[-1])
    words = spark.range(12_000).selectExpr("id", "concat('Customer#', lpad(id, 9, '0')) AS w")
    names = spark.range(600).selectExpr("id AS i", "concat('Customer#', lpad(90000 + id * 37, 9, '0'), repeat('x', id % 3)) AS n")
    got = M.nearest_name(names, "n", words, "w", "id").collect()
    assert all(r.distance == edits(r.n, r.nearest) and r.i % 3 < r.distance < 7 for r in got) and len(got) == 600
    assert all("broadcast" not in df._jdf.queryExecution().analyzed().toString().lower() and df.count() < 60_000 for df in made)


# snapshots ---------------------------------------------------------------------------------------


def builds(spark, *docs):
    return spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "ord int, doc string")


def version(k, **more):
    b = copy.deepcopy(BASE)
    b["info"]["version"] = f"{k}.0"
    return {**b, **more}


def state(store):
    return {name: sorted(map(str, store.table(name).drop("updated_at", "row").collect())) for name in ("meta", *Store.TABLES)}


def test_many_builds_at_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    nameless = copy.deepcopy(BASE)
    del nameless["info"]["domain"]
    told = store.ingest_many(builds(spark, *(version(k) for k in range(12)), version(3, **{"x-docs": {}}), nameless)).collect()
    assert sorted(r.status for r in told) == ["ingested"] * 12 + ["rejected", "replaced"]
    assert store.table("flows").count() == 24 and store.read("docs", "D", "3.0").count() == 0 and store.read("docs", "D", "4.0").count() == 2
    assert {r.version for r in store.heads().collect()} == {f"{k}.0" for k in range(12)}  # versions stay text
    told = {r.version: (r.status, r.changes) for r in store.ingest_many(builds(spark, version(4), version(5, **{"x-docs": {"overview": "# new"}, "x-errorcodes": {"code": []}}))).collect()}
    assert told["4.0"] == ("skipped", 0) and told["5.0"][0] == "ingested" and told["5.0"][1] > 0
    assert store.snapshot()["number"] == 2 and store.table("changelogs").count() == told["5.0"][1]
    assert {r.status for r in store.ingest_many(builds(spark, version(4), version(6))).collect()} == {"skipped"} and store.snapshot()["number"] == 2
    store.ingest_many(builds(spark, *(version(k, **{"x-docs": {}}) for k in range(12))))
    before = state(store)  # the first two commits have no head any more
    assert store.vacuum() > 0 and state(store) == before and store.vacuum() == 0


def test_a_broken_ingest_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest_many(builds(spark, version(1), version(2)))
    before, write = state(store), Store._write

    def broken(self, name, rows, commit):
        if name == "attributes":  # docs and flows are written by then
            raise OSError("lost")
        return write(self, name, rows, commit)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        store.ingest_many(builds(spark, version(1, **{"x-docs": {}, "x-flows": []}), version(3)))
    assert state(store) == before and store.heads().count() == 2
    monkeypatch.undo()
    assert {r.status for r in store.ingest_many(builds(spark, version(3))).collect()} == {"ingested"}


def test_two_writers(spark, tmp_path, monkeypatch):
    store, other = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    commit = Store._commit

    def late(self, *args):
        monkeypatch.undo()
        other.ingest_many(builds(spark, version(2)))
        commit(self, *args)

    monkeypatch.setattr(Store, "_commit", late)
    with pytest.raises(Conflict):
        store.ingest_many(builds(spark, version(1)))
    assert [r.version for r in store.heads().collect()] == ["2.0"]
    store.ingest_many(builds(spark, version(1)))
    assert {r.version for r in store.heads().collect()} == {"1.0", "2.0"}


def test_work_folders_are_listed_and_removed(spark):
    path = (df := cut.written(spark.range(3), "listed")).inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and any(path.endswith(p.rsplit("/", 1)[1]) for p in cut.CREATED)
    own = cut.CREATED[-1]
    cut.remove(spark, own)
    assert own not in cut.CREATED


def test_flows_beside_documents_are_ingested_like_those_in_them(spark, tmp_path):
    stores = [Store(spark, str(tmp_path / x)) for x in ("in", "beside")]
    builds = [{"a": [("f1", "u", "x"), ("f2", "u", "y"), ("f2", "u", "z")], "b": [("g", "v", "1")]}, {"a": [("f1", "u", "w"), ("f3", "t", "y")], "b": [("g", "v", "1")], "c": []}]
    for k, own in enumerate(builds):
        flow = lambda f: {"id": f[0], "usecase": f[1], "description": f[2]}
        doc = lambda d, more: json.dumps({"info": {"domain": d, "version": "1"}} | more)
        whole = spark.createDataFrame([(doc(d, {"x-flows": [flow(f) for f in fs]}),) for d, fs in own.items()], "doc string")
        docs = spark.createDataFrame([(doc(d, {}),) for d in own], "doc string")
        rows = spark.createDataFrame([(d, "1", i, json.dumps(flow(f))) for d, fs in own.items() for i, f in enumerate(fs)], "domain string, version string, ord int, flow string")
        told = [sorted((r.domain, r.status, r.changes) for r in t.collect()) for t in (stores[0].ingest_many(whole, ("flows",)), stores[1].ingest_many(docs, ("flows",), flows=rows))]
        assert told[0] == told[1] and (k != 1 or ("b", "skipped", 0) in told[1])
        for name in ("flows", "changelogs")[: 1 + (k > 0)]:
            columns = ["domain", "usecase", "id", "description"] if name == "flows" else ["domain", "section", "kind", "path", "summary"]
            assert len({str(sorted(map(str, s.table(name).select(*columns).collect()))) for s in stores}) == 1
