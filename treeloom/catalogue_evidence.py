"""Queries for names and rules, evidence of attribute paths, orders of reports, and stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import rules as R
from .functions import text as T
from .operators import diff as D
from .operators import evidence as E
from .operators import match as M
from .operators import ordering as O  # noqa: E741
from .operators import profile as P
from .operators import store as S
from .plans import book, builds, mining


def _text(prefix: str, column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# names and rules --------------------------------------------------------------------------------

_NAMES = """n AS (SELECT p_partkey, w.x AS name FROM part, LATERAL (SELECT unnest(['CamelCase', 'HTTPServer' || p_partkey, 'item_id_' || p_partkey, replace(p_name, ' ', '_'), 'a__b_' || p_partkey || 'X', 'trailing_', 'mixed' || upper(substr(p_name, 1, 2)) || 'x']) AS x) w)"""
_SNAKE = r"lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1_\2', 'g'))"
_CAMEL = "list_aggregate(list_transform(string_split({0}, '_'), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[a-z0-9]') THEN upper(p[1:1]) || p[2:] ELSE '_' || p END), 'string_agg', '')"


def _names(spark, d):
    n, k = F.col("p_name"), F.col("p_partkey").cast("string")
    values = F.array(F.lit("CamelCase"), F.concat(F.lit("HTTPServer"), k), F.concat(F.lit("item_id_"), k), F.replace(n, F.lit(" "), F.lit("_")), F.concat(F.lit("a__b_"), k, F.lit("X")), F.lit("trailing_"), F.concat(F.lit("mixed"), F.upper(F.substring(n, 1, 2)), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", F.explode(values).alias("name"))


@query(f"""WITH {_NAMES}, f AS (SELECT p_partkey, name, {_SNAKE.format("name")} AS snake, {_CAMEL.format("name")} AS camel FROM n)
SELECT p_partkey, name, snake, camel, name || CASE WHEN snake <> name THEN ',' || snake ELSE '' END || CASE WHEN camel <> name AND camel <> snake THEN ',' || camel ELSE '' END AS variants FROM f""")
def case_forms(spark, d):
    n = F.col("name")
    return _names(spark, d).select("p_partkey", "name", T.camel_to_snake(n).alias("snake"), T.snake_to_camel(n).alias("camel"), F.array_join(T.case_variants(n), ",").alias("variants"))


_PATHS = """p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [x] WHEN p_partkey % 3 = 1 THEN ['orderItems', x] ELSE ['message', 'order_items', y, x] END AS path
FROM (SELECT p_partkey, lower(p_type) || '_id' AS x, 'lineNo' || p_size AS y FROM part))"""


def _paths(spark, d):
    x, y, k = F.concat(F.lower("p_type"), F.lit("_id")), _text("lineNo", "p_size"), F.col("p_partkey") % 3
    path = F.when(k == 0, F.array(x)).when(k == 1, F.array(F.lit("orderItems"), x)).otherwise(F.array(F.lit("message"), F.lit("order_items"), y, x))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


_ALL_SNAKE = f"list_transform(path, lambda s: {_SNAKE.format('s')})"
_ALL_CAMEL = f"list_transform(path, lambda s: {_CAMEL.format('s')})"


@query(f"""WITH {_PATHS}, t AS (SELECT p_partkey, [path[-1], array_to_string(path[-2:], '.'), array_to_string(path[-3:], '.'), {_CAMEL.format("path[-1]")}, {_SNAKE.format("path[-1]")},
array_to_string(({_ALL_CAMEL})[-2:], '.'), array_to_string(({_ALL_SNAKE})[-2:], '.')] AS x FROM p), u AS (SELECT p_partkey, unnest(x) AS t, unnest(range(7)) AS i FROM t),
f AS (SELECT p_partkey, t, min(i) AS i FROM u WHERE length(t) >= 3 GROUP BY ALL) SELECT p_partkey, string_agg(t, ',' ORDER BY i) AS tokens FROM f GROUP BY 1""")
def presence_tokens(spark, d):
    return _paths(spark, d).select("p_partkey", F.array_join(T.presence_tokens(F.col("path")), ",").alias("tokens"))


@query(f"""WITH {_PATHS}, v AS (SELECT p_partkey, unnest([path, {_ALL_SNAKE}, {_ALL_CAMEL}]) AS v FROM p), e AS (SELECT p_partkey, unnest([v, v[-3:]]) AS tail FROM v)
SELECT DISTINCT p_partkey, array_to_string(tail, '.') AS tail FROM e""")
def match_tails(spark, d):
    return _paths(spark, d).select("p_partkey", F.explode(T.match_tails(F.col("path"))).alias("t")).select("p_partkey", F.array_join("t", ".").alias("tail"))


@query(f"""WITH {_PATHS}, c AS (SELECT *, '// see ' || CASE p_partkey % 4 WHEN 0 THEN array_to_string(path, '.') WHEN 1 THEN array_to_string({_ALL_CAMEL}, '.') WHEN 2 THEN array_to_string(({_ALL_SNAKE})[-2:], '.') ELSE 'nothing' END AS note FROM p),
v AS (SELECT p_partkey, note, unnest([path, {_ALL_SNAKE}, {_ALL_CAMEL}]) AS v, unnest([0, 1, 2]) AS i FROM c),
m AS (SELECT p_partkey, array_to_string(v, '.') AS m, i * 2 AS r FROM v WHERE contains(note, array_to_string(v, '.')) UNION ALL SELECT p_partkey, array_to_string(v[-2:], '.'), i * 2 + 1 FROM v WHERE len(v) >= 2 AND contains(note, array_to_string(v[-2:], '.')))
SELECT p.p_partkey, arg_min(m, r) AS mention FROM p LEFT JOIN m ON p.p_partkey = m.p_partkey GROUP BY 1""")
def comment_mentions(spark, d):
    dot = lambda v: F.array_join(v, ".")
    camel, snake = F.transform("path", lambda s: T.snake_to_camel(s)), F.transform("path", lambda s: T.camel_to_snake(s))
    k = F.col("p_partkey") % 4
    note = F.concat(F.lit("// see "), F.when(k == 0, dot(F.col("path"))).when(k == 1, dot(camel)).when(k == 2, dot(F.slice(snake, -F.least(F.size("path"), F.lit(2)), 2))).otherwise("nothing"))
    return _paths(spark, d).select("p_partkey", T.comment_mention(note, F.col("path")).alias("mention"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) IN ('building') ELSE c_custkey % 4 = 1 END AS required, CASE WHEN c_custkey % 2 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS usage,
CASE WHEN c_custkey % 7 = 0 THEN 'enum' WHEN c_custkey % 2 = 0 THEN 'object' WHEN c_custkey % 3 = 0 THEN 'date-time' WHEN c_custkey % 5 = 0 THEN 'number' ELSE 'string' END AS type, c_custkey % 3 <> 2 AS stub FROM customer""")
def rule_functions(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    words = F.when(k % 4 == 0, F.when(F.lower("c_mktsegment") == "building", " YES ").otherwise("Not Required")).when(k % 4 == 1, "x").when(k % 4 == 2, "").otherwise(" No")
    leaf = k % 2 != 0
    text = F.when(k % 3 == 0, F.concat(F.lit("# T\nAdd an overview of the "), name, F.lit(" specification here."))).when(k % 3 == 1, "# A long heading that does not count\nshort").otherwise(F.concat(F.lit("# T\nThis tells in many words what it is about: "), name))
    kind = F.when(k % 5 == 0, "number").otherwise("null")
    return table(spark, d, "customer").select(
        "c_custkey", R.normal_required(words).alias("required"), R.usage_of(leaf, F.when(k % 3 == 0, name), F.array(F.lit(None).cast("string"), F.col("c_mktsegment"))).alias("usage"),
        R.type_of(k % 7 == 0, leaf, F.when(k % 3 == 0, "2024-01-31T10:00:00.5Z").otherwise(name), kind).alias("type"), R.overview_stub(text).alias("stub"),
    )


@query("""WITH d AS (SELECT doc_id, trim(text) AS t, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, 'length_depth' AS factor, 0.3::DOUBLE AS value FROM d WHERE length(t) >= 60 UNION ALL SELECT doc_id, 'length_basic', 0.2 FROM d WHERE length(t) >= 30 AND length(t) < 60
UNION ALL SELECT doc_id, 'word_count', 0.1 FROM d WHERE len(w) >= 10 UNION ALL SELECT doc_id, 'starts_cap', 0.05 FROM d WHERE regexp_matches(t, '^[A-Z]') UNION ALL SELECT doc_id, 'ends_punct', 0.05 FROM d WHERE regexp_matches(t, '[.!?]$')
UNION ALL SELECT doc_id, 'step_savedata', 0.15 FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'step_prev_session', 0.1 FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'step_owner_known', 0.1 FROM d WHERE doc_id % 7 <> 0)
SELECT doc_id, factor, value FROM f WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'error', 0 FROM d WHERE doc_id % 5 = 0""")
def description_factors(spark, d):
    k = F.col("doc_id")
    _, factors = R.description_score(F.col("text"), error=F.when(k % 5 == 0, "failed"), kind=F.lit("step"), saved_keys=1 - k % 2, prior_keys=(k % 3 == 0).cast("int"), owner=F.when(k % 7 == 0, "unknown").otherwise("BAP"), tags=F.lit(3), actions=F.lit(3))
    return table(spark, d, "documents").select("doc_id", F.explode(factors).alias("factor", "value"))


@query("""WITH c AS (SELECT c_custkey AS k, length(c_name) AS n FROM customer), f AS (SELECT k, 'openapi_description' AS factor, 0.25::DOUBLE AS value FROM c WHERE k % 2 = 0 UNION ALL SELECT k, 'openapi_custom_description', 0.15 FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'enums_carried_forward', 0.15 FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'tags_carried_forward', 0.15 FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'refs_strong', 0.2 FROM c WHERE k % 6 >= 3
UNION ALL SELECT k, 'refs_weak', least(0.15, (k % 6) * 0.05) FROM c WHERE k % 6 IN (1, 2) UNION ALL SELECT k, 'save_data', 0.1 FROM c WHERE k % 2 = 1 UNION ALL SELECT k, 'sample_variety', 0.1 FROM c WHERE k % 4 = 3
UNION ALL SELECT k, 'cross_flow_round_trip', 0.1 FROM c WHERE k % 8 = 0 UNION ALL SELECT k, 'cross_flow_persisted', 0.05 FROM c WHERE k % 9 = 0 UNION ALL SELECT k, 'info_depth', 0.1 FROM c WHERE n * (k % 10) >= 80 UNION ALL SELECT k, 'info_evidence_anchored', 0.05 FROM c WHERE k % 10 = 1),
s AS (SELECT c.k, coalesce(sum(value), 0) AS raw, coalesce(string_agg(factor, ',' ORDER BY factor), '') AS factors FROM c LEFT JOIN f USING (k) GROUP BY 1)
SELECT k AS c_custkey, CASE WHEN k % 11 = 0 THEN 0.0 ELSE round(least(raw, 1.0), 3) END::DOUBLE AS score, CASE WHEN k % 11 = 0 THEN 'fallback' ELSE factors END AS factors FROM s""")
def attribute_factors(spark, d):
    k = F.col("c_custkey")
    every = lambda n, r=0: k % n == r
    score, factors = R.attribute_score(
        openapi=every(2), custom=every(3), enums=every(5), tags=every(7), refs=k % 6, saved=every(2, 1), samples=k % 4, round_trip=every(8), persisted=every(9),
        info=F.repeat(F.col("c_name"), (k % 10).cast("int")), is_anchored=every(10, 1), fallback=every(11),
    )
    return table(spark, d, "customer").select("c_custkey", score.alias("score"), F.array_join(F.array_sort(F.map_keys(factors)), ",").alias("factors"))


#: Pages with a script behind them, so that there is something to find.
_SCRIPT = """html || 'get("a.b' || page_id || '[0].c"); use(''x.y''); // note ' || page_id || chr(10) || '/* block' || chr(10) || ' two */'"""


def _scripts(spark, d):
    k = F.col("page_id").cast("string")
    return table(spark, d, "pages").select("page_id", F.concat("html", F.lit('get("a.b'), k, F.lit("[0].c\"); use('x.y'); // note "), k, F.lit("\n/* block\n two */")).alias("src"))


@query(r"""SELECT page_id, p.i::BIGINT AS place, array_to_string(list_filter(list_transform(regexp_split_to_array(p.x, '\.|\[[^\]]*\]'), lambda t: trim(t)), lambda t: t <> ''), '/') AS path FROM
(SELECT page_id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS i FROM (SELECT page_id, list_filter(regexp_extract_all(src, '["'']([$\w][\w$.\[\]]{2,200})["'']', 1), lambda s: contains(s, '.') AND len(list_filter(regexp_split_to_array(s, '\.|\[[^\]]*\]'), lambda t: trim(t) <> '')) >= 2) AS f FROM (SELECT page_id, """ + _SCRIPT + r""" AS src FROM pages))) p""")
def quoted_paths(spark, d):
    return _scripts(spark, d).select("page_id", F.posexplode(T.quoted_paths(F.col("src"))).alias("place", "p")).select("page_id", F.col("place").cast("long").alias("place"), F.array_join("p", "/").alias("path"))


@query(r"""SELECT page_id, unnest(list_concat(regexp_extract_all(src, '//[^\n]*'), regexp_extract_all(src, '/\*[\s\S]*?\*/'))) AS comment FROM (SELECT page_id, """ + _SCRIPT + """ AS src FROM pages)""")
def comment_texts(spark, d):
    return _scripts(spark, d).select("page_id", F.explode(T.comments(F.col("src"))).alias("comment"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[A-Za-z_$][0-9A-Za-z_$]*')) AS name FROM pages""")
def identifier_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.identifiers(F.col("html"))).alias("name"))


# evidence ---------------------------------------------------------------------------------------

_SAVED = """s AS (SELECT s_suppkey, 'k' || s_suppkey AS key, 's' || (s_suppkey % 3) AS step, CASE s_suppkey % 4 WHEN 0 THEN ['message', 'order', 'itemId' || s_nationkey] WHEN 1 THEN ['message', 'order'] WHEN 2 THEN ['item_id' || s_nationkey] ELSE ['message'] END AS segs FROM supplier),
a AS (SELECT n_nationkey, ['message', 'order', 'item_id' || n_nationkey] AS path, 's' || (n_nationkey % 3) AS step FROM nation)"""


def _saved(spark, d):
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("$.message.order[0].itemId"), n)).when(k == 1, "$.message.order").when(k == 2, F.concat(F.lit("$.item_id"), n)).otherwise("$.message")
    s = table(spark, d, "supplier").select("s_suppkey", _text("k", "s_suppkey").alias("key"), _text("s", F.col("s_suppkey") % 3).alias("step"), path.alias("jsonpath"))
    a = table(spark, d, "nation").select("n_nationkey", F.array(F.lit("message"), F.lit("order"), _text("item_id", "n_nationkey")).alias("path"))
    return a, s


_DIRECT = r"""h AS (SELECT n_nationkey, s_suppkey FROM a JOIN s ON s.segs = a.path OR s.segs = list_transform(a.path, lambda x: regexp_replace(x, '_id', 'Id')))"""


@query(f"WITH {_SAVED}, {_DIRECT} SELECT n_nationkey, s_suppkey FROM h")
def persisted_keys(spark, d):
    a, s = _saved(spark, d)
    return E.persisted_join(a, "path", s, "jsonpath").select("n_nationkey", "s_suppkey")


@query(f"""WITH {_SAVED}, {_DIRECT} SELECT a.n_nationkey, s.s_suppkey FROM a JOIN s ON len(s.segs) < 3 AND a.path[1:len(s.segs)] = s.segs
WHERE NOT EXISTS (SELECT 1 FROM h JOIN s t ON h.s_suppkey = t.s_suppkey WHERE h.n_nationkey = a.n_nationkey AND t.step = s.step)""")
def inherited_keys(spark, d):
    """Ancestors' saved paths, but for paths which have a direct hit of the same step."""
    a, s = _saved(spark, d)
    direct = E.persisted_join(a, "path", s, "jsonpath")
    return E.inherited_join(a, "path", s, "jsonpath", direct, ["n_nationkey", "step"]).select("n_nationkey", "s_suppkey")


@query("""WITH a AS (SELECT n_nationkey, ['message', 'order', 'item' || n_nationkey] AS path FROM nation), r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'open' || c_custkey ELSE 'k' || (c_custkey % 40) END AS key, ['session', 'x', 'order', 'item' || c_nationkey] AS chain FROM customer),
p AS (SELECT 'k' || (s_suppkey % 40) AS key, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['message'] WHEN 1 THEN ['message', 'order', 'item' || s_nationkey] ELSE ['other'] END AS segs FROM supplier),
h AS (SELECT n_nationkey, c_custkey, s_suppkey FROM r JOIN p USING (key) JOIN a ON a.path[1:len(segs)] = segs UNION ALL SELECT n_nationkey, c_custkey, NULL FROM r JOIN a ON false WHERE key NOT IN (SELECT key FROM p)),
x AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey, s_suppkey) AS n FROM h) SELECT n_nationkey, c_custkey, s_suppkey FROM x WHERE n <= 4""")
def session_reads(spark, d):
    """Reads of saved keys that concern a path; the chains of unknown keys end in two segments of a path of three, which is no hit."""
    a = table(spark, d, "nation").select("n_nationkey", F.array(F.lit("message"), F.lit("order"), _text("item", "n_nationkey")).alias("path"))
    r = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, _text("open", "c_custkey")).otherwise(_text("k", F.col("c_custkey") % 40)).alias("key"), F.array(F.lit("session"), F.lit("x"), F.lit("order"), _text("item", "c_nationkey")).alias("chain"))
    k = F.col("s_suppkey") % 3
    p = table(spark, d, "supplier").select("s_suppkey", _text("k", F.col("s_suppkey") % 40).alias("pkey"), F.when(k == 0, F.array(F.lit("message"))).when(k == 1, F.array(F.lit("message"), F.lit("order"), _text("item", "s_nationkey"))).otherwise(F.array(F.lit("other"))).alias("segs"))
    return E.session_reads(r, "key", "chain", a, "path", ["n_nationkey"], p, "pkey", "segs", ["c_custkey", "s_suppkey"]).select("n_nationkey", "c_custkey", "s_suppkey")


@query("""WITH r AS (SELECT n_nationkey, c_custkey, ['order', 'item' || n_nationkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0), x AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS n FROM r)
SELECT n_nationkey, c_custkey FROM x WHERE n <= 4""")
def unknown_session_reads(spark, d):
    """Reads whose key no step saves concern the paths that their chain ends with."""
    a = table(spark, d, "nation").select("n_nationkey", F.array(F.lit("order"), _text("item", "n_nationkey")).alias("path"))
    r = table(spark, d, "customer").select("c_custkey", F.lit("lost").alias("key"), F.array(F.lit("session"), F.when(F.col("c_custkey") % 2 == 0, "order").otherwise("basket"), _text("item", "c_nationkey")).alias("chain"))
    p = table(spark, d, "supplier").select("s_suppkey", F.lit("saved").alias("pkey"), F.array(F.lit("order")).alias("segs"))
    return E.session_reads(r, "key", "chain", a, "path", ["n_nationkey"], p, "pkey", "segs", ["c_custkey"]).select("n_nationkey", "c_custkey")


@query("""WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 2, event_type ORDER BY event_id) AS n FROM events) SELECT event_id FROM k WHERE n <= CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 1000000 END""")
def capped_refs(spark, d):
    e = table(spark, d, "events").withColumn("step", F.col("event_id") % 2)
    return E.capped_refs(e, ["user_id"], ["step"], "event_type", ["event_id"], {"click": 2, "view": 1}).select("event_id")


@query("""SELECT p_partkey, min(p_partkey) OVER w AS representative, count(*) OVER w AS members FROM part WINDOW w AS (PARTITION BY p_type, p_size % 2, p_brand, p_partkey % 3, p_size % 3)""")
def attribute_groups(spark, d):
    """Parts as bundles: the path is the type; tails of saved paths count without what stands before them, kinds without order and repeats."""
    k = F.col("p_partkey")
    kinds = F.when(k % 3 == 0, F.array(F.lit("generate"), F.lit("alias"))).when(k % 3 == 1, F.array(F.lit("alias"), F.lit("alias"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_type").alias("path_key"), F.lit("string").alias("value_type"), (F.col("p_size") % 2 == 0).alias("is_leaf"), F.lit(None).cast("string").alias("schema"), F.array("p_brand").alias("enum_codes"), F.lit(None).cast("array<string>").alias("tag_codes"),
        F.when(k % 2 == 0, F.reverse(kinds)).otherwise(kinds).alias("ref_kinds"), F.array(F.concat(_text("$.a", "p_partkey"), F.lit(".b."), (F.col("p_size") % 3).cast("string"))).alias("jsonpaths"),
    )
    return E.attribute_groups(rows, "p_partkey").select("p_partkey", "representative", "members")


@query(r"""WITH w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[A-Za-z_$][0-9A-Za-z_$]*')) AS w FROM pages), k AS (SELECT DISTINCT w FROM w WHERE length(w) >= 4) SELECT w AS key, min(page_id) AS page_id FROM w JOIN k USING (w) GROUP BY 1""")
def alias_hits(spark, d):
    pages = table(spark, d, "pages")
    keys = pages.select(F.explode(T.identifiers(F.col("html"))).alias("key")).where("length(key) >= 4").distinct().withColumn("g", F.lit(1))
    return E.alias_hits(keys, "key", ["g"], pages, "html", ["page_id"]).select("key", "page_id")


def _mined(spark, d):
    """Builds whose steps write and check an attribute in scripts, save it, and read it back in another action."""
    s = table(spark, d, "supplier")
    encode = lambda c: F.base64(F.encode(c, "utf-8"))
    n = F.col("s_suppkey").cast("string")
    generate = F.concat(F.lit("// fills message.order.price\npayload.message.order.price = "), n, F.lit(";\npayload.message.order.price = 2;\nconst o = payload.message.order;\no.price = 3; o.price = 4; o.price = 5;"))
    validate = F.when(F.col("s_suppkey") % 2 == 0, "if (payload.message.order.price > 3) { check(payload.message.order.price); }").otherwise("")
    first = F.struct(F.lit("search").alias("api"), F.lit("a1").alias("action_id"), F.struct(encode(generate).alias("generate"), encode(validate).alias("validate"), F.create_map(F.when(F.col("s_suppkey") % 3 == 0, "whole").otherwise("price_key"), F.when(F.col("s_suppkey") % 3 == 0, "$.message").otherwise("$.message.order.price")).alias("saveData")).alias("mock"))
    second = F.struct(F.lit("on_search").alias("api"), F.lit("a2").alias("action_id"), F.struct(encode(F.lit("payload.x = sessionData.price_key;")).alias("generate"), encode(F.lit("")).alias("validate"), F.create_map(F.lit("other"), F.lit("$.none")).alias("saveData")).alias("mock"))
    flow = F.struct(F.lit("f").alias("id"), F.lit("u").alias("usecase"), F.struct(F.array(first, second).alias("steps")).alias("config"))
    b = s.select(n.alias("build"), F.to_json(F.struct(F.array(flow).alias("x-flows"))).alias("doc"))
    seen = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(k).alias("path_key")) for a, k in (("search", "message.order.price"), ("search", "message.order.none"), ("on_search", "message.order.price"))])
    return b, builds.steps(builds.flows(b)), b.select("build", F.explode(seen).alias("o")).select("build", "o.action", F.split("o.path_key", r"\.").alias("path"), "o.path_key")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS build, s_suppkey % 3 = 0 AS whole, s_suppkey % 2 = 0 AS even FROM supplier)
SELECT build, 'search' AS action, 'message.order.price' AS path_key, CASE WHEN even THEN 'generate,validate,comment' ELSE 'generate,comment' END || CASE WHEN whole THEN '' ELSE ',alias' END || ',generate,generate,generate' || CASE WHEN even THEN ',validate' ELSE '' END AS kinds,
CASE WHEN whole THEN 'whole' ELSE 'price_key' END AS saved, whole AS inherited, NULL AS reads, true AS set_in_generate, even AS asserted_in_validate, NOT whole AS consumed_across_steps FROM s
UNION ALL SELECT build, 'search', 'message.order.none', NULL, CASE WHEN whole THEN 'whole' END, CASE WHEN whole THEN true END, NULL, false, false, false FROM s
UNION ALL SELECT build, 'on_search', 'message.order.price', NULL, CASE WHEN whole THEN 'whole' END, CASE WHEN whole THEN true END, CASE WHEN NOT whole THEN 'price_key' END, true, even, false FROM s""")
def mined_bundles(spark, d):
    rows = mining.bundles(*_mined(spark, d))
    joined = lambda c, f: F.array_join(F.transform(c, lambda r: r[f]), ",")
    return rows.select("build", "action", "path_key", joined("refs", "kind").alias("kinds"), joined("save_data", "key").alias("saved"), F.get("save_data", F.lit(0))["inherited"].alias("inherited"), joined("session_reads", "session_key").alias("reads"), "set_in_generate", "asserted_in_validate", "consumed_across_steps")


# orders, sets and stores ------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT p_brand, CASE p_partkey % 3 WHEN 0 THEN upper(w) WHEN 1 THEN w ELSE upper(w[1:1]) || w[2:] END AS word FROM (SELECT p_brand, p_partkey, replace(lower(p_name), ' ', '') AS w FROM part))
SELECT p_brand, word, row_number() OVER (PARTITION BY p_brand ORDER BY lower(word), word DESC) AS place FROM t""")
def locale_order(spark, d):
    """Letters alone, so that the order is: letters first, then lower case before upper case at the first difference."""
    w, k = F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), F.col("p_partkey") % 3
    word = F.when(k == 0, F.upper(w)).when(k == 1, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return O.locale_places(table(spark, d, "part").select("p_brand", word.alias("word")).distinct(), ["p_brand"], "word")


_STATUS = "(['pending', 'in_flight', 'done', 'failed', 'skipped'])[event_id % 5 + 1]"


def _status() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("pending", "in_flight", "done", "failed", "skipped")]), (F.col("event_id") % 5 + 1).cast("int"))


@query(f"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE {_STATUS} WHEN 'pending' THEN 0 WHEN 'in_flight' THEN 0 WHEN 'failed' THEN 1 WHEN 'done' THEN 2 ELSE 3 END, event_id) AS place FROM events""")
def queue_order(spark, d):
    return O.queue_places(table(spark, d, "events").select("user_id", "event_id", _status().alias("status")), ["user_id"], "status", "event_id").select("user_id", "event_id", "place")


@query(f"""SELECT {_STATUS} AS status, count(*) AS n FROM events GROUP BY 1""")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy(_status().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'flow' AS kind, o_orderkey AS flow, NULL AS step_index, o_orderstatus AS what FROM orders UNION ALL SELECT 'step', l_orderkey, l_linenumber, l_returnflag FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))
SELECT kind, flow, step_index, what, row_number() OVER (PARTITION BY flow ORDER BY (kind <> 'flow')::INT, step_index) AS place FROM t""")
def drafting_order(spark, d):
    """Tasks of flows and steps in one list; within a flow its own comes first, then its steps."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("flow"), F.col("o_orderstatus").alias("what"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("flow"), F.col("l_linenumber").alias("step_index")).agg(F.min("l_returnflag").alias("what"))
    return O.flow_then_steps(O.drafting_tasks(f, s), "flow").select("kind", "flow", "step_index", "what", "place")


@query("SELECT l_suppkey, l_returnflag, max(l_linenumber) + 1 AS slots FROM lineitem GROUP BY ALL")
def slots_needed(spark, d):
    return O.slots_needed(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_gaps(spark, d):
    return O.first_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'a', c_mktsegment] ELSE [c_mktsegment] END AS was, CASE WHEN c_custkey % 3 = 0 THEN ['b', c_mktsegment, 'b'] ELSE ['x', c_mktsegment] END AS now FROM customer)
SELECT k, 'added' AS kind, m AS member FROM (SELECT k, was, unnest(now) AS m FROM a) WHERE NOT list_contains(was, m) UNION ALL SELECT k, 'removed', m FROM (SELECT k, now, unnest(was) AS m FROM a) WHERE NOT list_contains(now, m)""")
def member_repeats(spark, d):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    rows = table(spark, d, "customer").select(k.alias("k"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("a"), m)).otherwise(F.array(m)).alias("was"), F.when(k % 3 == 0, F.array(F.lit("b"), m, F.lit("b"))).otherwise(F.array(F.lit("x"), m)).alias("now"))
    return D.member_diff(rows, ["k"], "was", "now")


@query("""WITH n AS (SELECT 'D.1.' || p_type || '.' || p_brand AS key, arg_min(p_name, p_partkey) AS info FROM part GROUP BY 1), e AS (SELECT DISTINCT 'D.1.' || p_type || '.' || p_brand AS key FROM part WHERE p_size % 5 = 0)
SELECT key, 'kept' AS info FROM e UNION ALL SELECT key, info FROM n WHERE key NOT IN (SELECT key FROM e)""")
def kb_keeps_existing(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("D.1."), "p_type", F.lit("."), "p_brand").alias("key"), F.col("p_name").alias("info"), F.col("p_partkey").alias("ord"), "p_size")
    return M.kb_merge(rows.where("p_size % 5 = 0").select("key", F.lit("kept").alias("info")).distinct(), rows.drop("p_size"), "ord")


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN n_name ELSE (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_nationkey < 20) END AS value, CASE WHEN c_nationkey < 20 THEN 1 ELSE 3 END AS step FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fallback_to_any(spark, d):
    """No set is without a key, so what has no set of its own takes the first of all."""
    sets = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").alias("set_key"), F.col("n_name").alias("value"))
    return M.three_step_fallback(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), "k", sets, "set_key", "ord", "value").select("c_custkey", "value", "step")


@query("""WITH s AS (SELECT c_custkey + 10 AS c_custkey, 'new' || c_custkey AS c_name FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, c.c_name) AS c_name, c.c_mktsegment FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def upsert_fields(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return S.upsert_set(c, c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 10).alias("c_custkey"), _text("new", "c_custkey").alias("c_name")), ["c_custkey"])


@query("""WITH e AS (SELECT DISTINCT 'p' || (p_partkey % 60) AS s, 'p' || (p_size + p_partkey % 7) AS d FROM part), w AS (
WITH RECURSIVE r(root, node, hops) AS (SELECT s, d, 1 FROM e UNION SELECT r.root, e.d, r.hops + 1 FROM r JOIN e ON e.s = r.node WHERE r.hops < 4) SELECT * FROM r),
m AS (SELECT root, node, min(hops) AS hops FROM w GROUP BY ALL) SELECT root, node, hops FROM m WHERE root <> node OR hops = 1""")
def ref_cycles(spark, d):
    """A dense graph with cycles: each pair once, however many ways there are."""
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(_text("p", k % 60).alias("src"), _text("p", F.col("p_size") + k % 7).alias("dst"))
    return M.resolve_refs(e).where("hops <= 4")


@query("""SELECT user_id, event_id, coalesce((SELECT string_agg(t, ',' ORDER BY f) FROM (SELECT event_type AS t, min(event_id) AS f FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id GROUP BY 1)), '') AS prior FROM events e""")
def prior_types(spark, d):
    return P.prior_values(table(spark, d, "events"), "user_id", "event_id", F.array("event_type", "event_type")).select("user_id", "event_id", F.array_join("prior", ",").alias("prior"))


@query("SELECT count(*) AS total, count(*) FILTER (p_size > 10) AS with_refs, count(*) FILTER (p_partkey % 3 > 0) AS with_saved, count(*) FILTER (p_brand = 'Brand#2') AS with_schema FROM part")
def evidence_coverage(spark, d):
    return book.coverage(table(spark, d, "part").select(F.greatest(F.col("p_size") - 10, F.lit(0)).alias("n_refs"), (F.col("p_partkey") % 3).alias("n_saved"), (F.col("p_brand") == "Brand#2").alias("has_schema")))
