"""Queries over the driver's tables, each beside an independent SQL statement.

Every query runs over whole tables. Two snapshots of a table are made by deriving the second from
the first: some keys are renumbered (a removal and an addition), some fields are changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import diff as D
from .operators import evidence as E
from .operators import match as M
from .operators import profile as P
from .operators import store as S
from .operators import validate as V
from .plans import render

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    moved = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey"))
    status = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return o, o.select(moved.alias("o_orderkey"), "o_custkey", status.alias("o_orderstatus"), price.alias("o_totalprice"))


_SNAP = """
old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
new AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders),
d AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
             CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
                  WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'modified' END AS kind,
             o.o_orderstatus AS o_orderstatus_old, n.o_orderstatus AS o_orderstatus_new, o.o_totalprice AS o_totalprice_old, n.o_totalprice AS o_totalprice_new
      FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)"""


@query(f"WITH {_SNAP} SELECT * FROM d WHERE kind IS NOT NULL")
def keyed_diff(spark, d):
    return D.keyed_diff(*_snapshots(spark, d), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"""WITH {_SNAP} SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus_old AS before, o_orderstatus_new AS after FROM d
WHERE kind = 'modified' AND o_orderstatus_old IS DISTINCT FROM o_orderstatus_new
UNION ALL SELECT o_orderkey, 'cents', CAST(CAST(round(o_totalprice_old * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(o_totalprice_new * 100) AS BIGINT) AS VARCHAR) FROM d
WHERE kind = 'modified' AND round(o_totalprice_old * 100) IS DISTINCT FROM round(o_totalprice_new * 100)""")
def field_diff(spark, d):
    cents = [x.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")) for x in _snapshots(spark, d)]
    fields = ["o_orderstatus", "cents"]
    return D.field_diff(D.keyed_diff(*cents, ["o_orderkey"], fields), ["o_orderkey"], fields)


@query(f"""WITH {_SNAP} SELECT 'orders' AS section, count(*) AS total, count(*) FILTER (kind = 'added') AS added,
count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified FROM d WHERE kind IS NOT NULL""")
def diff_summary(spark, d):
    return D.summary(keyed_diff(spark, d).withColumn("section", F.lit("orders")), ["section"])


@query(f"""WITH {_SNAP}, r AS (SELECT kind, o_orderkey, row_number() OVER (PARTITION BY kind ORDER BY o_orderkey) AS rank,
count(*) OVER (PARTITION BY kind) AS total_changes FROM d WHERE kind IS NOT NULL)
SELECT kind, o_orderkey, rank, total_changes, total_changes > 100 AS truncated, greatest(total_changes - 100, 0) AS truncated_count FROM r WHERE rank <= 100""")
def diff_capped(spark, d):
    return D.cap_sections(keyed_diff(spark, d).select("kind", "o_orderkey"), ["kind"], ["o_orderkey"])


@query("""WITH a AS (SELECT p_brand, list(DISTINCT p_type) FILTER (p_size <= 25) AS was, list(DISTINCT p_type) FILTER (p_size > 25) AS now FROM part GROUP BY p_brand)
SELECT p_brand, 'added' AS kind, m AS member FROM (SELECT p_brand, was, unnest(now) AS m FROM a) WHERE NOT list_contains(coalesce(was, []), m)
UNION ALL SELECT p_brand, 'removed', m FROM (SELECT p_brand, now, unnest(was) AS m FROM a) WHERE NOT list_contains(coalesce(now, []), m)""")
def array_member_diff(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_type"))).alias("was"), F.collect_set(F.when(F.col("p_size") > 25, F.col("p_type"))).alias("now"))
    return D.member_diff(p, ["p_brand"], "was", "now")


def _nested(spark, d):
    e = table(spark, d, "events")
    old = e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user"), F.col("props").alias("raw")).alias("meta"))).alias("doc"))
    user = F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    new = e.select("event_id", F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("type"), F.struct(user.alias("user"), F.col("props").alias("raw"), F.when(F.col("event_id") % 4 == 0, F.lit(1)).alias("extra")).alias("meta"))).alias("doc"))
    return old, new


@query("""SELECT event_id, 'type' AS path, 'removed' AS kind, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'meta.extra', 'added', NULL, NULL FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'meta.user', 'modified', user_id::VARCHAR, (user_id + 1)::VARCHAR FROM events WHERE event_id % 3 = 0""")
def deep_diff_json(spark, d):
    return D.deep_diff(*_nested(spark, d), ["event_id"], "doc").select("event_id", F.array_join("path", ".").alias("path"), "kind", "before", "after")


@query("SELECT event_id, 'k' AS path, json_extract(props, '$.k')::VARCHAR AS canon FROM events")
def json_leaf_walk(spark, d):
    n = D.shred(table(spark, d, "events"), ["event_id"], "props")
    return n.where("not is_object").select("event_id", F.array_join("path", ".").alias("path"), "canon")


@query("""WITH v AS (SELECT event_type, props, event_id, user_id FROM events), f AS (SELECT event_type, props, min(event_id) AS first FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS k FROM f)
SELECT a.event_type, 'string' AS value_type, a.n_flows, a.n_values, s.samples FROM
(SELECT event_type, count(DISTINCT user_id) AS n_flows, count(*) AS n_values FROM v GROUP BY 1) a
JOIN (SELECT event_type, string_agg(props, ';' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY 1) s USING (event_type)""")
def leaf_profile(spark, d):
    e = table(spark, d, "events").select("event_type", "props", "user_id", "event_id", F.lit("string").alias("kind"), F.lit(False).alias("in_array"))
    p = P.leaf_profile(e, ["event_type"], "props", "user_id", "event_id", "kind", "in_array")
    return p.select("event_type", "value_type", "n_flows", "n_values", F.array_join("samples", ";").alias("samples"))


@query("""WITH c AS (SELECT event_type, props, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT event_type, props AS most_common, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def mode_first_seen(spark, d):
    return P.mode_first_seen(table(spark, d, "events"), ["event_type"], "props", "event_id")


@query("SELECT event_type, count(DISTINCT user_id) AS n_flows FROM events GROUP BY 1")
def flows_per_action(spark, d):
    return P.flows_per_action(table(spark, d, "events"), "event_type", "user_id")


@query("""WITH f AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1), s AS (SELECT event_type, props, count(DISTINCT user_id) AS seen FROM events GROUP BY 1, 2)
SELECT event_type, props, seen >= n AND n > 0 AS required FROM s JOIN f USING (event_type)""")
def required_flag(spark, d):
    e = table(spark, d, "events")
    seen = e.groupBy("event_type", "props").agg(F.count_distinct("user_id").alias("seen"))
    return seen.join(P.flows_per_action(e, "event_type", "user_id"), "event_type").select("event_type", "props", R.required_flag(F.col("seen"), F.col("n_flows")).alias("required"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 13 = 0 AND l_partkey IS NOT NULL")
def ref_integrity(spark, d):
    parts = table(spark, d, "part").select(F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey")).alias("declared"))
    return V.missing_references(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", parts, "declared")


_ROLES = ["user", "assistant", "system"]


@query("""WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) FILTER (role IN ('user', 'assistant', 'system')) = 3 AND count(*) >= 4 AS valid FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1)
SELECT conv_id, n, valid FROM g WHERE valid OR NOT (SELECT bool_or(valid) FROM g)""")
def valid_txn_groups(spark, d):
    return P.valid_groups(table(spark, d, "conversations"), "conv_id", "role", _ROLES, 4)


@query("""WITH g AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1) SELECT conv_id, n, false AS valid FROM g""")
def valid_txn_groups_fallback(spark, d):
    return P.valid_groups(table(spark, d, "conversations"), "conv_id", "role", ["no-such-role"], 1)


@query("""WITH s AS (SELECT DISTINCT conv_id FROM conversations), a AS (SELECT * FROM (VALUES (0, 'user'), (1, 'assistant'), (2, 'system')) t(slot, role)),
f AS (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY 1, 2)
SELECT s.conv_id, a.role, a.slot, f.text FROM s CROSS JOIN a LEFT JOIN f ON f.conv_id = s.conv_id AND f.role = a.role""")
def action_slots(spark, d):
    return M.action_slots(table(spark, d, "conversations"), "conv_id", "role", ["turn"], _ROLES, "text")


@query("""WITH a AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
b AS (SELECT conv_id, role, turn AS match_turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations)
SELECT a.conv_id, a.role, a.k, a.turn, b.match_turn FROM a LEFT JOIN b USING (conv_id, role, k)""")
def kth_match(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", "turn")
    return M.kth_occurrence(c, c.withColumnRenamed("turn", "match_turn"), ["conv_id", "role"], ["turn"], [F.desc("match_turn")], ["match_turn"]).select("conv_id", "role", "k", "turn", "match_turn")


@query("""WITH f AS (SELECT user_id, arg_min(ts, event_id) AS seen, min(event_id) AS first FROM events GROUP BY 1)
SELECT user_id, first FROM f ORDER BY seen DESC, first LIMIT 1""")
def latest_group(spark, d):
    e = table(spark, d, "events")
    g = P.latest_group(e, "user_id", "ts", "event_id")
    return e.join(F.broadcast(g), "user_id").groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("""WITH n AS (SELECT DISTINCT p_type FROM part), p AS (SELECT p_type, n_name, levenshtein(p_type, n_name) AS distance, n_nationkey FROM n CROSS JOIN nation),
b AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY distance, n_nationkey) AS r FROM p)
SELECT p_partkey, nearest, distance FROM part LEFT JOIN (SELECT p_type, n_name AS nearest, distance::INTEGER AS distance FROM b WHERE r = 1) USING (p_type)""")
def nearest_name(spark, d):
    return M.nearest_name(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", table(spark, d, "nation"), "n_name", "n_nationkey").select("p_partkey", "nearest", "distance")


_KB = "'D.' || (p_partkey % 5) || '.' || (p_partkey % 3) || '.' || lower(split_part(p_type, ' ', 1)) || '.' || lower(split_part(p_name, ' ', 1))"


def _kb(spark, d):
    first = lambda c: F.lower(F.split_part(F.col(c), F.lit(" "), F.lit(1)))
    key = F.concat_ws(".", F.lit("D"), (F.col("p_partkey") % 5).cast("string"), (F.col("p_partkey") % 3).cast("string"), first("p_type"), first("p_name"))
    return table(spark, d, "part").select(key.alias("key"), F.col("p_brand").alias("info"), F.col("p_partkey").alias("ord"))


@query(f"SELECT {_KB} AS key, arg_min(p_brand, p_partkey) AS info FROM part GROUP BY 1")
def kb_first_wins(spark, d):
    rows = _kb(spark, d)
    return M.kb_merge(spark.createDataFrame([], "key string, info string"), rows, "ord")


@query(f"""WITH k AS (SELECT {_KB} AS key, arg_min(p_brand, p_partkey) AS info FROM part GROUP BY 1), s AS (SELECT regexp_replace(key, '^[^.]*(\\.[0-9]+)*\\.', '') AS suffix, key, info FROM k)
SELECT suffix, arg_min(info, key) AS kb_info FROM s GROUP BY 1""")
def kb_suffix(spark, d):
    kb = kb_first_wins(spark, d)
    wanted = kb.select(T.kb_suffix(F.col("key")).alias("suffix")).distinct()
    return M.kb_lookup(wanted, "suffix", kb).select("suffix", "kb_info")


@query("""WITH s AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'r' || n_nationkey END AS k, n_name AS v FROM nation),
c AS (SELECT c_custkey, 'r' || c_nationkey AS k FROM customer), e AS (SELECT k, arg_min(v, ord) AS v FROM s WHERE k IS NOT NULL GROUP BY 1)
SELECT c_custkey, coalesce(e.v, (SELECT arg_min(v, ord) FROM s WHERE k IS NULL)) AS value, CASE WHEN e.k IS NOT NULL THEN 1 ELSE 2 END AS step FROM c LEFT JOIN e USING (k)""")
def three_step_fallback(spark, d):
    sets = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))).alias("set_key"), F.col("n_name").alias("value"))
    wanted = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("k"))
    return M.three_step_fallback(wanted, "k", sets, "set_key", "ord", "value").select("c_custkey", "value", "step")


@query("""WITH a AS (SELECT s_suppkey, r_name || '.' || n_name || '.' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path, CASE WHEN s_suppkey % 2 = 0 THEN '["' || s_suppkey || '"]' END AS enums, CASE WHEN s_suppkey % 3 = 0 THEN '[' || s_suppkey || ']' END AS tags FROM a""")
def tree_overlay(spark, d):
    a = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = a.select("s_suppkey", F.concat_ws(".", "r_name", "n_name", "s_name").alias("path"))
    key = F.col("s_suppkey").cast("string")
    enums = a.select("path", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('["'), key, F.lit('"]'))).otherwise(F.lit('{"a":1}')).alias("enums"))
    tags = a.select("path", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("["), key, F.lit("]"))).otherwise(F.lit('"text"')).alias("tags"))
    return M.tree_overlay(a.select("path"), enums, tags, ["path"])


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS representative, count(*) OVER (PARTITION BY lang, text) AS members FROM documents""")
def signature_dedup(spark, d):
    return _signed(spark, d).select("doc_id", "representative", "members")


def _signed(spark, d):
    return E.signature_groups(table(spark, d, "documents").select("doc_id", "lang", "text"), ["lang", "text"], "doc_id")


@query("""WITH g AS (SELECT count(*) AS total, count(DISTINCT lang || chr(1) || text) AS groups FROM documents) SELECT total, groups, floor((total - groups) * 100.0::DOUBLE / total + 0.5)::BIGINT AS saved_percent FROM g""")
def dedup_savings(spark, d):
    return E.savings(_signed(spark, d))


@query("""WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS representative FROM documents) SELECT g.doc_id, g.representative, 'draft of ' || g.representative AS draft FROM g""")
def clone_members(spark, d):
    g = _signed(spark, d)
    drafts = g.select(F.col("representative").alias("k")).distinct().select("k", F.concat(F.lit("draft of "), F.col("k").cast("string")).alias("draft"))
    return E.clone_members(g, "doc_id", drafts, "k", "draft").select("doc_id", "representative", "draft")


@query(f"WITH {_SNAP} SELECT n.o_orderkey FROM new n JOIN old o USING (o_orderkey) WHERE n.o_orderstatus = o.o_orderstatus AND n.o_totalprice = o.o_totalprice")
def hash_skip(spark, d):
    old, new = [x.withColumn("hash", F.sha2(F.to_json(F.struct("o_custkey", "o_orderstatus", "o_totalprice")), 256)) for x in _snapshots(spark, d)]
    return S.unchanged(new, old.select("o_orderkey", "hash"), ["o_orderkey"]).select("o_orderkey")


@query(f"WITH {_SNAP} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new")
def upsert_merge(spark, d):
    return S.upsert(*_snapshots(spark, d), ["o_orderkey"])


@query(f"WITH {_SNAP} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def stale_all(spark, d):
    return S.stale_all(*_snapshots(spark, d), ["o_orderkey"])


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 6 = 0""")
def stale_scoped(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.where((F.col("c_mktsegment") != "BUILDING") & (F.col("c_custkey") % 6 != 0))
    return S.stale_scoped(c, new, ["c_mktsegment"], ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_check(spark, d):
    return S.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT conv_id, turn, coalesce((SELECT string_agg(role, ',' ORDER BY t) FROM (SELECT role, min(turn) AS t FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn GROUP BY role)), '') AS prior FROM conversations c""")
def prior_keys(spark, d):
    return P.prior_values(table(spark, d, "conversations"), "conv_id", "turn", F.array("role")).select("conv_id", "turn", F.array_join("prior", ",").alias("prior"))


@query("""WITH k AS (SELECT user_id, event_type, event_id, coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 6) AS kind,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (n > 1)::INT, kind, n, event_type) AS rank FROM k) SELECT user_id, event_id, rank FROM r WHERE rank <= 8""")
def kind_diverse_top8(spark, d):
    types = ("click", "error", "purchase", "signup", "view")
    return E.diverse_top(table(spark, d, "events"), ["user_id"], "event_type", ["event_id"], types).select("user_id", "event_id", "rank")


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 4""")
def topn_per_group(spark, d):
    return D.cap_sections(table(spark, d, "events"), ["user_id"], [F.desc("ts"), "event_id"], 4).select("user_id", "event_id", "rank")


def _segments(spark, d):
    body = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.split(body, "/").alias("path"))


_SEG = "SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages"


@query(f"""WITH p AS ({_SEG}), h AS (SELECT DISTINCT path[1:2] AS host FROM p) SELECT page_id, array_to_string(host, '/') AS ancestor FROM p JOIN h ON len(path) > 2 AND path[1:2] = host
UNION ALL SELECT page_id, array_to_string(host, '/') FROM p JOIN (SELECT DISTINCT path[1:1] AS host FROM p) ON len(path) > 1 AND path[1:1] = host""")
def prefix_ancestor_join(spark, d):
    p = _segments(spark, d)
    saved = p.select(F.slice("path", 1, 2).alias("saved")).where("size(saved) = 2").union(p.select(F.slice("path", 1, 1).alias("saved"))).distinct()
    return E.ancestor_join(p, "path", saved, "saved").select("page_id", F.array_join("saved", "/").alias("ancestor"))


@query(f"""WITH p AS ({_SEG}), l AS (SELECT DISTINCT path[-2:] AS tail FROM p) SELECT page_id, array_to_string(tail, '/') AS tail FROM p JOIN l ON path[-len(tail):] = tail""")
def suffix_match_join(spark, d):
    p = _segments(spark, d)
    tails = p.select(F.when(F.size("path") >= 2, F.slice("path", -2, 2)).otherwise(F.col("path")).alias("tail")).distinct()
    return E.suffix_join(tails, "tail", p, "path").select("page_id", F.array_join("tail", "/").alias("tail"))


@query(r"""SELECT page_id, len(list_filter(regexp_extract_all(html, '["'']([$\w][\w$.\[\]]{2,200})["'']', 1), lambda s: contains(s, '.') AND len(list_filter(regexp_split_to_array(s, '\.|\[[^\]]*\]'), lambda t: trim(t) <> '')) >= 2))::BIGINT AS n_paths FROM pages""")
def regex_quoted_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.quoted_paths(F.col("html"))).cast("long").alias("n_paths"))


@query(r"""SELECT page_id, (len(regexp_extract_all(html, '//[^\n]*')) + len(regexp_extract_all(html, '/\*[\s\S]*?\*/')))::BIGINT AS n_comments FROM pages""")
def comment_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.comments(F.col("html"))).cast("long").alias("n_comments"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '[A-Za-z_$][0-9A-Za-z_$]*')))::BIGINT AS n_identifiers FROM pages""")
def identifier_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.identifiers(F.col("html"))).cast("long").alias("n_identifiers"))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS slug,
replace(replace(p_name || '|' || p_type, '|', '\|'), chr(10), ' ') AS cell, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '…' ELSE p_name END AS short,
p_name AS round_trip, substr(sha256(p_name), 1, 16) AS print FROM part""")
def case_variants(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", T.camel_to_snake(n).alias("snake"), T.safe_name(n).alias("slug"), T.escape_cell(F.concat_ws("|", "p_name", "p_type")).alias("cell"), T.truncate(n, 8).alias("short"), T.decode_base64(F.base64(F.encode(n, "utf-8"))).alias("round_trip"), T.fingerprint(n).alias("print"))


@query("""SELECT doc_id, text IS NULL OR length(trim(text)) < 20 OR lower(trim(text)) IN ('edit later','edit-later','tbd','tba','--','<auto>','please add relevant description') AS stub,
length(trim(text)) < 15 OR lang IS NULL OR source IS NULL OR trim(lang) = '' OR trim(source) = '' OR lower(trim(text)) IN ('edit later','edit-later','tbd','tba','--','<auto>','please add relevant description') AS incomplete FROM documents""")
def placeholder_leaf(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", R.description_stub(F.col("text")).alias("stub"), R.incomplete_leaf(F.col("text"), F.col("source"), F.col("lang"), F.col("lang")).alias("incomplete"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_existing_leaf' WHEN quality = 0 THEN 'incomplete_existing_leaf' ELSE 'complete_existing_leaf' END AS reason FROM documents LEFT JOIN labels l USING (doc_id)""")
def gap_reason(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return x.select("doc_id", R.gap_reason(F.coalesce("has", F.lit(False)), F.col("quality") == 0).alias("reason"))


_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda t: length(t) >= 4 AND t NOT IN ('the','a','an','of','to','in','for','and','or','with','is','are','this','that','be','by','from','as','on','it','at','its','into','when','then','than'))"


@query(f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens, len(list_filter({_TOK.format('text')}, lambda t: list_contains({_TOK.format(repr('license token email this work have than'))}, t))) >= 2 AS anchored FROM documents")
def anchor_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("own"))
    return rows.select("doc_id", F.size("own").cast("long").alias("n_tokens"), (T.shared_tokens(F.col("own"), T.tokens(F.lit("license token email this work have than"))) >= 2).alias("anchored"))


@query(r"""WITH s AS (SELECT doc_id, text, trim(text) AS t, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, round(least(CASE WHEN length(t) >= 60 THEN 0.3 WHEN length(t) >= 30 THEN 0.2 ELSE 0.0 END + CASE WHEN len(w) >= 10 THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(t, '^[A-Z]') THEN 0.05 ELSE 0.0 END
+ CASE WHEN regexp_matches(t, '[.!?]$') THEN 0.05 ELSE 0.0 END + 0.15, 1.0), 3)::DOUBLE AS score FROM s)
SELECT doc_id, score, CASE WHEN score >= 0.8 THEN 'green' WHEN score >= 0.5 THEN 'yellow' ELSE 'red' END AS band FROM x""")
def confidence_score(spark, d):
    n = F.lit(0)
    score, _ = R.description_score(F.col("text"), error=F.lit(None), kind=F.lit("flow"), saved_keys=n, prior_keys=n, owner=F.lit(""), tags=F.lit(1), actions=n)
    return table(spark, d, "documents").select("doc_id", score.alias("score")).withColumn("band", R.band(F.col("score")))


@query("SELECT conv_id, bool_or(role = 'system') AS has_system, bool_or(role = 'assistant') AS has_reply, bool_or(turn >= 6) AS is_long, bool_or(length(text) >= 400) AS has_long_turn FROM conversations GROUP BY 1")
def cross_flow_flags(spark, d):
    return E.existence_flags(table(spark, d, "conversations"), ["conv_id"], {"has_system": F.col("role") == "system", "has_reply": F.col("role") == "assistant", "is_long": F.col("turn") >= 6, "has_long_turn": F.length("text") >= 400})


@query("""SELECT c_custkey, 'c_acctbal' AS path FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_name' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')""")
def schema_violations(spark, d):
    tests = F.array(F.when(F.col("c_acctbal") < 0, F.lit("c_acctbal")), F.when(~F.col("c_name").rlike("[02468]$"), F.lit("c_name")))
    return table(spark, d, "customer").select("c_custkey", F.explode(F.array_compact(tests)).alias("path"))


@query("""SELECT r_name, '| Nation | Key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS page FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def md_table(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return render.table(n, ["r_name"], {"Nation": F.col("n_name"), "Key": F.col("n_nationkey")}, "n_nationkey", "page")


@query("""SELECT '## ' || r_name || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS section, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def md_grouped_index(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return render.grouped_index(n, "r_name", F.col("n_name"), "n_nationkey").select("section", "n")


@query("""SELECT p_size, row_number() OVER (ORDER BY p_size::VARCHAR) AS place FROM (SELECT DISTINCT p_size FROM part)""")
def errors_sorted(spark, d):
    sizes = table(spark, d, "part").select("p_size").distinct()
    return render.ranked(sizes, F.col("p_size").cast("string"), "place")


@query("""WITH e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS d FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)
SELECT a.s AS root, a.d AS node, 1 AS hops FROM e a UNION ALL SELECT a.s, b.d, 2 FROM e a JOIN e b ON a.d = b.s UNION ALL SELECT a.s, c.d, 3 FROM e a JOIN e b ON a.d = b.s JOIN e c ON b.d = c.s""")
def ref_chain(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"))
    e = e.union(table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(table(spark, d, "region").select(key("r", "r_regionkey"), F.lit("world")))
    return M.resolve_refs(e)


@query("""SELECT DISTINCT event_type AS action, next FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL""")
def action_graph(spark, d):
    return render.successors(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH m AS (SELECT event_type, arg_min(props, -n * 1000000000 + first) AS most FROM (SELECT event_type, props, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1)
SELECT event_type, most AS usage, CASE WHEN event_type LIKE 'on_%' THEN 'BPP' ELSE 'BAP' END AS owner, 'string' AS type FROM m""")
def usage_pick(spark, d):
    m = P.mode_first_seen(table(spark, d, "events"), ["event_type"], "props", "event_id")
    leaf = F.lit(True)
    return m.select("event_type", R.usage_of(leaf, F.col("most_common"), F.array().cast("array<string>")).alias("usage"), R.owner_of(F.col("event_type")).alias("owner"), R.type_of(F.lit(False), leaf, F.col("most_common"), F.lit("string")).alias("type"))


from . import catalogue_builds, catalogue_evidence, catalogue_scripts  # noqa: E402, F401  they register their queries here
