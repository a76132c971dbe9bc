"""Differences between two snapshots: by key, by field, by array member, and deep inside JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as T

#: Entries kept of a section.
SECTION_CAP = 100
#: No limit of levels: a recursion ends where documents do.
ALL_LEVELS = 1_000_000
#: Bytes of an Arrow batch of rows from a table function, about.
BATCH_BYTES = 4 << 20
ENTRY = ["section", "ord", "kind", "path", "summary", "before", "after"]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row per key that was added, removed or changed, with both sides' fields as <field>_old and <field>_new.

    One full outer join on the keys; Catalyst picks the strategy. Keys must be unique per side.
    """
    a = old.select(*[F.col(k).alias(f"{k}__o") for k in keys], *[F.col(f).alias(f"{f}_old") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(*[F.col(k).alias(f"{k}__n") for k in keys], *[F.col(f).alias(f"{f}_new") for f in fields], F.lit(True).alias("in_new"))
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"{k}__o").eqNullSafe(F.col(f"{k}__n")) for k in keys]), "full_outer")
    changed = reduce(lambda x, y: x | y, [~same(F.col(f"{f}_old"), F.col(f"{f}_new")) for f in fields], F.lit(False))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(changed, "modified")
    chosen = [F.when(F.col("in_old").isNull(), F.col(f"{k}__n")).otherwise(F.col(f"{k}__o")).alias(k) for k in keys]
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*chosen, "kind", *[f"{f}_{s}" for f in fields for s in ("old", "new")])


def field_diff(diff: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Modified rows of keyed_diff as a row per changed field: field, before, after."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").cast("string").alias("before"), F.col(f"{f}_new").cast("string").alias("after")) for f in fields])
    rows = diff.where(F.col("kind") == "modified").select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field", "c.before", "c.after")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def member_diff(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Array members that came or went, repeats kept: kind, member."""
    added = F.transform(T.array_minus(F.col(after), F.col(before)), lambda m: F.struct(F.lit("added").alias("kind"), m.alias("member")))
    removed = F.transform(T.array_minus(F.col(before), F.col(after)), lambda m: F.struct(F.lit("removed").alias("kind"), m.alias("member")))
    return rows.select(*keys, F.explode(F.concat(added, removed)).alias("m")).select(*keys, "m.kind", "m.member")


def cap_sections(entries: DataFrame, by: list[str], order: list, cap: int = SECTION_CAP) -> DataFrame:
    """The first entries of each section with total_changes, truncated and truncated_count.

    Each task keeps the first entries of a section before the shuffle (a rank that is filtered alone is
    pushed down as a group limit); the totals are a partial aggregation of their own and one row per section.
    """
    first = entries.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= cap)
    totals = entries.groupBy(*[F.col(c).alias(f"{c}__t") for c in by]).agg(F.count(F.lit(1)).alias("total_changes"))
    rows = first.join(totals, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__t")) for c in by])).drop(*[f"{c}__t" for c in by])
    return rows.withColumns({"truncated": F.col("total_changes") > cap, "truncated_count": F.greatest(F.col("total_changes") - cap, F.lit(0))})


def summary(entries: DataFrame, by: list[str]) -> DataFrame:
    """Counts of added, removed and modified entries per section."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), count("added"), count("removed"), count("modified"))


def shred(df: DataFrame, ids: list[str], json: str, arrays: bool = False, most_depth: int = ALL_LEVELS, beyond_reader: bool = False) -> DataFrame:
    """All nodes of JSON documents: ids, path ARRAY<STRING>, canon, is_object, depth.

    A recursive query over variant_explode. Arrays stay whole unless `arrays`; then their elements
    add no segment to the path, and `place` ARRAY<BIGINT> has their positions: of the nodes with one path in a document it
    gives the order. A document that can't be parsed has no nodes. Spark's reader takes documents of up to a
    thousand levels; with `beyond_reader` deeper ones are read by a table function that doesn't recurse.
    """
    spark, source = df.sparkSession, df
    name = f"treeloom_shred_{uuid.uuid4().hex}"
    df.select(*ids, F.try_parse_json(F.col(json)).alias("v")).where("v is not null").createOrReplaceTempView(name)
    keep = ", ".join(f"`{c}`" for c in ids)
    prefix = ", ".join(f"t.`{c}`" for c in ids)
    opens = "schema_of_variant(t.v) LIKE 'OBJECT%'" + (" OR schema_of_variant(t.v) LIKE 'ARRAY%'" if arrays else "")
    place, root, next_ = (", place", ", CAST(array() AS ARRAY<BIGINT>)", ", CASE WHEN e.key IS NULL THEN array_append(t.place, CAST(e.pos AS BIGINT)) ELSE t.place END") if arrays else ("", "", "")
    rows = spark.sql(f"""
        WITH RECURSIVE t({keep}, path, v, depth{place}) MAX RECURSION LEVEL {most_depth} AS (
          SELECT {keep}, CAST(array() AS ARRAY<STRING>), v, 0{root} FROM {name}
          UNION ALL
          SELECT {prefix}, CASE WHEN e.key IS NULL THEN t.path ELSE array_append(t.path, e.key) END, e.value, t.depth + 1{next_}
          FROM t, LATERAL variant_explode(t.v) e WHERE {opens})
        SELECT {keep}, path, to_json(v) AS canon, schema_of_variant(v) LIKE 'OBJECT%' AS is_object, schema_of_variant(v) AS shape, depth{place} FROM t LIMIT ALL""")
    spark.catalog.dropTempView(name)
    return rows.unionByName(_deep_nodes(source, ids, json, arrays)) if beyond_reader else rows


def _too_deep(json: str) -> Column:
    """Texts that may be nested deeper than Spark's reader goes."""
    return (F.octet_length(json) > 2 * nested.READER_LEVELS) & F.try_parse_json(F.col(json)).isNull()


def _table_function(df: DataFrame, ids: list[str], rows_of: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """ids and the rows that rows_of(*other columns) gives for each row, in Arrow batches of bounded size."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids).schema), *(f"{n} {t}" for n, t, _ in fields)])

    def run(batches):
        for batch in batches:
            others = [batch.column(k).to_pylist() for k in range(len(ids), batch.num_columns)]

            def flush(out, batch=batch):
                at = pa.array([r[0] for r in out], pa.int64())
                own = [batch.column(k).take(at) for k in range(len(ids))]
                return pa.RecordBatch.from_arrays([*own, *(pa.array([r[1][k] for r in out], t) for k, (_, _, t) in enumerate(fields))], names=[*ids, *(n for n, _, _ in fields)])

            out, size = [], 0
            for i, values in enumerate(zip(*others, strict=True)):
                for row in rows_of(*values):
                    out.append((i, row))
                    size += sum(len(x) for x in row if isinstance(x, str)) + 100
                    if size > BATCH_BYTES:
                        yield flush(out)
                        out, size = [], 0
            if out:
                yield flush(out)

    return df.mapInArrow(run, schema)


def _deep_nodes(df: DataFrame, ids: list[str], json: str, arrays: bool) -> DataFrame:
    def rows_of(text: str):
        top = nested.deep(text)
        for path, canon, kind, depth, place in nested.nodes(top, arrays) if top else ():
            yield (path, canon, kind == "OBJECT", kind, depth, *([place] if arrays else []))

    fields = [("path", "array<string>", pa.list_(pa.string())), ("canon", "string", pa.string()), ("is_object", "boolean", pa.bool_()), ("shape", "string", pa.string()), ("depth", "int", pa.int32())]
    fields += [("place", "array<bigint>", pa.list_(pa.int64()))] if arrays else []
    return _table_function(df.where(_too_deep(json)).select(*ids, json), ids, rows_of, fields)


def _deep_pairs(old: DataFrame, new: DataFrame, ids: list[str], json: str) -> DataFrame:
    """Differences of pairs of which one document at least is beyond Spark's reader."""

    def rows_of(a: str, b: str):
        x, y = nested.parse(a), nested.parse(b)
        if x and y and max(x[1], y[1]) > nested.READER_LEVELS:
            yield from nested.differences(x[0], y[0])

    a = old.select(*ids, F.col(json).alias("a"), _too_deep(json).alias("p"))
    b = new.select(*[F.col(c).alias(f"{c}__n") for c in ids], F.col(json).alias("b"), _too_deep(json).alias("q"))
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__n")) for c in ids])
    some = a.where("p").join(b, cond).unionByName(a.where("not coalesce(p, false)").join(b.where("q"), cond))
    fields = [("path", "array<string>", pa.list_(pa.string())), ("before", "string", pa.string()), ("after", "string", pa.string())]
    return _table_function(some.where("a is not null and b is not null").select(*ids, "a", "b"), ids, rows_of, fields)


def deep_diff(old: DataFrame, new: DataFrame, ids: list[str], json: str, most_depth: int = ALL_LEVELS, beyond_reader: bool = False) -> DataFrame:
    """Differences inside JSON documents: ids, path, kind, before, after. Arrays and scalars are atomic.

    Documents of both sides meet by their ids; only pairs whose canonical texts differ are opened, and of
    two objects only the members that differ, so equal documents and subtrees cost one comparison
    and no node is shuffled. Different shapes at the root are one entry with an empty path. A
    document that one side lacks, or that can't be parsed, gives no entry. Documents of more than a thousand
    levels, which Spark's reader doesn't take, are compared with `beyond_reader` only.
    """
    spark = old.sparkSession
    a = old.select(*[F.col(c).alias(f"{c}__o") for c in ids], F.try_parse_json(F.col(json)).alias("a")).where("a is not null")
    b = new.select(*[F.col(c).alias(f"{c}__n") for c in ids], F.try_parse_json(F.col(json)).alias("b")).where("b is not null")
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"{c}__o").eqNullSafe(F.col(f"{c}__n")) for c in ids]))
    name = f"treeloom_pairs_{uuid.uuid4().hex}"
    both.where(F.to_json("a") != F.to_json("b")).select(*[F.col(f"{c}__o").alias(c) for c in ids], "a", "b").createOrReplaceTempView(name)
    keep, own = ", ".join(f"`{c}`" for c in ids), ", ".join(f"t.`{c}`" for c in ids)
    members = lambda v: f"try_variant_get({v}, '$', 'map<string,variant>')"
    rows = spark.sql(f"""
        WITH RECURSIVE t({keep}, path, a, b, depth) MAX RECURSION LEVEL {most_depth} AS (
          SELECT {keep}, CAST(array() AS ARRAY<STRING>), a, b, 0 FROM {name}
          UNION ALL
          SELECT {keep}, path, a, b, depth FROM (
            SELECT {own}, array_append(t.path, m.key) AS path, try_element_at({members("t.a")}, m.key) AS a, try_element_at({members("t.b")}, m.key) AS b, t.depth + 1 AS depth
            FROM t LATERAL VIEW explode(array_union(map_keys({members("t.a")}), map_keys({members("t.b")}))) m AS key)
          WHERE NOT (to_json(a) <=> to_json(b)))
        SELECT {keep}, path, to_json(a) AS before, to_json(b) AS after, {members("a")} IS NOT NULL AND {members("b")} IS NOT NULL AS inner FROM t LIMIT ALL""")
    spark.catalog.dropTempView(name)
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    # The text of added and removed nodes is no part of an entry.
    shown = lambda c: F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), T.preview(F.col(c)))
    rows = rows.where("not inner").select(*ids, "path", "before", "after")
    if beyond_reader:
        rows = rows.unionByName(_deep_pairs(old, new, ids, json))
    return rows.select(*ids, "path", kind.alias("kind"), shown("before").alias("before"), shown("after").alias("after"))
