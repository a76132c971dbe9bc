"""Joins of evidence to attribute paths, turned into equality joins; selection and dedup of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of references in the order in which they are preferred; references and session reads kept per path. Fixed values.
KINDS = ("generate", "validate", "requirements", "comment", "alias")
TOP_REFS, TOP_READS = 8, 4
#: References that a step gives a path at most, by kind. Fixed values.
STEP_CAPS = {"generate": 4, "validate": 4, "requirements": 2, "comment": 2}


def suffix_join(paths: DataFrame, path: str, chains: DataFrame, chain: str) -> DataFrame:
    """Paths that an access chain refers to: the chain ends with the path or its last three segments.

    Every end of a chain is a key, and so are a path's tails; a pair that meets twice counts once.
    """
    keyed = paths.withColumn("_k", F.explode(T.match_tails(F.col(path))))
    ends = chains.withColumn("_k", F.explode(T.suffixes(F.col(chain))))
    return keyed.join(ends, "_k").drop("_k").distinct()


def persisted_join(paths: DataFrame, path: str, saved: DataFrame, jsonpath: str) -> DataFrame:
    """Saved JSONPaths that end at a path or at its last three segments, in any of its case forms."""
    ends = saved.withColumn("_k", F.explode(T.suffixes(T.jsonpath_segments(F.col(jsonpath)))))
    keyed = paths.withColumn("_k", F.explode(T.match_tails(T.drop_indices(F.col(path)))))
    return keyed.join(ends, "_k").drop("_k").distinct()


def inherited_join(paths: DataFrame, path: str, saved: DataFrame, jsonpath: str, direct: DataFrame, same: list[str]) -> DataFrame:
    """Saved JSONPaths of ancestors of a path, but for those whose key the path has directly: `same` names the columns that must agree."""
    rows = saved.withColumn("_s", T.jsonpath_segments(F.col(jsonpath)))
    found = ancestor_join(paths.withColumn("_p", T.drop_indices(F.col(path))), "_p", rows, "_s").drop("_p", "_s")
    return found.join(direct.select(*same).distinct(), same, "left_anti")


def ancestor_join(paths: DataFrame, path: str, saved: DataFrame, saved_path: str) -> DataFrame:
    """Saved paths that are a proper beginning of a path."""
    keyed = paths.withColumn("_k", F.explode(T.proper_prefixes(F.col(path))))
    return keyed.join(saved, keyed["_k"] == saved[saved_path]).drop("_k")


def _firsts(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """The first few rows of each group by those columns of the order that they have; without any, any few."""
    own = [c for c in order if c in rows.columns]
    w = Window.partitionBy(*by).orderBy(*(own or [F.lit(0)]))
    return rows.withColumn("_f", F.row_number().over(w)).where(F.col("_f") <= cap).drop("_f")


def producer_join(reads: DataFrame, key: str, path: str, producers: DataFrame, producer_key: str, producer_path: str, order: list[str], cap: int = TOP_READS) -> DataFrame:
    """Session reads meet the step that saved the key, where its path is the attribute's or an ancestor's; the first few per path.

    `order` names columns. A read with that many before it of its key and path, or a producer with that many before it of its key and
    path, is in no result, so both are cut before they meet.
    """
    empty = F.array().cast("array<string>")
    few = _firsts(reads, [key, path], order, cap).withColumn("_at", F.explode(F.array_distinct(F.concat(F.array(F.col(path), F.when(F.col(path).isNotNull(), empty)), T.proper_prefixes(F.col(path))))))
    made = _firsts(producers, [producer_key, producer_path], order, cap)
    hit = few.join(made, (few[key] == made[producer_key]) & (few["_at"] == made[producer_path])).drop("_at")
    return _firsts(hit, [path], order, cap)


def session_reads(reads: DataFrame, key: str, chain: str, paths: DataFrame, path: str, path_id: list[str], producers: DataFrame, producer_key: str, producer_path: str, order: list[str], cap: int = TOP_READS, within: dict[str, str] | None = None) -> DataFrame:
    """Reads of the session that concern a path, the first few per path, with their producers.

    A read of a key that some step saves concerns the paths which that step's path is or is an ancestor
    of; a read of a key that no step saves concerns those that its chain refers to. `within` names columns of producers
    and the columns of paths that they must equal for the two to meet.

    `order` names columns of reads, producers and paths. A pair comes after another one if its read or its producer
    does and the rest is the same. So of the reads of a key, and of the producers of a path by their key, only the
    first `cap` can be in a result; they are cut before they meet, and what is joined is bounded by paths and keys.
    """
    mine = [c for c in path_id if c in reads.columns]
    theirs = [c for c in path_id if c not in reads.columns]
    made = producers.select(F.col(producer_key).alias("_pk"), *[c for c in producers.columns if c != producer_key])
    spots = _firsts(made, ["_pk", producer_path, *(within or {}), *(c for c in theirs if c in made.columns)], order, cap)
    keyed = paths.withColumn("_at", F.explode(F.concat(F.array(F.col(path)), T.proper_prefixes(F.col(path)))))
    agree = [F.col(producer_path) == F.col("_at"), *(spots[a] == keyed[b] for a, b in (within or {}).items())]
    near = _firsts(spots.join(keyed, reduce(lambda x, y: x & y, agree)).drop("_at"), [*theirs, "_pk"], order, cap)
    known = _firsts(reads, [key, *mine], order, cap).join(near, F.col(key) == F.col("_pk")).drop("_pk")
    lost = reads.join(made.select("_pk").distinct(), reads[key] == F.col("_pk"), "left_anti").distinct()
    ends = _firsts(lost.withColumn("_k", F.explode(T.suffixes(F.col(chain)))), ["_k", *mine], order, cap)
    tails = paths.withColumn("_k", F.explode(T.match_tails(F.col(path))))
    open_ = tails.join(ends, "_k").drop("_k").distinct()
    return _firsts(known.unionByName(open_, allowMissingColumns=True), path_id, order, cap)


def capped_refs(refs: DataFrame, keys: list[str], step: list[str], kind: str, order: list, caps: dict | None = None) -> DataFrame:
    """References with at most so many of a kind from one step for one key; a kind without a cap keeps all."""
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in (caps or STEP_CAPS).items() for x in kv])[F.col(kind)], F.lit(1 << 30))
    rows = refs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *step, kind).orderBy(*order)))
    return rows.where(F.col("_n") <= most).drop("_n")


def diverse_top(refs: DataFrame, keys: list[str], kind: str, order: list, kinds: tuple = KINDS, most: int = TOP_REFS) -> DataFrame:
    """The first of each kind, then more in the order of kinds, up to `most` per key."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)), F.lit(len(kinds) + 1))
    rows = refs.withColumn("_kind", rank).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy((F.col("_n") > 1).cast("int"), "_kind", "_n")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).drop("_kind", "_n")


def alias_hits(keys: DataFrame, key: str, group: list[str], sources: DataFrame, source: str, order: list) -> DataFrame:
    """The first source that mentions a key as a whole word. Sources are cut into their identifiers, so words meet by equality."""
    words = sources.withColumn("_w", F.explode(T.identifiers(F.col(source))))
    hit = keys.join(words, keys[key] == words["_w"]).drop("_w")
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).where("_n = 1").drop("_n")


def existence_flags(steps: DataFrame, group: list[str], tests: dict[str, Column]) -> DataFrame:
    return steps.groupBy(*group).agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(k) for k, t in tests.items()])


def signature_groups(rows: DataFrame, signed: list[str], ord_: str) -> DataFrame:
    """Rows with equal fields share a signature; the first is their representative."""
    sig = T.fingerprint(F.to_json(F.struct(*signed), {"ignoreNullFields": "false"}))
    rows = rows.withColumn("signature", sig)
    groups = rows.groupBy("signature").agg(F.min(ord_).alias("representative"), F.count(F.lit(1)).alias("members"))
    return rows.join(groups, "signature")


def attribute_groups(bundles: DataFrame, ord_: str) -> DataFrame:
    """Bundles that may share a draft: equal shape and equal kinds of evidence.

    bundles: path_key, value_type, is_leaf, schema (JSON or null), enum_codes and tag_codes (arrays in order),
    ref_kinds and jsonpaths (arrays). The shape's signature takes codes in order; the evidence's fingerprint takes
    the distinct kinds of references and the last two segments of saved paths, sorted.
    """
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    tails = F.array_sort(F.array_distinct(F.transform(none("jsonpaths"), lambda p: F.array_join(F.slice(F.split(p, r"\."), -F.least(F.size(F.split(p, r"\.")), F.lit(2)), 2), "."))))
    keep = {"ignoreNullFields": "false"}
    shape = F.struct("path_key", "value_type", "is_leaf", "schema", none("enum_codes").alias("enums"), none("tag_codes").alias("tags"))
    rows = bundles.withColumns({
        "signature": T.fingerprint(F.to_json(shape, keep)),
        "evidence": T.fingerprint(F.to_json(F.struct(F.array_sort(F.array_distinct(none("ref_kinds"))).alias("kinds"), tails.alias("tails")), keep)),
    })
    groups = rows.groupBy("signature", "evidence").agg(F.min(ord_).alias("representative"), F.count(F.lit(1)).alias("members"))
    return rows.join(groups, ["signature", "evidence"])


def savings(groups: DataFrame) -> DataFrame:
    """Rows, groups and the share of rows that need no draft of their own, in per cent."""
    total, own = F.count(F.lit(1)), F.count_distinct("signature")
    return groups.agg(total.alias("total"), own.alias("groups"), F.when(total > 0, F.floor((total - own) * 100.0 / total + 0.5)).otherwise(0).cast("long").alias("saved_percent"))


def clone_members(groups: DataFrame, ord_: str, drafts: DataFrame, draft_key: str, draft: str) -> DataFrame:
    """A group's draft for each of its members."""
    return groups.join(drafts.select(F.col(draft_key).alias("_r"), F.col(draft)), F.col("representative") == F.col("_r"), "left").drop("_r")
