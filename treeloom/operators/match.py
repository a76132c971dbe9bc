"""Matching: nearest strings, occurrences, slots, fallbacks, overlays and the knowledge base."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import trie
from .cut import written

#: Rows of a dictionary that a task holds at once.
DICTIONARY_ROWS = 10_000
#: Edit distances up to which names meet words that share a part with them, one after the other, as long as that
#: makes no more than so many rows for each name and word.
NEAR, EACH = (0, 1, 2, 3, 4, 5), 3
#: Words and letters of a trie that a task holds; names that it looks up there, as few and as many as that.
TRIE_WORDS, TRIE_LETTERS, TRIE_NAMES = 1 << 17, 1 << 23, (1 << 8, 1 << 14)
#: Rows of words without letters that a task makes.
TASK_ROWS = 1 << 20


def nearest_name(rows: DataFrame, name: str, dictionary: DataFrame, word: str, ord_: str, most: int | None = None) -> DataFrame:
    """The dictionary's nearest entry by edit distance; of equally near ones the first in order.

    Names and words are made distinct first. A dictionary of up to DICTIONARY_ROWS words is broadcast, and each name folds over it.
    Beyond that, words within a few edits are found by what they have in common (near_words), for one distance after the
    other, while that makes few rows; the names that have none then go down tries of the words (_by_trie).
    Nothing of that is broadcast. A null name has no nearest entry; an empty dictionary has none for any.
    """
    words = dictionary.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(ord_).alias("ord"))
    names = rows.select(F.col(name).alias("_name")).where(F.col(name).isNotNull()).distinct()
    size, letters = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if size <= DICTIONARY_ROWS:
        block = words.agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("words"))
        best = _nearest_of(names.crossJoin(F.broadcast(block)))
    else:
        names, words = written(names, "names"), written(words, "words")
        found = []
        for bound in NEAR:
            near = None if names.isEmpty() else near_words(names, words, bound)
            if near is None:
                break
            found.append(written(near, "near-words"))
            names = written(names.join(found[-1], "_name", "left_anti"), "far-names")
        best = reduce(DataFrame.unionByName, [*found, _by_trie(names, words, max(-(-size // TRIE_WORDS), -(-letters // TRIE_LETTERS)))])
    out = rows.join(best.drop("ord"), rows[name] == best["_name"], "left").drop("_name")
    return out if most is None else out.withColumn("nearest", F.when(F.col("distance") <= most, F.col("nearest")))


def _by_trie(names: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """_name, distance, ord, nearest: the best word for each name, by tries of the words dealt to blocks.

    A name finds its nearest word in one block, and in the others those that are as near at least.
    """
    n = names.count()
    if not n:
        return names.selectExpr("_name", "0 AS distance").join(words.selectExpr("ord", "word AS nearest"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("ord", "word"))
    dealt = written(words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks))).withColumn("rank", rank), "dealt-words")
    names = names.withColumn("home", F.pmod(F.xxhash64("_name"), F.lit(blocks)))
    first = written(_in_blocks(names.select("_name", F.col("home").alias("block"), F.lit(None).cast("int").alias("most")), n, dealt, blocks), "trie-words")
    if blocks == 1:
        return first
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda b: b != F.col("home")))
    asked = names.join(first.select("_name", F.col("distance").alias("most")), "_name", "left").select("_name", others.alias("block"), "most")
    more = _in_blocks(asked, n * (blocks - 1), dealt, blocks)
    return first.unionByName(more).groupBy("_name").agg(F.min(F.struct("distance", "ord", "nearest")).alias("b")).select("_name", "b.*")


def _in_blocks(asked: DataFrame, n: int, words: DataFrame, blocks: int) -> DataFrame:
    """Rows (_name, block, most) with their block's nearest word within `most` edits, any if that is null. `n`: how many rows there are, about."""
    fewest, many = TRIE_NAMES
    pieces = max(1, min(-(-n // (blocks * fewest)), max(-(-2 * asked.sparkSession.sparkContext.defaultParallelism // blocks), -(-n // (blocks * many)))))
    own = words.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    asked = asked.withColumn("piece", F.pmod(F.xxhash64("_name", F.lit(1)), F.lit(pieces)))
    schema = StructType([StructField("_name", StringType()), StructField("distance", IntegerType()), *(StructField(k, words.schema[w].dataType) for k, w in (("ord", "ord"), ("nearest", "word")))])

    def look_up(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        texts, most, place, distance, at = own["_name"].to_pylist(), own["most"].to_pylist(), [], [], []
        tree = trie.Trie(dictionary["word"].to_pylist() if texts else [], dictionary["rank"].to_pylist() if texts else [])
        for bound in set(most):
            mine = [i for i, b in enumerate(most) if b == bound]
            far, found = tree.nearest([texts[i] for i in mine]) if bound is None else tree.within([texts[i] for i in mine], bound)
            for i, d, w in zip(mine, far.tolist(), found.tolist(), strict=True):
                if w >= 0:
                    place.append(i)
                    distance.append(d)
                    at.append(w)
        at = pa.array(at, pa.int64())
        columns = [own["_name"].take(pa.array(place, pa.int64())), pa.array(distance, pa.int32()), dictionary["ord"].take(at), dictionary["word"].take(at)]
        return pa.table(columns, names=["_name", "distance", "ord", "nearest"])

    by, tasks = ["block", "piece"], 2 * blocks * pieces
    return asked.repartition(tasks, *by).groupBy(*by).cogroup(own.repartition(tasks, *by).groupBy(*by)).applyInArrow(look_up, schema)


def _nearest_of(names: DataFrame) -> DataFrame:
    """_name, distance, ord, nearest: the best of an array `words` (ord, word) beside each name."""
    scored = F.transform("words", lambda w: F.struct(F.levenshtein(F.col("_name"), w["word"]).alias("distance"), w["ord"].alias("ord"), w["word"].alias("nearest")))
    return names.select("_name", F.array_min(scored).alias("b")).where("b is not null").select("_name", "b.*")


def near_words(names: DataFrame, words: DataFrame, bound: int) -> DataFrame | None:
    """_name, distance, ord, nearest: for names with a word within `bound` edits, the nearest one; None where that makes many rows.

    Candidates share a part (_parts) or what is left without some letters (_by_letters). The first way makes many pairs where words
    have parts in common, the second many rows where they are long; counts of keys and lengths tell which makes less.
    """
    asked, own = _parts(names, words, bound)
    key = ["n", "k", "part"]
    pairs = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("a")).join(own.groupBy(*key).agg(F.count(F.lit(1)).alias("b")), key).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0]
    lengths = lambda df, c: {r["n"]: r["count"] for r in df.groupBy(F.length(c).alias("n")).count().collect()}
    m, n = lengths(names, "_name"), lengths(words, "word")
    met = {(x, y): _left_out(x, y, bound) for x in m for y in n if abs(x - y) <= bound}
    sent = sum(m[x] * math.comb(x, out) for (x, _), (out, _) in met.items())
    kept = sum(n[y] * math.comb(y, out) for y, out in {(y, out) for (_, y), (_, out) in met.items()})
    pairs = pairs or 0
    if bound > NEAR[0] and min(pairs, sent + kept) > EACH * (sum(m.values()) + sum(n.values())):
        return None
    found = asked.join(own, key) if pairs <= sent + kept else _by_letters(names, words, met, sent, kept)
    found = found.withColumn("distance", F.levenshtein(F.col("_name"), F.col("word"), bound)).where("distance >= 0")
    return found.groupBy("_name").agg(F.min(F.struct("distance", "ord", F.col("word").alias("nearest"))).alias("b")).select("_name", "b.*")


def _left_out(m: int, n: int, bound: int) -> tuple[int, int]:
    """How many letters a name of m and a word of n letters lose at most where they are within that many edits.

    A substitution takes one of each, the others one of either, and the lengths differ by those; so the shorter one loses
    at most what the difference leaves of the edits. To lose more than need be keeps the rest equal.
    """
    shorter = min(bound - abs(m - n), m, n)
    return shorter + max(0, m - n), shorter + max(0, n - m)


def _without(rows: DataFrame, text: str, out: Column, most: int) -> DataFrame:
    """Rows with `left`: the text without `out` letters, once for each choice of them."""
    rows = rows.withColumns({"left": F.col(text), "last": F.length(text) + 1, "out": out})
    for k in range(1, most + 1):  # letters go from the back
        places = F.when(F.col("out") < k, F.array(F.lit(0))).when(F.col("last") > 1, F.sequence(F.lit(1), F.col("last") - 1))
        rows = rows.withColumn("at", F.explode(places))
        # Of equal letters side by side the last ones go, since the others leave the same.
        rows = rows.where((F.col("at") == 0) | (F.col("at") + 1 == F.col("last")) | (F.col("left").substr(F.col("at"), F.lit(1)) != F.col("left").substr(F.col("at") + 1, F.lit(1))))
        rows = rows.withColumns({"left": F.when(F.col("at") == 0, F.col("left")).otherwise(F.concat(F.substring("left", 1, F.col("at") - 1), F.col("left").substr(F.col("at") + 1, F.length("left")))), "last": F.when(F.col("at") == 0, F.col("last")).otherwise(F.col("at"))})
    return rows.drop("last", "at", "out")


def _by_letters(names: DataFrame, words: DataFrame, met: dict[tuple[int, int], tuple[int, int]], sent: int, kept: int) -> DataFrame:
    """Pairs of a name and a word that are equal without the letters that `met` allows for their lengths."""
    listed = lambda own: F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in zip(("n", "y", "x"), o, strict=False)]) for o in sorted(own)])
    by_name: dict[int, set] = {}
    by_word: dict[int, set] = {}
    for (m, n), (x, y) in met.items():
        by_name.setdefault(m, set()).add((n, y, x))
        by_word.setdefault(n, set()).add((n, y))
    if not met:
        return names.crossJoin(words).where("false")
    choose = lambda c, by: F.explode(_case(F.length(c), {k: listed(v) for k, v in by.items()})).alias("p")
    asked = names.repartition(1 + sent // TASK_ROWS).select("_name", choose("_name", by_name)).select("_name", "p.*")
    asked = _without(asked, "_name", F.col("x"), max(x for x, _ in met.values())).select("_name", "n", "y", F.xxhash64("left").alias("h")).distinct()
    own = words.repartition(1 + kept // TASK_ROWS).select("word", "ord", choose("word", by_word)).select("word", "ord", "p.*")
    own = _without(own, "word", F.col("y"), max(y for _, y in met.values())).select("word", "ord", "n", "y", F.xxhash64("left").alias("h"))
    return asked.join(own, ["n", "y", "h"])


def _case(value: Column, by: dict[int, Column]) -> Column:
    return reduce(lambda c, k: c.when(value == k, by[k]), by, F.when(F.lit(False), None))


def _parts(names: DataFrame, words: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """Names and words by equal parts of words.

    A word is cut into bound + 1 parts of equal length, of which that many edits leave one whole; it stands in the
    name at most `bound` places away. So a word's parts and a name's substrings of such lengths at such
    places are keys, with the word's length and the part's number. Words of no more than `bound` characters go
    by their length alone.
    """
    parts = bound + 1

    def begin(n: Column, k: Column) -> Column:  # of equal parts the last ones have a character more
        return k * (n.cast("int") / parts).cast("int") + F.greatest(F.lit(0), k - (parts - n % parts))

    def piece(text: Column, n: Column, k: Column, shift: Column) -> Column:
        return F.when(n <= bound, F.lit("")).otherwise(text.substr(begin(n, k) + shift + 1, begin(n, k + 1) - begin(n, k)))

    numbers = lambda low, high: F.array(*[F.lit(x) for x in range(low, high + 1)])
    size = F.length("word")
    own = words.select("word", "ord", size.alias("n"), F.explode(F.when(size <= bound, F.array(F.lit(0))).otherwise(numbers(0, bound))).alias("k"))
    own = own.withColumn("part", piece(F.col("word"), F.col("n"), F.col("k"), F.lit(0)))
    asked = names.select("_name", F.explode(F.transform(numbers(-bound, bound), lambda x: F.length("_name") + x)).alias("n")).where("n >= 0")
    asked = asked.select("_name", "n", F.explode(F.when(F.col("n") <= bound, F.array(F.lit(0))).otherwise(numbers(0, bound))).alias("k"))
    asked = asked.select("_name", "n", "k", F.explode(F.when(F.col("n") <= bound, F.array(F.lit(0))).otherwise(numbers(-bound, bound))).alias("shift"))
    at = begin(F.col("n"), F.col("k")) + F.col("shift")
    asked = asked.where((F.col("n") <= bound) | ((at >= 0) & (at + begin(F.col("n"), F.col("k") + 1) - begin(F.col("n"), F.col("k")) <= F.length("_name"))))
    asked = asked.select("_name", "n", "k", piece(F.col("_name"), F.col("n"), F.col("k"), F.col("shift")).alias("part")).distinct()
    return asked, own


def kth_occurrence(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list, payload: list[str]) -> DataFrame:
    """The k-th row of each key on the left meets the k-th row of that key on the right; others stay alone."""
    a = left.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)).cast("long"))
    b = right.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)).cast("long")).select(*keys, "k", *payload)
    return a.join(b, [*keys, "k"], "left")


def action_slots(rows: DataFrame, group: str, action: str, order: list[str], actions: list[str], payload: str) -> DataFrame:
    """For each group and required action the first row with that action, or null, in the order of the actions."""
    first = rows.where(F.col(action).isin(actions)).groupBy(group, action).agg(F.min_by(payload, F.struct(*order)).alias(payload))
    slots = rows.select(group).where(F.col(group).isNotNull()).distinct().select(group, F.posexplode(F.array(*[F.lit(a) for a in actions])).alias("slot", action))
    return slots.join(first, [group, action], "left")


def first_by_rank(rows: DataFrame, keys: list[str], rank: Column, value: str) -> DataFrame:
    """The value of the best-ranked candidate per key."""
    return rows.groupBy(*keys).agg(F.min_by(F.col(value), rank).alias(value))


def three_step_fallback(wanted: DataFrame, key: str, sets: DataFrame, set_key: str, ord_: str, value: str) -> DataFrame:
    """The set of the key, else the first set without a key, else the first set. The set is chosen whole, never retried."""
    exact = sets.where(F.col(set_key).isNotNull()).groupBy(F.col(set_key).alias("_k")).agg(F.min_by(value, ord_).alias("exact"))
    rest = sets.agg(F.min_by(F.when(F.col(set_key).isNull(), F.struct(F.col(value).alias("v"))), F.when(F.col(set_key).isNull(), F.col(ord_))).alias("open"), F.min_by(F.struct(F.col(value).alias("v")), ord_).alias("any"))
    joined = wanted.join(exact, wanted[key] == exact["_k"], "left").crossJoin(F.broadcast(rest))
    step = F.when(F.col("_k").isNotNull(), 1).when(F.col("open").isNotNull(), 2).when(F.col("any").isNotNull(), 3)
    return joined.select(*[wanted[c] for c in wanted.columns], F.when(F.col("_k").isNotNull(), F.col("exact")).otherwise(F.coalesce("open.v", "any.v")).alias(value), step.alias("step"))


def tree_overlay(attributes: DataFrame, enums: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel trees joined on their path; enum and tag nodes attach only where they are arrays."""
    is_array = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(c))).startswith("ARRAY"), F.lit(False))
    e = enums.where(is_array("enums")).select(*keys, "enums")
    t = tags.where(is_array("tags")).select(*keys, "tags")
    return attributes.join(e, keys, "left").join(t, keys, "left")


def kb_merge(existing: DataFrame, new: DataFrame, ord_: str) -> DataFrame:
    """Knowledge base (key, info): existing keys are never overwritten; of new ones the first counts."""
    fresh = new.groupBy("key").agg(F.min_by("info", ord_).alias("info"))
    return existing.select("key", "info").unionByName(fresh.join(existing, "key", "left_anti"))


def kb_lookup(rows: DataFrame, suffix: str, kb: DataFrame) -> DataFrame:
    """Info of any domain and version whose key ends in the suffix; the first key in order wins."""
    known = kb.withColumn("_s", T.kb_suffix(F.col("key"))).where("_s is not null").groupBy("_s").agg(F.min_by("info", "key").alias("kb_info"))
    return rows.join(known, rows[suffix] == known["_s"], "left").drop("_s")


def resolve_refs(edges: DataFrame, start: str = "src", ref: str = "dst") -> DataFrame:
    """Reference chains: root, node, hops for each source and every target reached, with its least distance.

    Breadth first: a round follows the edges of what the last one reached and drops what is known, so a
    pair is followed once however many ways lead to it, cycles end by themselves, and there is no limit of
    levels or rows. A root is no target of its own, but for an edge to itself. Null ends are no edges.
    """
    e = written(edges.select(F.col(start).alias("s"), F.col(ref).alias("d")).where("s is not null and d is not null").distinct(), "ref-edges")
    rounds = [e.select(F.col("s").alias("root"), F.col("d").alias("node"), F.lit(1).alias("hops"))]
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        step = rounds[-1].join(e, F.col("node") == F.col("s")).select("root", F.col("d").alias("node")).where("root <> node").distinct()
        step = written(step.join(known, ["root", "node"], "left_anti").withColumn("hops", F.lit(len(rounds) + 1)), "ref-round")
        if step.isEmpty():
            return known
        rounds.append(step)
