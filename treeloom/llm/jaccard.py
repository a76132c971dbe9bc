"""Exact n-gram Jaccard join and its components.

Sets are the distinct 5-word shingles of lower-cased texts. Two sets link when
100 * |intersection| >= 75 * |union|.

1. Equal sets are one class with one representative (a 128-bit fingerprint and the size).
2. Document frequencies of all shingles come from an exchange by bucket (see chunks). They only order
   shingles, rare ones first, so the exchange uses shortened keys: any order that is the same for
   all sets gives a correct prefix filter.
3. Two similar sets share a shingle of their prefixes (the first n - ceil(0.75 n) + 1 shingles).
   Sets that share none are never compared. What prefixes connect falls into groups, which only say
   what may be put into one unit: a group is cut into blocks, by size class (two similar sets are in the
   same or neighbouring classes) and by hash into bounded ones.
4. A group whose classes are one block each is joined class by class. Otherwise a set goes to the
   blocks that hold a set with which it shares a prefix shingle, and to no others, so that a large, loosely
   connected group costs what its candidates cost and not the square of its blocks; each pair of blocks is one
   unit. In a unit, inverted lists of
   prefix shingles are sorted by how many shingles follow, so that all entries whose position
   can't reach the overlap are skipped at once; and the overlaps of a set are derived from those of
   a similar set that has been answered, by going through the lists of the difference only.
5. Links inside units give spanning edges and counts; components are joined up over units.

A unit never emits pairs: a row per set with its root in the unit and its number of links.

Nulls: a null or empty text has the empty set, links with nothing and is its own component. A null
doc_id is larger than any other; a component of such rows alone has a null component_id. Repeated
rows are copies of each other; of equally frequent shingles the one with the smaller hash comes first. Texts of any
length are read whole. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks, common, components, words

SHINGLE = 5
#: Similarity in per cent.
PERCENT = 75
#: A unit holds about so many sets and shingles of each of its two blocks.
UNIT_SETS, UNIT_SHINGLES = 1024, 1_000_000


def sets_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and n+1 offsets."""
    w = chunks.split_chunk(data, offs, lower=True)
    h, left, text = words.windows(w.hashes, SHINGLE), w.left(), w.text_of()
    ok = np.flatnonzero(left[: len(h)] >= SHINGLE)
    parts, owner = [h[ok]], [text[ok]]
    size = w.counts
    for n in range(1, SHINGLE):  # a short text is one shingle
        short = np.flatnonzero(size == n)
        if len(short):
            first = w.first[short]
            x = words.windows(w.hashes, n)
            parts.append(x[first])
            owner.append(short)
    h, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(offs)))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any similar one, at least."""
    return -(-percent * n // 100)


INFO = {"rid": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "f1": pa.int64(), "f2": pa.int64()}


def _infos(batches):
    for b in batches:
        for row in b.to_pylist():
            chunk, ids, data, offs = chunks.rows_of(row)
            h, at = sets_of(data, offs)
            n = np.diff(at)
            sums = []
            for x in (words.mix(h), words.mix(h * words._BASE + words.U(1))):
                total = np.concatenate([np.zeros(1, words.U), np.cumsum(x)])
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            yield chunks.batch({"rid": (chunk << chunks.ROW_BITS) + np.arange(len(ids)), "doc_id": ids, "n": n, "f1": sums[0], "f2": sums[1]}, INFO)


def _keys_of(buckets: int):
    """Shortened shingles of a chunk's sets and the number of sets that have each."""

    def run(row: dict):
        _, _, data, offs = chunks.rows_of(row)
        yield 1, *np.unique(chunks.short_keys(sets_of(data, offs)[0], buckets)[0], return_counts=True)

    return run


#: n is the size of the whole set, prefix the number of leading shingles to index, shared the set's shingles with a frequency over 1 in order.
SET = {"rid": pa.int64(), "n": pa.int64(), "prefix": pa.list_(pa.int64()), "shared": pa.binary()}


#: The kind of the rows that tell a chunk's representatives; they travel with the sums.
REPRESENTATIVES = -1


def _prefixes(buckets: int, percent: int):
    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in SET}
        found = got.to_pylist()
        for row in own.to_pylist():
            chunk, _, data, offs = chunks.rows_of(row)
            h, at = sets_of(data, offs)
            short = chunks.short_keys(h, buckets)[0]
            keys = np.unique(short)
            counts = chunks.sums_of(found, 1)
            assert len(counts) == len(keys), "a sum is missing"
            df = counts[np.searchsorted(keys, short)]
            for r in found:
                if r["kind"] == REPRESENTATIVES:
                    for k in common.unpack_numbers(r["counts"]).astype(np.int64):
                        x, f = h[at[k] : at[k + 1]], df[at[k] : at[k + 1]]
                        n = len(x)
                        alone = int((f == 1).sum())
                        p = n - least_overlap(n, percent) + 1 - alone
                        if p > 0 and alone < n:
                            many = f > 1
                            x, f = x[many], f[many]
                            x = x[np.lexsort((x, f))]
                            out["rid"].append((chunk << chunks.ROW_BITS) + int(k))
                            out["n"].append(n)
                            out["prefix"].append(x[:p].view(np.int64))
                            out["shared"].append(common.blob(x))
        return pa.Table.from_batches([chunks.batch(out, SET)])

    return run


class Unit:
    """Sets that are compared with each other; with two sides only pairs across count, also where one side has no sets."""

    def __init__(self, rids, n, prefix, shared, side, weight, percent: int = PERCENT, two_sided: bool | None = None):
        order = np.lexsort((rids, n))
        take = lambda x: [x[k] for k in order]
        self.rids, self.n = np.asarray(rids, np.int64)[order], np.asarray(n, np.int64)[order]
        self.side, self.weight = np.asarray(side)[order], np.asarray(weight, np.int64)[order]
        self.two_sided = len(np.unique(self.side)) > 1 if two_sided is None else two_sided
        self.percent = percent
        sets = [np.frombuffer(x, words.U) for x in take(shared)]
        self.prefix_size = np.asarray(take(prefix), np.int64)
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([np.zeros(0, words.U), *sets])
        vocabulary, ids = np.unique(flat, return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.ids = ids
        owner = np.repeat(np.arange(len(sets)), size)
        place = np.arange(len(flat)) - np.repeat(self.begin[:-1], size)
        self.lists, self.list_at = self._index(ids, owner, np.zeros(len(flat), np.int64), len(vocabulary))
        lead = place < self.prefix_size[owner]
        # Shingles from this one on, in the whole set's order: those with a frequency of 1 come before.
        after = (size[owner] - place)[lead]
        self.leading, self.lead_at = self._index(ids[lead], owner[lead], -after, len(vocabulary))
        self.lead_after = self._after_sorted(ids[lead], -after)
        self.parent = np.arange(len(sets))
        self.links = np.zeros(len(sets), np.int64)

    @staticmethod
    def _index(ids, owner, rank, n):
        order = np.lexsort((rank, ids))
        return owner[order], np.searchsorted(ids[order], np.arange(n + 1))

    @staticmethod
    def _after_sorted(ids, rank):
        order = np.lexsort((rank, ids))
        return rank[order]  # minus the number that follow: ascending inside a list

    def _find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def _candidates(self, x: int) -> np.ndarray:
        """Sets that share a prefix shingle with x at a place from which the overlap can be reached."""
        need = least_overlap(int(self.n[x]), self.percent)
        found = []
        for k in range(self.prefix_size[x]):
            t = self.ids[self.begin[x] + k]
            a, z = self.lead_at[t], self.lead_at[t + 1]
            if self.begin[x + 1] - self.begin[x] - k < need:
                break  # too few shingles of x follow
            stop = a + np.searchsorted(self.lead_after[a:z], -need, "right")  # the rest of the list is skipped
            found.append(self.leading[a:stop])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _lists_of(self, ids: np.ndarray) -> np.ndarray:
        """All sets that hold each of the shingles, counted."""
        a, z = self.list_at[ids], self.list_at[ids + 1]
        size = z - a
        if not size.sum():
            return np.zeros(len(self.n), np.int64)
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        return np.bincount(self.lists[at], minlength=len(self.n))

    def join(self) -> None:
        """Overlaps set by set. A set next to an answered, similar one goes through the difference only."""
        base, base_ids, base_counts = -1, None, None
        todo = np.ones(len(self.n), bool)
        queue: list[int] = []
        for start in range(len(self.n)):
            queue.append(start)
            while queue:
                x = queue.pop()
                if not todo[x]:
                    continue
                todo[x] = False
                candidates = self._candidates(x)
                candidates = candidates[candidates != x]
                if self.two_sided:
                    candidates = candidates[self.side[candidates] != self.side[x]]
                if not len(candidates):
                    continue
                own = self.ids[self.begin[x] : self.begin[x + 1]]
                if base >= 0 and 2 * base_counts[x] > len(own):
                    counts = base_counts + self._lists_of(np.setdiff1d(own, base_ids, assume_unique=True)) - self._lists_of(np.setdiff1d(base_ids, own, assume_unique=True))
                else:
                    counts = self._lists_of(own)
                    base, base_ids, base_counts = x, own, counts
                both = counts[candidates]
                linked = candidates[100 * both >= self.percent * (self.n[candidates] + self.n[x] - both)]
                self.links[x] = self.weight[linked].sum()
                root = self._find(x)
                for y in linked:
                    other = self._find(int(y))
                    if other != root:
                        low, high = (root, other) if self.rids[root] < self.rids[other] else (other, root)
                        self.parent[high] = low
                        root = low
                queue.extend(y for y in linked[::-1].tolist() if todo[y])

    def result(self) -> dict:
        return {"rid": self.rids, "root": self.rids[[self._find(k) for k in range(len(self.n))]], "links": self.links}


EDGE = {"rid": pa.int64(), "root": pa.int64(), "links": pa.int64()}


def _join_unit(percent: int):
    def run(table: pa.Table) -> pa.Table:
        c = {k: table.column(k).to_pylist() for k in ("rid", "n", "prefix", "shared", "side", "weight")}
        up, a, b = (table.column(k)[0].as_py() for k in ("up", "a", "b"))
        unit = Unit(c["rid"], c["n"], c["prefix"], c["shared"], c["side"], c["weight"], percent, up == 1 or a != b)
        unit.join()
        return pa.Table.from_batches([chunks.batch(unit.result(), EDGE)])

    return run


def _units(spark: SparkSession, sets: DataFrame, postings: DataFrame, groups: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """A row per set and unit. postings: rid, shingle of the prefixes that more than one set has."""
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    rows = sets.join(groups, sets.rid == groups.node).join(weights, sets.rid == weights.w_rid)
    rows = rows.select("rid", "n", F.size("prefix").alias("prefix"), "shared", "weight", F.col("root").alias("group"), F.floor(F.log("n") / step + 1e-9).cast("int").alias("kind"))
    rows = common.materialize(spark, rows, "jaccard-grouped")
    sizes = rows.groupBy("group", "kind").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("shared") / 8).alias("t"))
    sizes = sizes.select(F.col("group").alias("g"), F.col("kind").alias("k"), F.ceil(F.greatest(F.col("c") / UNIT_SETS, F.col("t") / UNIT_SHINGLES)).cast("int").alias("blocks"))
    up = sizes.select(F.col("g").alias("g2"), (F.col("k") - 1).alias("k2"), F.col("blocks").alias("next"))
    down = sizes.select(F.col("g").alias("g3"), (F.col("k") + 1).alias("k3"), F.col("blocks").alias("previous"))
    sizes = sizes.join(up, (F.col("g") == F.col("g2")) & (F.col("k") == F.col("k2")), "left").join(down, (F.col("g") == F.col("g3")) & (F.col("k") == F.col("k3")), "left")
    sizes = sizes.select("g", "k", "blocks", F.coalesce("next", F.lit(0)).alias("next"), F.coalesce("previous", F.lit(0)).alias("previous"), F.max("blocks").over(Window.partitionBy("g")).alias("most"))  # a group has a row per class, some dozens
    sizes = common.materialize(spark, sizes, "jaccard-sizes")  # both sides of the join below are then plain exchanges, which Spark splits where a group is hot
    rows = rows.join(sizes, (F.col("group") == F.col("g")) & (F.col("kind") == F.col("k")))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"), "whole": F.col("most") <= 1}).drop("g", "k", "blocks", "most")
    unit = lambda kind, up, a, b, side: F.struct(kind.alias("kind"), F.lit(up).alias("up"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    kind, block = F.col("kind"), F.col("block")
    every = F.array_compact(F.array(unit(kind, 0, zero, zero, zero), F.when(F.col("next") > 0, unit(kind, 1, zero, zero, zero)), F.when(F.col("previous") > 0, unit(kind - 1, 1, zero, zero, one))))
    direct = rows.where("whole").withColumn("units", every)
    # Blocks of the others: those of the sets on the lists of their prefix shingles.
    large = common.materialize(spark, postings.join(rows.where("not whole").select("rid", "kind", "block"), "rid"), "jaccard-large")
    lists = large.groupBy("shingle").agg(F.collect_set(F.struct("kind", "block")).alias("places"))
    lists = common.materialize(spark, lists.select("shingle", F.sort_array("places").alias("places")), "jaccard-lists")
    near = large.select("rid", "shingle").join(lists, "shingle").groupBy(F.col("rid").alias("p_rid")).agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))

    def meet(p: Column) -> Column:
        same = unit(kind, 0, F.least(block, p["block"]), F.greatest(block, p["block"]), p["block"] < block)
        return F.when(p["kind"] == kind, same).when(p["kind"] == kind + 1, unit(kind, 1, block, p["block"], zero)).when(p["kind"] == kind - 1, unit(kind - 1, 1, p["block"], block, one))

    others = rows.where("not whole").join(near, F.col("rid") == F.col("p_rid")).drop("p_rid")
    others = others.withColumn("units", F.array_compact(F.transform("places", meet))).drop("places")
    found = direct.unionByName(others).select("rid", "n", "prefix", "shared", "weight", "group", F.explode("units").alias("u"))
    return found.select("rid", "n", "prefix", "shared", "weight", "group", "u.kind", "u.up", "u.a", "u.b", F.col("u.side").cast("bigint").alias("side"))


def join(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid (a number of the row), n_shingles, component_id, n_links (similar other documents) for every row of docs."""
    packed = chunks.pack(spark, docs)
    buckets = chunks.bucket_count(packed)
    infos = common.materialize(spark, packed.mapInArrow(_infos, chunks.ddl(INFO)), "jaccard-sets")
    classes = infos.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("rid").alias("w_rid"), F.count(F.lit(1)).alias("weight"))
    classes = common.materialize(spark, classes, "jaccard-classes")
    reps = classes.groupBy(F.shiftright("w_rid", chunks.ROW_BITS).alias("chunk")).agg(F.sort_array(F.collect_list((F.col("w_rid") % (1 << chunks.ROW_BITS)).cast("int"))).alias("k"))
    # A chunk's representatives travel with the sums; a chunk has a bounded number of texts.
    reps = reps.mapInArrow(_flags, "kind bigint, slot bigint, sender bigint, counts binary")
    bits = chunks.short_keys(np.zeros(0, words.U), buckets)[1]
    sums, _ = chunks.exchange(spark, packed, _keys_of(buckets), buckets, bits, name="jaccard-frequencies")
    sets = packed.groupBy("chunk").cogroup(sums.unionByName(reps).groupBy("sender")).applyInArrow(_prefixes(buckets, percent), chunks.ddl(SET))
    sets = common.materialize(spark, sets, "jaccard-prefixes")
    postings = sets.select("rid", F.explode("prefix").alias("shingle"))
    firsts = postings.groupBy("shingle").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    postings = common.materialize(spark, postings.join(firsts, "shingle").select("rid", "shingle", "first"), "jaccard-postings")
    stars = postings.where("rid <> first").select(F.col("rid").alias("a"), F.col("first").alias("b")).distinct()
    groups = components.connected(spark, stars)
    units = _units(spark, sets, postings.select("rid", "shingle"), groups, classes.select("w_rid", "weight"), percent)
    found = units.groupBy("group", "kind", "up", "a", "b").applyInArrow(_join_unit(percent), chunks.ddl(EDGE))
    found = common.materialize(spark, found, "jaccard-links")
    roots = components.connected(spark, found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    by_class = classes.join(roots, classes.w_rid == roots.node, "left").join(links, classes.w_rid == links.rid, "left")
    by_class = by_class.select("f1", "f2", "n", F.coalesce("root", "w_rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rows = infos.where("n > 0").join(by_class, ["f1", "f2", "n"]).select("rid", "doc_id", "n", "root", "n_links")
    rows = common.materialize(spark, rows, "jaccard-rows")
    least = rows.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    least = common.materialize(spark, least, "jaccard-components")  # a plain exchange on both sides, so that a hot component is split
    linked = rows.join(least, rows.root == least.r).select("doc_id", "rid", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = infos.where("n = 0").select("doc_id", "rid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def _flags(batches):
    for b in batches:
        n = b.num_rows
        packed = [common.pack_numbers(np.array(k, np.uint64)) for k in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([REPRESENTATIVES] * n, pa.int64()), pa.array([0] * n, pa.int64()), b.column(0), pa.array(packed, pa.binary())], names=["kind", "slot", "sender", "counts"])
