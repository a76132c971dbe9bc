"""Phrases of two and three words whose words attract each other, by language.

1. Candidates, Apriori: an exchange over all chunks (chunks.exchange) adds up the counts of words and pairs by
   their 64-bit keys. Triples are asked for, in a second one, only where both of their pairs are frequent. Of a key's
   chunks one is its teller: it alone goes on with the phrase as text, with the corpus-wide count.
2. Phrases are dealt to shards by their keys. A shard's get slots by a minimal perfect hash; a slot keeps its
   phrase, with which every lookup is compared, and phrases of one key have slots of their own.
3. Counts are put in slots by groups of tellers' rows; the arrays are summed up in a tree.
4. Each shard asks the shards of its phrases' parts, which read the counts by slot. Scores are computed with whole numbers of any size.

Keys are verified: each chunk adds up a second hash, from the text, over all its occurrences of frequent phrases; tellers
take off their phrase's, times its count. The sum over the corpus is zero if all occurrences counted under a key are of its phrase (but
for a chance of 2 ** -64). If it isn't, all is counted again with other hashes.

A phrase's text is shuffled once per corpus, its key once per chunk. No task's rows grow with the corpus, and
a phrase that is in every text is a key per chunk. Shards follow the bytes of text up to MOST_SHARDS.

Nulls: a null language is `und`, a null text empty; doc_ids aren't read. Repeated rows count as often as they occur.
Ties of score go by count, then by the phrase's bytes, which no two share. Texts of any length are read whole; empty
texts have no words. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks, common, words
from .perfect_hash import StoredKeys

#: Words of the longest phrase, least count of a phrase, phrases returned for a language.
LONGEST, LEAST, BEST = 3, 10, 2000
#: Percent of a phrase's occurrences that lie inside a longer one, from which on it's dropped.
INSIDE = 50
#: Bytes of text for a shard and shards, at most; entries of a mapper; arrays that one task sums up.
SHARD_BYTES, MOST_SHARDS, GROUP_ENTRIES, FAN_IN = 16 << 20, 1 << 16, 1 << 19, 64

#: Bytes that end a piece, and bytes of words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

TRIPLES = {"chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
ENTRIES = {"shard": pa.int64(), "sender": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "names": pa.binary()}
SENT = ENTRIES | {"check": pa.int64()}
INDEX = {"shard": pa.int64(), "keys": pa.binary(), "names": pa.binary()}
ARRAYS = {"shard": pa.int64(), "part": pa.int64(), "counts": pa.binary()}
SLOTS = INDEX | {"counts": pa.binary()}
ASKED = {"target": pa.int64(), "shard": pa.int64(), "keys": pa.binary(), "names": pa.binary()}
TOLD = {"shard": pa.int64(), "names": pa.binary(), "counts": pa.binary()}
FOUND = {"lang_key": pa.int64(), "phrase": pa.string(), "a": pa.int64(), "l": pa.int64(), "r": pa.int64(), "score": pa.int64(), "hides": pa.list_(pa.string())}


def _ddl(schema: dict) -> str:
    return chunks.ddl({k: t for k, t in schema.items() if k != "hides"}) + (", hides array<string>" if "hides" in schema else "")


# A name is the language's key in 16 hexadecimal digits and the phrase; no name has a line end.


def _pack_names(names: list[bytes]) -> bytes:
    return common.squeeze(np.frombuffer(b"\n".join(names), np.uint8))


def _names(packed: bytes) -> pa.Array:
    raw = common.expand(packed, np.uint8).tobytes()
    return pa.array(raw.split(b"\n") if raw else [], pa.binary())


def _turned(salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Another byte for each byte, so that words get other hashes with another salt; and which ones are of words."""
    turn = np.random.default_rng(salt).permutation(256).astype(np.uint8) if salt else np.arange(256, dtype=np.uint8)
    word = np.empty(256, bool)
    word[turn] = WORD
    return turn, word


def _language(ids) -> np.ndarray:
    return np.array(ids, np.int64).view(words.U)


def _mixed(hashes: np.ndarray, k: int, language: np.ndarray) -> np.ndarray:
    """Keys of the k words from each word on; language has each word's."""
    found = words.windows(hashes, k)
    return words.mix(found ^ words.mix(language[: len(found)]))


def keys_of_names(names: pa.Array, salt: int = 0) -> np.ndarray:
    """The keys that texts give to these phrases."""
    own = names.to_pylist()
    phrases = [x[16:] for x in own]
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))]).astype(np.int64)
    turn, word = _turned(salt)
    found = words.split(turn[np.frombuffer(b"".join(phrases), np.uint8)], offs, word)
    language = np.array([int(x[:16], 16) for x in own], words.U)
    keys = np.zeros(len(own), words.U)
    for k in range(1, LONGEST + 1):
        some = np.flatnonzero(found.counts == k)
        if len(some):
            keys[some] = words.mix(words.windows(found.hashes, k)[found.first[some]] ^ words.mix(language[some]))
    return keys


class Phrases:
    """A chunk's words, and the keys of its words, pairs and triples inside pieces."""

    def __init__(self, row: dict, salt: int = 0):
        self.chunk, ids, data, self.offs = chunks.rows_of(row)
        self.data, parts, offs = words.LOWER[data], [], self.offs
        for i, w in self._split(salt):
            parts.append((w.hashes, w.starts + offs[i], w.ends + offs[i], w.text_of() + i))
        self.hashes, self.starts, self.ends, text = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, words.U if not k else np.int64) for k in range(4))
        self.language = _language(ids)[text]
        breaks = np.cumsum(BREAK[self.data], dtype=np.int32)
        self.joined = np.zeros(len(text), bool)  # whether the next word is of the same piece
        self.joined[:-1] = (text[1:] == text[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1] - 1])

    def _split(self, salt: int):
        turn, word = _turned(salt)
        for i, _, b, o in common.pieces(self.data, self.offs, 2 << 20):
            yield i, words.split(turn[b], o, word)

    def second(self, salt: int) -> np.ndarray:
        """Other hashes of the words."""
        return np.concatenate([np.zeros(0, words.U), *(w.hashes for _, w in self._split(salt))])

    def places(self, k: int) -> np.ndarray:
        """The words at which a phrase of k words begins."""
        ok = np.ones(max(0, len(self.hashes) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + len(ok)]
        return np.flatnonzero(ok)

    def keys(self, k: int, places: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes, k, self.language)[places]

    def names(self, places: np.ndarray, k: int) -> list[bytes]:
        raw, out = self.data.tobytes(), []
        plain = np.zeros(len(self.starts), bool)
        plain[:-1] = (self.starts[1:] - self.ends[:-1] == 1) & (self.data[self.ends[:-1]] == 0x20)
        direct = np.ones(len(places), bool)
        for j in range(k - 1):
            direct &= plain[places + j]
        prefix = {x: b"%016x" % x for x in np.unique(self.language).tolist()}
        for at, a, z, lang, whole in zip(places.tolist(), self.starts[places].tolist(), self.ends[places + k - 1].tolist(), self.language[places].tolist(), direct.tolist(), strict=True):
            out.append(prefix[lang] + (raw[a:z] if whole else b" ".join(raw[self.starts[j] : self.ends[j]] for j in range(at, at + k))))
        return out

    def told(self, kind: int, places: np.ndarray, replies: list[dict]) -> tuple[np.ndarray, ...]:
        """Distinct keys of the phrases that begin at these places, their first ones and each one's number there, and what chunks.exchange tells of them."""
        keys, first, at = np.unique(self.keys(kind, places), return_index=True, return_inverse=True)
        told = chunks.sums_of(replies, kind)
        assert len(told) == len(keys), "a sum is missing"
        return keys, first, at, told

    def triples(self, replies: list[dict]) -> np.ndarray:
        """The words at which two frequent pairs begin one after the other."""
        pair, places = np.zeros(len(self.hashes) + 1, bool), self.places(2)
        _, _, at, told = self.told(2, places, replies)
        pair[places[(told > 0)[at]]] = True
        triples = self.places(3)
        return triples[pair[triples] & pair[triples + 1]]


def _batches(rows: list[dict], schema: dict) -> pa.Table:
    common.release()
    return pa.Table.from_batches([chunks.batch({k: [r[k] for r in rows] for k in schema}, schema)], pa.schema(list(schema.items())))


def _entries(spark: SparkSession, packed: DataFrame, buckets: int, shards: int, least: int, salt: int) -> DataFrame:
    """Per shard and chunk: the frequent phrases that the chunk tells, with their corpus-wide counts. A row without a shard has a chunk's words by language and its part of the check."""

    def pairs_of(row: dict):
        p = Phrases(row, salt)
        for kind in (1, 2):
            yield kind, *np.unique(p.keys(kind, p.places(kind)), return_counts=True)

    def asked(own: pa.Table, got: pa.Table) -> pa.Table:
        replies, out = got.to_pylist(), []
        for row in own.to_pylist():
            p = Phrases(row, salt)
            keys, counts = np.unique(p.keys(3, p.triples(replies)), return_counts=True)
            out.append({"chunk": p.chunk, "keys": common.pack_sorted(keys), "counts": common.pack_numbers(counts)})
        return _batches(out, TRIPLES)

    def triples_of(row: dict):
        yield 3, common.unpack_sorted(row["keys"]), common.unpack_numbers(row["counts"])

    def tell(own: pa.Table, got: pa.Table) -> pa.Table:
        replies, out = got.to_pylist(), []
        for row in own.to_pylist():
            p = Phrases(row, salt)
            other, parts, check = p.second(salt + 1), [], words.U(0)
            for kind in (1, 2, 3):
                places = p.triples(replies) if kind == 3 else p.places(kind)
                keys, first, at, told = p.told(kind, places, replies)
                mine, total = (told & words.U(1)) > 0, told >> words.U(1)
                second = _mixed(other, kind, p.language)[places]
                check = np.sum(second[(told > 0)[at]], initial=check) + np.sum(~(second[first[mine]] * total[mine]) + words.U(1))  # ~x + 1 takes x off
                parts.append((keys[mine], total[mine], pa.array(p.names(places[first[mine]], kind), pa.binary())))
            keys, counts, names = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), pa.concat_arrays([x[2] for x in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts, names = keys[order], counts[order], names.take(pa.array(order))
            bucket = chunks.bucket_of(keys, shards)
            out += [
                {"shard": int(bucket[a]), "sender": p.chunk, "n": z - a, "keys": common.pack_sorted(keys[a:z]), "counts": common.pack_numbers(counts[a:z]), "names": _pack_names(names.slice(a, z - a).to_pylist()), "check": 0}
                for a, z in chunks.runs_of(bucket)
            ]
            languages, n = np.unique(p.language, return_counts=True)
            out.append({"shard": None, "sender": p.chunk, "n": 0, "keys": common.pack_sorted(languages), "counts": common.pack_numbers(n), "names": b"", "check": int(np.array(check, np.uint64).view(np.int64))})
        return _batches(out, SENT)

    pairs, _ = chunks.exchange(spark, packed, pairs_of, buckets, name="phrase-pairs", least=least)
    triples = packed.groupBy("chunk").cogroup(pairs.groupBy("sender")).applyInArrow(asked, _ddl(TRIPLES))
    replies = pairs.unionByName(chunks.exchange(spark, triples, triples_of, buckets, name="phrase-triples", least=least)[0])
    return common.materialize(spark, packed.groupBy("chunk").cogroup(replies.groupBy("sender")).applyInArrow(tell, _ddl(SENT)), "phrase-entries")


def _verified(spark: SparkSession, packed: DataFrame, buckets: int, shards: int, least: int) -> tuple[DataFrame, int]:
    """_entries with hashes that tell all frequent phrases apart, and their salt; what only led to them is deleted."""
    for salt in itertools.count():
        first = len(common.CREATED)
        entries = _entries(spark, packed, buckets, shards, least, salt)
        same = int(entries.agg(F.sum(F.col("check").cast("decimal(38,0)"))).first()[0] or 0) % (1 << 64) == 0
        for path in common.CREATED[first : len(common.CREATED) - same]:
            common.remove(spark, path)
        if same:
            return entries, salt


def _distinct(keys: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct name in the order of keys, and for each name its place among those. Names of one key stand side by side."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    place = first[at]
    for k in np.flatnonzero(~pc.equal(names, names.take(pa.array(place))).to_numpy(zero_copy_only=False)).tolist():
        place[k] = next((j for j in range(k) if keys[j] == keys[k] and names[j] == names[k]), k)  # another name of the key: as rare as equal hashes
    own = np.unique(place)
    own = own[np.argsort(keys[own], kind="stable")]
    number = np.empty(len(keys), np.int64)
    number[own] = np.arange(len(own))
    return own, number[place]


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys, counts and names of several parts, each name once."""
    keys, counts, names = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
    own, at = _distinct(keys, names)
    return keys[own], np.bincount(at, weights=counts, minlength=len(own)).astype(np.uint64), names.take(pa.array(own))


def _joined(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Keys and names of all rows, each name once."""
    rows = table.to_pylist()
    keys, _, names = _merged([(k, np.zeros(len(k), words.U), _names(r["names"])) for r in rows for k in [common.unpack_sorted(r["keys"])]])
    return keys, names


def _tree(df: DataFrame, parts: int, step: Callable[[pa.Table], pa.Table], schema: dict) -> DataFrame:
    """(shard, part) rows put together FAN_IN parts at a time, until a shard has one row."""
    while True:
        df = df.groupBy("shard", "part").applyInArrow(step, _ddl(schema))
        if parts == 1:
            return df
        parts = -(-parts // FAN_IN)
        df = df.withColumn("part", F.expr(f"part div {FAN_IN}" if parts > 1 else "0L"))


def _slots(spark: SparkSession, entries: DataFrame, shards: int) -> DataFrame:
    """Per shard: keys, names and corpus-wide counts by slot."""
    total = int(entries.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, -(-total // (shards * GROUP_ENTRIES)))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("sender"), F.lit(parts)).cast("long"))
    part = {"part": pa.int64()}

    def distinct(table: pa.Table) -> pa.Table:
        keys, names = _joined(table)
        return _batches([{"shard": table["shard"][0].as_py(), "part": table["part"][0].as_py(), "keys": common.pack_sorted(keys), "names": _pack_names(names.to_pylist())}], INDEX | part)

    def count(own: pa.Table, index: pa.Table) -> pa.Table:
        stored, rows = _stored(index.to_pylist()[0]), own.to_pylist()
        found = [stored.find(common.unpack_sorted(r["keys"]), _names(r["names"])) for r in rows]
        slot, counts = np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, words.U), *(common.unpack_numbers(r["counts"]) for r in rows)])
        summed = np.bincount(slot[slot >= 0], weights=counts[slot >= 0], minlength=len(stored)).astype(np.uint64)  # exact up to 2 ** 53
        return _batches([{"shard": r["shard"], "part": r["part"], "counts": common.pack_numbers(summed)} for r in index.to_pylist()], ARRAYS)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return _batches([rows[0] | {"counts": common.pack_numbers(np.sum([common.unpack_numbers(r["counts"]) for r in rows], axis=0, dtype=np.uint64))}], ARRAYS)

    index = common.materialize(spark, _tree(dealt.select("shard", "part", "keys", "names"), parts, distinct, INDEX | part).drop("part"), "phrase-index")
    every = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    arrays = dealt.groupBy("shard", "part").cogroup(every.groupBy("shard", "part")).applyInArrow(count, _ddl(ARRAYS))
    summed = _tree(arrays, parts, add, ARRAYS).select(F.col("shard").alias("s"), "counts")
    return common.materialize(spark, index.join(summed, F.col("shard") == F.col("s")).select(*SLOTS), "phrase-counts")


def _stored(row: dict) -> StoredKeys:
    return StoredKeys(common.unpack_sorted(row["keys"]), _names(row["names"]))


def _phrases(row: dict, least: int) -> dict[bytes, int]:
    """Phrases of a shard's row that occur often enough, with their counts."""
    stored, counts = _stored(row), common.unpack_numbers(row["counts"]).tolist()
    return {name: n for name, n in zip(stored.names.to_pylist(), counts, strict=True) if n >= least and b" " in name}


def _cuts(name: bytes) -> list[tuple[bytes, bytes]]:
    """The two parts of each cut, as names."""
    lang, parts = name[:16], name[16:].split(b" ")
    return [(lang + b" ".join(parts[:k]), lang + b" ".join(parts[k:])) for k in range(1, len(parts))]


def _scored(spark: SparkSession, slots: DataFrame, shards: int, least: int, salt: int) -> DataFrame:
    """Candidates with the cut of the lowest score, and the phrases that they hide."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names = pa.array(sorted({part for name in _phrases(row, least) for cut in _cuts(name) for part in cut}), pa.binary())
                keys = keys_of_names(names, salt)
                order = np.argsort(keys, kind="stable")
                keys, own = keys[order], names.take(pa.array(order)).to_pylist()
                bucket = chunks.bucket_of(keys, shards)
                yield from _batches([{"target": int(bucket[a]), "shard": row["shard"], "keys": common.pack_sorted(keys[a:z]), "names": _pack_names(own[a:z])} for a, z in chunks.runs_of(bucket)], ASKED).to_batches()

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        row, out = own.to_pylist()[0], []
        stored, counts = _stored(row), common.unpack_numbers(row["counts"])
        for r in asked.to_pylist():
            slot = stored.find(common.unpack_sorted(r["keys"]), _names(r["names"]))
            assert (slot >= 0).all(), "a part of a frequent phrase is no candidate"
            out.append({"shard": r["shard"], "names": r["names"], "counts": common.pack_numbers(counts[slot])})
        return _batches(out, TOLD)

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        f = {name: n for r in told.to_pylist() for name, n in zip(_names(r["names"]).to_pylist(), common.unpack_numbers(r["counts"]).tolist(), strict=True)}
        out = []
        for row in own.to_pylist():
            for name, a in _phrases(row, least).items():
                value, left, right = min(((1_000_000 * a * a // (f[x] * f[y]), f[x], f[y]) for x, y in _cuts(name)), key=lambda v: v[0])
                inner = {part: f[part] for cut in _cuts(name) for part in cut if b" " in part}
                out.append({"lang_key": int(np.array(int(name[:16], 16), np.uint64).view(np.int64)), "phrase": name[16:].decode(), "a": a, "l": left, "r": right, "score": value, "hides": [x[16:].decode() for x, n in inner.items() if 100 * a >= INSIDE * n]})
        return _batches(out, FOUND)

    asked = slots.mapInArrow(ask, _ddl(ASKED))
    told = asked.groupBy("target").cogroup(slots.groupBy("shard")).applyInArrow(answer, _ddl(TOLD))
    return common.materialize(spark, slots.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(score, _ddl(FOUND)), "phrase-scores")


def _languages(batches):
    schema = {"lang_key": pa.int64(), "n": pa.int64()}
    for batch in batches:
        for row in batch.to_pylist():
            yield chunks.batch({"lang_key": common.unpack_sorted(row["keys"]).view(np.int64), "n": common.unpack_numbers(row["counts"]).astype(np.int64)}, schema)


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    own = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.col("text").cast("string").alias("text"))
    packed = chunks.pack(spark, own.select(F.col("lang_key").alias("doc_id"), "text"))
    buckets = chunks.bucket_count(packed)
    shards = min(MOST_SHARDS, chunks.bucket_count(packed, SHARD_BYTES))
    folder = common.CREATED[-1]
    entries, salt = _verified(spark, packed, buckets, shards, least)
    common.remove(spark, folder)
    slots = _slots(spark, entries.where("shard is not null").drop("check"), shards)
    found = _scored(spark, slots, shards, least, salt)
    hidden = found.select("lang_key", F.explode("hides").alias("phrase"))
    order = Window.partitionBy("lang_key").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    top = found.drop("hides").join(hidden, ["lang_key", "phrase"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    sizes = entries.where("shard is null").mapInArrow(_languages, "lang_key bigint, n bigint").groupBy("lang_key").agg(F.sum("n").alias("n"))
    names = own.groupBy("lang_key").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"))
    named = names.select("lang_key", F.when(F.col("lang") == F.col("other"), F.col("lang")).otherwise(F.raise_error(F.lit("two languages have one hash"))).alias("lang"))
    return top.join(sizes, "lang_key").join(named, "lang_key").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
