"""Alignment of two tokenizers over the same bytes: groups, links and corpus-wide counts of linked ids.

Both tokenizers read space + text: A is a byte-level vocabulary, B a piece model that adds the space
itself. Python only makes ids and the offsets where tokens end, numbered within a segment. From there on
arrays do the work: the ends that both have (array_intersect) cut a text into groups, every end of either
closes exactly one link, and each token's id and number are spread over the ends that it holds (transform,
array_repeat, flatten), so that groups and links find their tokens by place, in time linear in the text.

An id pair's count is a plain grouping of all links. To bring counts back to documents, the most
frequent pairs (as many as KEPT_PAIRS allows) are broadcast and summed up in place; links of the other
pairs are added up by document and pair and joined by shuffle. No link leaves its task by itself.

Long texts go in segments of about SEGMENT_BYTES, cut where both have an end, so a row's arrays are
bounded. Nulls: a null or empty text, and one whose tokens' bytes aren't space + text, has no tokens;
null and repeated doc_ids keep a row each. Empty table: no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_files

#: A segment closes at the first end common to both after so many bytes.
SEGMENT_BYTES = 64 << 10
#: Bytes of text that a task encodes at once; pieces that it remembers of either tokenizer.
BATCH_BYTES, KEPT_PIECES = 512 << 10, 800_000
#: Pairs with their counts that every executor holds, at most.
KEPT_PAIRS = 1 << 19

SIDES = ("a_ids", "a_ends", "a_sizes", "b_ids", "b_ends", "b_sizes")
TOKENS = ", ".join(["row bigint, doc_id bigint, segment int, segments int", *(f"{c} array<int>" for c in SIDES)])


def vocabulary_paths(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.blob[np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class ByteLevel(token_files.Encoder):
    """A: special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.table = token_files.PieceTable(21) if self.by_piece else None
        self.special = []
        byte_of = {chr(letter): b for b, letter in token_files._LETTERS.items()}
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.bytes = _Bytes([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is not None and self.table.count > KEPT_PIECES:
            self.table.clear()
        return super().encode(data, offs)


class Pieces:
    """B: reads space + text, whose first space the model adds itself.

    Where no piece has a space after another character, nothing is merged across the start of a run of spaces, so texts go
    by such pieces, each of which is encoded once; otherwise texts go whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = _Bytes([bytes([int(t[3:5], 16)]) if self.model.is_byte(k) else t.replace("▁", " ").encode() for k, t in enumerate(names)])
        self.by_piece = not any("▁" in t.lstrip("▁") for t in names)
        self.table = token_files.PieceTable(21)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n+1 offsets of each text's ids."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        cut, raw = np.zeros(n + 1, bool), data.tobytes()
        if self.by_piece:
            cut[1:n] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offs] = True
        at = np.flatnonzero(cut)
        h = token_files._hash(data, at[:-1], at[1:])
        place = self.table.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.table.count > KEPT_PIECES:
                self.table.clear()
                new = np.arange(len(h))
            own, first = np.unique(h[new], return_index=True)
            k = new[first]
            found = self._ids([raw[x:y] for x, y in zip(at[k].tolist(), at[k + 1].tolist(), strict=True)])
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.table.add(own, size, np.fromiter((x for e in found for x in e), np.int32, int(size.sum())))
            place[new] = self.table.find(h[new])
        size = self.table.size[place].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.table.ids[np.repeat(self.table.begin[place] - ends[:-1], size) + np.arange(int(ends[-1]))]
        return ids, ends[np.searchsorted(at, offs)].astype(np.int64)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        alone = [self.model.piece_to_id("▁")]  # an empty text wouldn't get the space
        return [ids or alone for ids in self.model.encode([p.decode()[1:] for p in pieces], num_threads=1)]


_made: dict = {}


def _both(paths: tuple[str, str]):
    if paths not in _made:
        _made[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _made[paths]


def _segments(ids: tuple, ends: tuple, segment_bytes: int) -> list[tuple]:
    """ids and ends of A and B cut at common ends; ends count from the segment's start."""
    size = int(ends[0][-1]) if len(ends[0]) else 0
    if size <= segment_bytes:
        return [(ids[0], ends[0], ids[1], ends[1])]
    common_ends = np.intersect1d(*ends, assume_unique=True)
    cuts = np.unique(common_ends[np.searchsorted(common_ends, np.arange(segment_bytes, size, segment_bytes))])
    out, before = [], (0, 0, 0)
    for cut in np.union1d(cuts, [size]).tolist():
        to = (cut, int(np.searchsorted(ends[0], cut, "right")), int(np.searchsorted(ends[1], cut, "right")))
        base, *at = before
        out.append(tuple(x for k in (0, 1) for x in (ids[k][at[k] : to[k + 1]], ends[k][at[k] : to[k + 1]] - base)))
        before = to
    return out


def _numbered(ends: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Each end's number among the ends of both sides, from 1 on; an end of both has one number."""
    there = np.zeros(max((int(e[-1]) for e in ends if len(e)), default=0) + 1, bool)
    for e in ends:
        there[e] = True
    number = np.cumsum(there)
    return tuple(number[e] for e in ends)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def tokenise(spark: SparkSession, docs: DataFrame, paths: tuple[str, str] | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, text to a row per segment: ids, ends and sizes of the tokens of both tokenizers. The files must exist on every executor.

    Ends are told by their numbers among all ends of a segment, and sizes are differences of those: where neither side has an end, nothing is told.
    """
    common.prepare(spark)
    paths = paths or vocabulary_paths()

    def run(batches):
        both, row = _both(paths), itertools.count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            data, offs = common.text_bytes(batch.column(1))
            for i, j, b, o in common.pieces(data, offs, BATCH_BYTES):
                some = np.flatnonzero(np.diff(o))  # space + text, where there is text
                spaced, at = np.insert(b, o[some], 0x20), np.concatenate([[0], np.cumsum(np.diff(o)[some] + 1)])
                found = [t.encode(spaced, at) for t in both]
                spelled = [t.bytes.spell(ids) for t, (ids, _) in zip(both, found, strict=True)]
                place = [np.concatenate([[0], np.cumsum(t.bytes.size[ids])]) for t, (ids, _) in zip(both, found, strict=True)]
                rows, k = [], 0
                for d in range(j - i):
                    own = [()]
                    if o[d] < o[d + 1]:
                        runs = [(int(x[k]), int(x[k + 1])) for _, x in found]
                        whole = spaced[at[k] : at[k + 1]]
                        if all(np.array_equal(s[p[a] : p[z]], whole) for s, p, (a, z) in zip(spelled, place, runs, strict=True)):
                            own = _segments(tuple(x[a:z] for (x, _), (a, z) in zip(found, runs, strict=True)), tuple(p[a + 1 : z + 1] - p[a] for p, (a, z) in zip(place, runs, strict=True)), segment_bytes)
                            own = [(a, x, b, y) for a, p, b, q in own for x, y in [_numbered((p, q))]]
                        k += 1
                    number = next(row)
                    rows += [(number, i + d, s, len(own), x) for s, x in enumerate(own)]
                none = np.zeros(0, np.int32)
                lists = [_lists([x[c] if x else none for *_, x in rows]) for c in range(4)]
                sizes = [_lists([np.diff(x[c], prepend=0) if x else none for *_, x in rows]) for c in (1, 3)]
                lists = [*lists[:2], sizes[0], *lists[2:], sizes[1]]
                ids = batch.column(0).take(pa.array([r[1] for r in rows]))
                common.release()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), *lists], names=["row", "doc_id", "segment", "segments", *SIDES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _owners(sizes: Column) -> Column:
    """For each end the number, from 0 on, of the token that holds the bytes before it."""
    return F.flatten(F.transform(sizes, lambda n, i: F.array_repeat(i, n)))


def _groups(a_names: Column, b_names: Column, of_a: Column, of_b: Column, cuts: Column) -> Column:
    """The text of each group, which ends at a cut. Mostly it is one token of either side: no end lies between two cuts."""

    def side(names: Column, of: Column, low: Column, high: Column) -> Column:
        first = F.get(of, low)
        return F.array_join(F.slice(names, first + 1, F.get(of, high - 1) - first + 1), ",")

    def text(e: Column, k: Column) -> Column:
        low = F.coalesce(F.get(cuts, k - 1), F.lit(0))
        several = F.concat(side(a_names, of_a, low, e), F.lit("|"), side(b_names, of_b, low, e))
        one = F.concat(F.get(a_names, F.get(of_a, low)), F.lit("|"), F.get(b_names, F.get(of_b, low)))
        return F.when(e - low == 1, one).otherwise(several)

    return F.transform(cuts, text)


def align(tokens: DataFrame) -> DataFrame:
    """row, doc_id, segment, segments, n_a, n_b, n_groups, the groups of a segment (text `a1,a2|b1;a3|b2,b3`) and its links.

    There is a link for each end of either side: where a token ends, one link does. Spread over the ends that they
    hold, the ids of A and of B are those of the links, a_links and b_links. Ends of both sides are those of groups.
    """
    names = lambda ids: F.transform(ids, lambda x: x.cast("string"))
    spread = lambda ids, sizes: F.flatten(F.zip_with(ids, sizes, lambda x, n: F.array_repeat(x, n)))

    def joined(of_a: Column, of_b: Column) -> Column:
        cut = lambda x, y: _let(F.transform("cuts", lambda e: e), lambda c: _groups(x, y, of_a, of_b, c))
        return F.array_join(_let(names("a_ids"), lambda x: _let(names("b_ids"), lambda y: cut(x, y))), ";")

    groups = _let(_owners(F.col("a_sizes")), lambda x: _let(_owners(F.col("b_sizes")), lambda y: joined(x, y)))
    tokens = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    n_a, n_b, n_groups = (F.size(c).cast("long") for c in ("a_ends", "b_ends", "cuts"))
    return tokens.select(
        "row", "doc_id", "segment", "segments", n_a.alias("n_a"), n_b.alias("n_b"), n_groups.alias("n_groups"), F.when(F.size("cuts") > 0, groups).otherwise("").alias("groups"),
        spread("a_ids", "a_sizes").alias("a_links"), spread("b_ids", "b_sizes").alias("b_links"),
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), top (no pair with its B id has more), from a column of them."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    best = counts.groupBy("b").agg(F.max("n").alias("best"))  # as many rows as B's vocabulary at most
    return counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))


def _least_kept(counts: DataFrame, kept: int) -> int:
    """The smallest power of two such that at most `kept` pairs have that count or more."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()}
    power = total = 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > kept:
            return 1 << (power + 1)
    return 1


def report(spark: SparkSession, docs: DataFrame, paths: tuple[str, str] | None = None, kept_pairs: int = KEPT_PAIRS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per document: numbers of tokens, groups and links, the sum of its links' counts, links with their B id's highest count, and a digest of its groups."""
    many = F.col("segments") > 1
    digest = F.when(~many & (F.col("n_a") > 0), F.sha2("groups", 256))
    rows = common.materialize(spark, align(tokenise(spark, docs, paths, segment_bytes)).withColumn("digest", digest).withColumn("groups", F.when(many, F.col("groups"))), "aligned")
    pair = F.shiftleft(F.col("a").cast("long"), 32) + F.get("b_links", F.col("at"))
    pairs = rows.select("row", "b_links", F.posexplode("a_links").alias("at", "a")).select("row", pair.alias("pair"))
    counts = common.materialize(spark, pair_counts(pairs.select("pair")), "pair-counts")
    least = _least_kept(counts, kept_pairs)
    met = pairs.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    rest = F.when(F.col("n").isNull(), F.col("pair")).alias("rest")
    summed = common.materialize(spark, met.groupBy("row", rest).agg(F.count("*").alias("m"), F.sum("n").alias("count_sum"), F.count_if("top").alias("n_best")), "link-sums")
    others = counts.where(F.col("n") < least).withColumnRenamed("pair", "rest")
    late = summed.where("rest is not null").select("row", "rest", "m").join(others, "rest").select("row", (F.col("m") * F.col("n")).alias("count_sum"), F.when(F.col("top"), F.col("m")).otherwise(0).alias("n_best"))
    sums = summed.where("rest is null").select("row", "count_sum", "n_best").unionByName(late).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    parts = F.array_sort(F.collect_list(F.when(many, F.struct("segment", "groups"))))
    whole = F.sha2(F.array_join(F.transform("parts", lambda p: p["groups"]), ";"), 256)
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    docs = rows.withColumn("n_links", F.size("a_links").cast("long")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in numbers), F.max("digest").alias("digest"), parts.alias("parts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.join(sums, "row", "left").select("doc_id", *numbers, zero("n_best"), zero("count_sum"), F.coalesce("digest", F.when(F.size("parts") > 0, whole), F.lit("")).alias("groups_sha256"))
