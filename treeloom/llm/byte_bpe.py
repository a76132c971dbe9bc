"""Byte-level BPE with a vocabulary of ranks: encoding in linear time, and decoding.

A text is split by the vocabulary's pattern. Of a piece's bytes, read as Latin-1, an Aho-Corasick
automaton finds the longest token from each place. Tokens are then laid from left to right: the
longest one first, a shorter prefix where it doesn't fit its left neighbour, and one step back where
no prefix does. Two tokens fit if the merges, undone from the last one on, never join bytes across
their border; a sequence whose neighbours all fit is the one that merging by rank gives. Answers for
pairs are kept, a place that turned out to be no border is never tried again, so the work is linear
in the piece. A token that its own bytes don't merge to is only ever a whole piece.

Nulls: a null text is empty and has no ids; a null doc_id stays. Repeated ids and texts keep a row
each. Texts of any length are encoded whole. Empty table: no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_files

#: Pairs of tokens that a worker remembers; beyond that it starts anew.
KEPT_PAIRS = 1_000_000
#: Ids that are decoded at once.
RUN = 1 << 18


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be the numbers from 0 on")
    return [ranks[k] for k in range(len(ranks))]


class Merges:
    """What the ranks say of tokens: the two parts that each is merged from, and whether two tokens can stand side by side."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.id_of = {t: k for k, t in enumerate(tokens)}
        n = self.n = len(tokens)
        #: Parts of a token, -1 for none; the longest token that is a proper prefix; whether merging its bytes gives the token.
        self.left, self.right = [-1] * n, [-1] * n
        self.made = [len(t) == 1 for t in tokens]
        self._joined: dict[int, int] = {}
        prefixes = [[p for end in range(len(t) - 1, 0, -1) if (p := self.id_of.get(t[:end])) is not None] for t in tokens]
        for k, token in enumerate(tokens):
            for p in prefixes[k]:
                rest = self.id_of.get(token[len(tokens[p]) :])
                if rest is not None and p < k and rest < k and self.made[p] and self.made[rest] and self.fit(p, rest):
                    self.left[k], self.right[k], self.made[k] = p, rest, True
                    self._joined[p * n + rest] = k
                    break
        self.shorter = [next((p for p in own if self.made[p]), -1) for own in prefixes]
        if missing := 256 - sum(len(t) == 1 for t in tokens):
            raise ValueError(f"{missing} bytes have no token")

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge joins the two: their own merges are undone, the latest first, down to bytes at the border."""
        before = self.n
        while True:
            joined = self._joined.get(left * self.n + right)
            if joined is not None and joined < before:
                return False
            if self.right[left] >= 0 and (left > right or self.left[right] < 0):
                before, left = left, self.right[left]
            elif self.left[right] >= 0:  # at equal rank the merge further left comes first
                before, right = right + 1, self.left[right]
            else:
                return True


class Codec(token_files.Encoder):
    """Encodes and decodes with one vocabulary and pattern.

    Many texts go at once: they are cut where the pattern always does, and what lies between two cuts is
    split and merged once and then found by its hash.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.merges = Merges(read_ranks(path))
        self.matches = ahocorasick.Automaton()
        for k, token in enumerate(self.merges.tokens):
            if self.merges.made[k]:
                self.matches.add_word(token.decode("latin-1"), k)
        self.matches.make_automaton()
        self.size = [len(t) for t in self.merges.tokens]
        self.split = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.by_piece, self.special, self.table = True, [], token_files.PieceTable()

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left * self.merges.n + right] = self.merges.fit(left, right)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.merges.id_of.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, known, end, text = self.merges.n, self.size, self.merges.shorter, self.pairs.get, len(data), data.decode("latin-1")
        # Often the longest tokens, one after the other, fit. What does up to the first misfit is kept.
        out, at = [], 0
        for last, token in self.matches.iter_long(text):
            fits = not out or known(out[-1] * n + token)
            if at + size[token] != last + 1 or not fits and (fits is not None or not self.fits(out[-1], token)):
                break
            out.append(token)
            at = last + 1
        if at == end:
            return out
        longest = [-1] * end
        for last, token in self.matches.iter(text):
            longest[last + 1 - size[token]] = token  # of those from one place the longest ends last
        closed, token = set(), longest[at]
        while at < end:
            while token >= 0:
                if not closed or at + size[token] not in closed:
                    if not out:
                        break
                    fits = known(out[-1] * n + token)
                    if fits or fits is None and self.fits(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < end else -1
            else:  # no token goes on from here, so no token ends here
                closed.add(at)
                token = out.pop()
                at -= size[token]
        return out

    def _ids(self, piece: bytes) -> list[int]:
        found = [self.piece(p.encode()) for p in self.split(piece.decode())]
        return found[0] if len(found) == 1 else [x for ids in found for x in ids]

    def decode(self, ids: np.ndarray):
        """The bytes of ids, in runs."""
        token = self.merges.tokens.__getitem__
        for k in range(0, len(ids), RUN):
            yield b"".join(map(token, ids[k : k + RUN].tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A worker's codec, made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text to doc_id, n_tokens, ids. The file of ranks must exist on every executor."""
    common.prepare(spark)
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            data, offs = common.text_bytes(batch.column(1))
            for i, j, b, o in common.pieces(data, offs, token_files.PIECE_BYTES):
                ids, ends = own.encode(b, o)
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                common.release()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), column], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def _each(batches):
    """Rows of encoded batches: the batch, and its documents' ids as arrays."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("ids"))
        offs, flat = column.offsets.to_numpy(), column.values.to_numpy()
        yield batch, [flat[a:z] for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        common.release()


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids to doc_id, data: the bytes that the ids stand for. An id outside the vocabulary is an error."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        own = codec(path, pattern)
        for batch, docs in _each(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(own.decode(ids)) for ids in docs], pa.binary())], names=["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def _sha256(parts) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def report(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (little-endian, 32 bits each) and of the bytes that they decode to."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        own = codec(path, pattern)
        for batch, docs in _each(batches):
            ids = pa.array([_sha256([x.astype("<u4").tobytes()]) for x in docs], pa.string())
            decoded = pa.array([_sha256(own.decode(x)) for x in docs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, decoded], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(spark, docs, path, pattern).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
