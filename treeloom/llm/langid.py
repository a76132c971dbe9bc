"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords, the byte n-grams of lower-cased words with
a border mark; a softmax over a linear layer gives languages' probabilities. Training is stochastic
gradient descent in numpy on a bounded sample of labelled texts, drawn by a hash of id and text within
each language; part of the sample is kept aside to fit a temperature (calibration) and the score
under which a prediction is rejected.

At most SAMPLE_TEXTS texts of a language are learned from, of all languages together at most ALL_TEXTS texts and SAMPLE_BYTES
bytes, which they share evenly, but LEAST_TEXTS of each as far as they exist and fit in; a longer text is learned from by a random
TRAIN_GRAMS of its subwords. Predictions read whole texts.

Nulls and odd rows: a null text or one without a letter (Unicode category L) is `und` with score 0 and
rejected; rows with a null label are never learned from; a null doc_id counts as not held out. Ties between
languages go to the first by name. Repeated rows each get their prediction, equal rows are learned from once.
Without any labelled row everything is `und`. Empty table: no rows. Extra columns are ignored; predict()
keeps them and writes to the names it is given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

UNKNOWN = "und"
#: Bounds of the training sample: texts per language, and bytes and texts of all languages.
SAMPLE_TEXTS, SAMPLE_BYTES, ALL_TEXTS = 1500, 6_000_000, 12_000
#: Texts per language at least, as far as they exist and fit into its share of bytes; one in any case.
LEAST_TEXTS = 8
#: Subwords of a text that are learned from, at most.
TRAIN_GRAMS = 4096
#: Languages learned at most; above the number of all codes of ISO 639, so that only labels which name no language can go beyond it.
MAX_LANGUAGES = 8192
BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 16, (2, 3, 4)
EPOCHS, RATE, BATCH = 6, 4.0, 32
#: Share of right, calibrated predictions that may fall under the rejecting score, and that score's bound.
REJECT_SHARE, REJECT_MOST = 0.002, 0.5
PIECE_BYTES = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_HIDE = np.arange(256, dtype=np.uint8)
_HIDE[:0x80] = 0x20  # all ASCII but letters is a border
_HIDE[0x41:0x5B] = np.arange(0x61, 0x7B)
_HIDE[0x61:0x7B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts as bytes, and n+1 offsets; a gram is inside one word and its two borders."""
    n = len(offs) - 1
    lengths = np.diff(offs)
    padded = np.full(len(data) + n + 1, 0x20, np.uint8)  # a border before each text
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)
    padded[at] = _HIDE[data]
    begin = offs[:-1] + np.arange(n)  # the border before each text
    letter = padded != 0x20
    keep, found = [], []
    code = padded.astype(np.uint32)
    h = code.copy()
    for k in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ code[k - 1 :]
        if k in GRAMS:
            inner = np.ones(len(h), bool)
            for j in range(1, k - 1):
                inner &= letter[j : j + len(h)]
            if k == 2:
                inner = letter[:-1] | letter[1:]
            place = np.flatnonzero(inner)
            x = h[place]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D) + np.uint32(2 * k)
            x ^= x >> np.uint32(13)
            keep.append(place)
            found.append((x % np.uint32(buckets)).astype(np.int32))
    place, bucket = np.concatenate(keep), np.concatenate(found)
    order = np.argsort(place, kind="stable")
    return bucket[order], np.searchsorted(place[order], np.concatenate([begin, [len(padded)]]))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row per bucket: its embedding, or with few languages the linear layer applied to it
    bias: np.ndarray
    layer: np.ndarray | None = None  # the linear layer, where the table has embeddings
    temperature: float = 1.0
    reject_under: float = 0.0

    @classmethod
    def of(cls, languages: list[str], embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> Model:
        """The smaller of two equal forms: a row never has more than DIMENSIONS numbers, however many languages there are."""
        if len(languages) <= embedding.shape[1]:
            return cls(languages, (embedding @ layer).astype(np.float32), bias)
        return cls(languages, embedding, bias, layer)

    def logits(self, bucket: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(offs) - 1, 1))
        size = np.diff(offs)
        full = np.flatnonzero(size)
        if len(full):
            mean = np.add.reduceat(self.table[bucket], offs[full], axis=0) / size[full, None]
            out[full] += mean if self.layer is None else mean @ self.layer
        return out

    def probabilities(self, bucket, offs) -> np.ndarray:
        return softmax(self.logits(bucket, offs) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bucket: np.ndarray, offs: np.ndarray, label: np.ndarray, languages: list[str], buckets: int = BUCKETS) -> Model:
    """Gradient descent over minibatches; each tenth text is kept for calibration."""
    n, k = len(offs) - 1, len(languages)
    rng = np.random.default_rng(7)
    aside = np.zeros(n, bool)
    aside[rng.permutation(n)[: n // 10]] = True
    learn = np.flatnonzero(~aside)
    e = ((rng.random((buckets, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    w = np.zeros((DIMENSIONS, k), np.float32)
    b = np.zeros(k, np.float32)
    seen = np.bincount(label[learn], minlength=k)
    weight = np.where(seen > 0, len(learn) / np.maximum(seen, 1) / max(k, 1), 0).astype(np.float32)
    size = np.maximum(np.diff(offs), 1)
    steps, done = EPOCHS * -(-max(len(learn), 1) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for s in range(0, len(learn), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            rows = learn[s : s + BATCH]
            # Long texts stand by a random half thousand of their subwords in a step.
            parts = [bucket[offs[r] : offs[r + 1]] for r in rows]
            parts = [p if len(p) <= 512 else p[rng.integers(0, len(p), 512)] for p in parts]
            # Some steps see a few words only, so that short texts are learned as well.
            parts = [p if len(p) < 64 or rng.random() > 0.3 else p[(q := int(rng.integers(0, len(p) - 40))) : q + 40] for p in parts]
            parts = [p if len(p) else np.zeros(1, np.int32) for p in parts]
            length = np.array([len(p) for p in parts])
            flat, at = np.concatenate(parts), np.cumsum(length) - length
            mean = np.add.reduceat(e[flat], at, axis=0) / length[:, None].astype(np.float32)
            p = softmax(mean @ w + b)
            p[np.arange(len(rows)), label[rows]] -= 1
            p *= weight[label[rows]][:, None] / len(rows)
            back = (p @ w.T) / length[:, None].astype(np.float32)
            w -= np.float32(rate) * (mean.T @ p)
            b -= np.float32(rate * 0.1) * p.sum(axis=0)
            np.subtract.at(e, flat, np.float32(rate * len(rows)) * np.repeat(back, length, axis=0))
    model = Model.of(languages, e, w, b)
    held = np.flatnonzero(aside) if aside.sum() >= 20 else np.arange(n)
    if n:
        _calibrate(model, bucket, offs, label, held, size)
    return model


def _calibrate(model: Model, bucket, offs, label, held, size) -> None:
    logits = np.concatenate([model.logits(bucket[offs[r] : offs[r + 1]], np.array([0, offs[r + 1] - offs[r]])) for r in held])
    grid = np.geomspace(0.3, 10, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), label[held]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == label[held]
    scores = p.max(axis=1)[right]
    if len(scores):
        model.reject_under = float(min(REJECT_MOST, np.quantile(scores, REJECT_SHARE)))


def _chosen(candidates: list, share: float, texts: int) -> list:
    """Of one language's candidates (draw, bytes): whole texts in order of draw as they fit into its share of bytes and texts."""
    taken, size = [], 0
    for draw, n in candidates:
        if len(taken) < texts and size + n <= share:
            taken.append(draw)
            size += n
    if len(taken) < LEAST_TEXTS:  # the shortest ones, so that as many as possible fit
        taken, size = [], 0
        for n, draw in sorted((n, draw) for draw, n in candidates):
            if not taken or len(taken) < LEAST_TEXTS and size + n <= share:
                taken.append(draw)
                size += n
    return taken


def draw_sample(spark: SparkSession, rows: DataFrame) -> tuple[list[str], DataFrame | None]:
    """rows: lang, text, draw (64 bits). The languages, and the sample of each: equal rows once, texts whole.

    Draws under a limit are candidates, about twice as many as needed, and always the least draw of a
    language. Only their draws and sizes reach the driver, which takes them in order of draw.
    """
    have = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("draw").alias("least")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not have:
        return [], None
    share, texts = SAMPLE_BYTES / len(have), min(SAMPLE_TEXTS, max(LEAST_TEXTS, ALL_TEXTS // len(have)))
    limits = []
    for r in have:
        part = min(1.0, max(2 * min(texts / r.n, share / max(1, r.bytes)), 8 * LEAST_TEXTS / r.n))
        limits.append((r.lang, max(r.least, min((1 << 63) - 1, int(part * 2.0**64) - (1 << 63)))))
    limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    near = rows.where(F.col("draw") <= limit[F.col("lang")])
    candidates: dict[str, list] = {r.lang: [] for r in have}
    for r in near.groupBy("lang", "draw").agg(F.min(F.octet_length("text")).alias("bytes")).toLocalIterator():
        candidates[r.lang].append((r.draw, r.bytes))
    chosen = [(k, draw) for k, v in candidates.items() for draw in _chosen(sorted(v), share, texts)]
    chosen = F.broadcast(spark.createDataFrame(chosen, "lang string, draw bigint"))
    return sorted(candidates), near.join(chosen, ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"]).select("lang", "text", "draw")


def fit(spark: SparkSession, docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from rows where `usable` holds; only text and label of a bounded, hash-drawn sample reach the driver, as n-grams."""
    common.prepare(spark)
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), F.col(text).cast("string"), F.lit(17)).alias("draw")
    )
    languages, sample = draw_sample(spark, rows)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))

    def shred(batches):
        for batch in batches:
            data, offs = common.text_bytes(batch.column(1))
            for i, j, d, o in common.pieces(data, offs, PIECE_BYTES):
                g, at = grams(d, o)
                draws = batch.column(2).slice(i, j - i)
                found = [common.blob(_some(g[a:b], draw)) for a, b, draw in zip(at[:-1], at[1:], draws.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), draws, pa.array(found, pa.binary())], names=["lang", "draw", "grams"])

    number = {k: i for i, k in enumerate(languages)}
    found = [(number[r.lang], r.draw, np.frombuffer(bytes(r.grams), np.int32)) for r in sample.mapInArrow(shred, "lang string, draw bigint, grams binary").toLocalIterator()]
    found = sorted((r for r in found if len(r[2])), key=lambda r: r[:2])
    label = np.array([r[0] for r in found], np.int64)
    offs = np.concatenate([[0], np.cumsum([len(r[2]) for r in found], dtype=np.int64)]).astype(np.int64)
    bucket = np.concatenate([np.zeros(0, np.int32), *[r[2] for r in found]])
    del found
    return train(bucket, offs, label, languages)


def _some(g: np.ndarray, draw: int) -> np.ndarray:
    """At most TRAIN_GRAMS of a text's subwords in their order; which ones follows from the text's draw."""
    if len(g) <= TRAIN_GRAMS:
        return g
    return g[np.sort(np.random.default_rng(draw & 0xFFFFFFFF).choice(len(g), TRAIN_GRAMS, replace=False))]


def predict(spark: SparkSession, docs: DataFrame, model: Model, added: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add prediction, score and rejection to every row under the names given; needs the column text, keeps all other columns."""
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in fields]
    docs = docs.select(*names)
    at = names.index("text")
    schema = docs.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(False).alias(added[2])).schema

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            data, offs = common.text_bytes(column)
            lang, score = [], []
            for i, j, d, o in common.pieces(data, offs, PIECE_BYTES):
                letters = [_LETTER.search(d[a:b].tobytes().decode()) is not None for a, b in zip(o[:-1], o[1:], strict=True)]
                if m.languages:
                    g, to = grams(d, o)
                    p = m.probabilities(g, to)
                    best = p.argmax(axis=1)
                    top = p.max(axis=1)
                for k, ok in enumerate(letters):
                    known = ok and bool(m.languages)
                    lang.append(m.languages[best[k]] if known else UNKNOWN)
                    score.append(float(min(1.0, top[k])) if known else 0.0)
            common.release()
            no = [x == UNKNOWN or s < m.reject_under for x, s in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], names=[*names, *added])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, predict all documents."""
    model = fit(spark, docs, ~held_out())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return predict(spark, rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
