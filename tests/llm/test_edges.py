"""Nulls, repeated rows, ties, clashing names and very long texts; and what the learned operators decide, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import chat, common, jaccard, langid, lm, mixing, positional, quality, queries, substrings, token_files

from .test_operators import multiset, shingles, split, substring_truth, tokenizer


# language -------------------------------------------------------------------------------------


def test_letters_are_letters(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat", "en"), ("le chat noir", "fr")] * 30)]
    odd = [(None, "½ 12 ② Ⅷ ²", "en"), (100, "½ 12", None), (100, "é", None), (None, "the cat", None), (100, "é", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    got = langid.identify(spark, docs).collect()
    assert len(got) == len(rows) + len(odd)
    assert sorted(r.lang_pred == "und" for r in got if r.doc_id == 100) == [False, False, True]
    assert sorted(r.lang_pred == "und" for r in got if r.doc_id is None) == [False, True] and not any(r.held_out for r in got if r.doc_id is None)


def test_predictions_keep_clashing_columns(spark):
    model = langid.Model(["aa"], np.zeros((langid.BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    docs = spark.createDataFrame([("word", "mine", 3)], "text string, lang string, score int")
    row = langid.predict(spark, docs, model, ("p", "q", "r")).first()
    assert (row.lang, row.score, row.p, row.q) == ("mine", 3, "aa", 1.0)


def test_many_languages_take_embeddings():
    """With more languages than dimensions the model keeps embeddings; both forms score alike."""
    rng = np.random.default_rng(1)
    e, w, b = rng.random((50, 4)).astype(np.float32), rng.random((4, 4)).astype(np.float32), rng.random(4).astype(np.float32)
    small = langid.Model.of(list("abcd"), e, w, b)
    large = langid.Model(list("abcd"), e, b, w)
    bucket, offs = rng.integers(0, 50, 30).astype(np.int32), np.array([0, 10, 10, 30])
    assert small.layer is None and np.allclose(small.logits(bucket, offs), large.logits(bucket, offs), atol=1e-5)
    assert langid.Model.of([str(k) for k in range(9)], e, rng.random((4, 9)).astype(np.float32), np.zeros(9, np.float32)).layer is not None


def test_scores_follow_the_model():
    """Averages, layer, temperature and softmax, by hand."""
    table = np.log(np.arange(1, 7, dtype=np.float32)).reshape(3, 2)
    model = langid.Model(["a", "b"], table, np.array([0.5, 0.0], np.float32), temperature=2.0)
    p = model.probabilities(np.array([0, 2, 2], np.int32), np.array([0, 3, 3]))
    logits = [0.5 + (math.log(1) + 2 * math.log(5)) / 3, (math.log(2) + 2 * math.log(6)) / 3]
    e = [math.exp(x / 2) for x in logits]
    assert p[0] == pytest.approx([x / sum(e) for x in e], rel=1e-5) and p[1] == pytest.approx([math.exp(0.25) / (math.exp(0.25) + 1), 1 / (math.exp(0.25) + 1)], rel=1e-5)


# repeated ids and nulls -----------------------------------------------------------------------


def test_repeats_are_removed_in_order_of_id_and_place(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b = prose(50), prose(45)
    rows = [(None, a), (7, b), (3, a), (3, f"{a} {b}"), (None, f"x {b}"), (9, None), (1, "few words"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = substring_truth(rows)  # a null id counts as larger than any; equal ids go by place
    got = substrings.deduplicate(spark, docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == collections.Counter((rows[k][0], *v) for k, v in want.items())
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    whole = next(r for r in got if r.n_words == 95)
    assert whole.doc_id == 3 and [(s.start, s.stop) for s in whole.spans] == [(0, 50)]


def test_helper_columns_take_free_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", "x", 1, 2, 3), (1, "e f", None, "y", 1, 2, 3), (None, "g", "t", "z", 1, 2, 3)], "doc_id bigint, text string, source string, _mix_row string, _size int, _mix_size int, _MIX_TAKEN int")
    mixed = mixing.apply_mix(spark, docs)
    assert mixed.columns == docs.columns
    assert {(r._mix_row, r._size, r._mix_size, r._MIX_TAKEN) for r in mixed.collect()} <= {("x", 1, 2, 3), ("y", 1, 2, 3), ("z", 1, 2, 3)}
    assert mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == mixing.mix(spark, docs).agg(F.sum("taken")).first()[0]
    extra = docs.selectExpr("*", "1 AS words", "2 AS h8", "3 AS lines", "4 AS n", "5 AS chunk", "6 AS rid", "7 AS row")
    assert quality.judge(spark, extra, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 3
    assert jaccard.join(spark, extra).count() == positional.decontaminate(spark, extra, spark.createDataFrame([], "item_id bigint, text string")).count() == substrings.report(spark, extra).count() == lm.score(spark, extra).count() == 3


def test_preferences_of_odd_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, pair_id string, chosen string"
    rows = [(0, 1, "assistant", "b", "x", "x"), (0, None, "user", "a", "x", "x"), (0, 1, "assistant", "b", "x", "x"), (1, 0, "user", "a", "x", "x"), (1, 1, "user", "z", "x", "x"), (1, 1, "assistant", "b", "x", "x"), (None, 0, "user", "lost", "x", "x"), (4, 0, "user", "<|end|>" + "long " * 20000, "x", "x")]
    got = {r.pair_id: r for r in chat.format_preferences(chat.pair_neighbours(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {0, 2}
    # A null turn comes first; equal turns go by role and text; a repeated row is a repeated turn.
    assert got[0].n_prompt_turns == 2 and got[0].chosen == "<|turn|>assistant\nb<|end|>\n" and got[0].rejected == "<|turn|>user\nz<|end|>\n" and got[0].rejected_mask == ""
    assert got[0].chosen_mask == f"{len('<|turn|>assistant' + chr(10))}-{len('<|turn|>assistant' + chr(10) + 'b<|end|>')}"
    assert got[2].rejected == "" and got[2].chosen.count("long ") == 20000 and "< |end|>" in got[2].chosen
    assert chat.format_preferences(chat.pair_neighbours(spark.createDataFrame([], schema))).count() == 0
    sides = spark.createDataFrame([(None, True, 0, "user", "a"), (None, False, 0, "user", "b"), (1, None, 0, "user", "c")], "pair_id bigint, chosen boolean, turn bigint, role string, text string")
    got = {r.pair_id: (r.chosen, r.rejected) for r in chat.format_preferences(sides).collect()}
    assert got == {None: ("<|turn|>user\na<|end|>\n", "<|turn|>user\nb<|end|>\n"), 1: ("", "")}


# verdicts -------------------------------------------------------------------------------------


def test_learned_verdicts_apply_the_list(spark, monkeypatch):
    rng = random.Random(6)
    low = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(40))
    rows = [(k, low() if k % 3 else " ".join(f"w{rng.randint(0, 999)}#$" for _ in range(40))) for k in range(300)] + [(5, low()), (None, low()), (1000, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(2, None), (None, 0), (4, 1), (9, 1)], "doc_id bigint, quality int")
    learned = []
    keep = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: learned.append(keep(*a)) or learned[-1])
    got = quality.judge(spark, docs, labels).collect()
    assert len(learned[0]) >= 1 and len(got) == len(rows)
    symbols = lambda t: sum(c in quality.SYMBOLS for c in t)
    for r in got:
        values = {"n_words": r.n_words, "symbols_per_word": r.n_symbols / max(1, r.n_words), "chars_per_word": r.word_chars / max(1, r.n_words)}
        tested = [c for rule in learned[0] for c in rule]
        if all(c.name in values for c in tested):
            hit = any(all(values[c.name] > c.value if c.above else values[c.name] <= c.value for c in rule) for rule in learned[0])
            assert r.kept == (not r.base_failed and not hit)
    bad = {r.doc_id for r in got if not r.kept}
    assert bad >= {k for k, t in rows if symbols(t) and k is not None} and {r.kept for r in got if r.doc_id is not None and 200 <= r.doc_id < 300 and r.doc_id % 3} == {True}
    # Reruns and other partitions learn the same list.
    quality.judge(spark, docs.repartition(2), labels).count()
    assert [list(map(str, x)) for x in learned[1]] == [list(map(str, x)) for x in learned[0]]
    monkeypatch.setattr(quality, "MAX_LABELLED", 50)
    stats = quality.statistics(docs)
    assert keep(spark, stats, labels) == keep(spark, stats.repartition(3), labels)


def interpolated(texts, learn, steps=lm.EM_STEPS):
    """Scores by the same model with exact estimates: weights by context bucket from EM over every training token, without itself."""
    tokens = [[*split(t, lower=True), None] for t in texts]
    one = collections.Counter(t for x, y in zip(tokens, learn) if y for t in x)
    two = collections.Counter(p for x, y in zip(tokens, learn) if y for p in zip([None, *x[:-1]], x))
    n, v = sum(one.values()), len(one)
    base = lambda c, less: (c + 0.5 - less) / (n - less + 0.5 * (v + 1))
    bucket = lambda c: min(int(math.log2(c)) + 1, lm.CONTEXTS - 1) if c > 0 else 0
    # Contexts count as tokens do: the end mark as often as texts end.
    seen = [(bucket(one[a] - 1), (two[a, b] - 1) / (one[a] - 1) if one[a] > 1 else 0.0, base(one[b], 1)) for x, y in zip(tokens, learn) if y for a, b in zip([None, *x[:-1]], x)]
    groups = collections.defaultdict(list)
    for k, p, q in seen:
        groups[k].append((p, q))
    weight = [0.0] * lm.CONTEXTS
    for k in range(1, lm.CONTEXTS):
        if groups[k]:
            w = 0.5
            for _ in range(steps):
                w = sum(w * p / (w * p + (1 - w) * q) if p else 0.0 for p, q in groups[k]) / len(groups[k])
            weight[k] = min(w, 0.999999)
        elif k > 1:
            weight[k] = weight[k - 1]
    out = []
    for x in tokens:
        total = 0.0
        for a, b in zip([None, *x[:-1]], x):
            w = weight[bucket(one[a])]
            total += math.log10(w * (two[a, b] / one[a] if one[a] else 0.0) + (1 - w) * base(one[b], 0))
        out.append(total)
    return out


def test_scores_agree_with_exact_interpolation(spark):
    rng = random.Random(9)
    chain = {k: [rng.randint(0, 40) for _ in range(3)] for k in range(41)}

    def text(n):
        at, out = rng.randint(0, 40), []
        for _ in range(n):
            out.append(f"w{at}")
            at = rng.choice(chain[at]) if rng.random() < 0.8 else rng.randint(0, 40)
        return " ".join(out)

    rows = [(k, text(rng.randint(1, 60))) for k in range(200)] + [(None, text(20)), (7, "unseen words only"), (11, None)]
    learn = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    want = interpolated([t for _, t in rows], learn)
    got = lm.score(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    a = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    b = sorted((str(i), len(split(t)) + 1, s) for (i, t), s in zip(rows, want))
    assert len(a) == len(b)
    # The histogram averages estimates inside a cell, which moves a weight by far less than a hundredth of a text's score.
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=0.01)


# one very long text ---------------------------------------------------------------------------


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(1_100_000))
    assert len(long) > 9 << 20
    copy = " ".join(long.split(" ")[:-30])
    rows = [(1, long, "en"), (2, copy, "en"), (3, "The few words here " * 3, "en"), (4, "les mots ici", "fr")] + [(10 + k, t, lang) for k in range(12) for t, lang in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    n = 1_100_000
    got = {r.doc_id: r for r in jaccard.join(spark, docs.where("doc_id < 5")).collect()}
    assert got[1].n_shingles == len(shingles(long)) and got[2].component_id == 1 and got[3].component_id == 3
    got = {r.doc_id: r for r in substrings.report(spark, docs.where("doc_id < 5")).collect()}
    assert (got[1].n_words, got[1].n_removed) == (n, 0) and (got[2].n_words, got[2].n_removed) == (n - 30, n - 30)
    bench = spark.createDataFrame([(1, " ".join(long.split(" ")[-20:]))], "item_id bigint, text string")
    got = {r.doc_id: r for r in positional.report(spark, docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[2].n_hit) == (n, 20, 0)
    got = {r.doc_id: r for r in lm.score(spark, docs.where("doc_id < 5")).collect()}
    assert got[1].n_tokens == n + 1 and got[1].n_known >= n - 30
    got = {r.doc_id: r for r in quality.statistics(docs.where("doc_id = 1")).collect()}
    assert got[1].n_words == n and got[1].word_chars == len(long) - n + 1
    assert {r.doc_id: r.taken for r in mixing.mix(spark, docs.withColumn("source", F.lit("s"))).collect()}[1] >= n
    assert {r.doc_id: r.lang_pred for r in langid.identify(spark, docs).collect()}[1] in ("en", "fr")
    ids = tokenizer().encode(long, add_special_tokens=False).ids
    got = {r.doc_id: r for r in token_files.round_trip(spark, docs.where("doc_id < 5")).collect()}
    assert got[1].n_tokens == len(ids) + 1 and got[1].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())


# files ----------------------------------------------------------------------------------------


def test_token_files_have_indexes_and_bloom_filters(spark):
    folder = common.work_path(spark, "orc-test")
    docs = spark.range(0, 6000, 2).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text").repartition(3)
    token_files.write_orc(spark, docs, folder)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    parts = [s.getPath() for s in path.getFileSystem(conf).listStatus(path) if s.getPath().getName().endswith(".orc")]
    assert parts
    kinds, rows = set(), 0
    for part in parts:
        reader = jvm.org.apache.orc.OrcFile.createReader(part, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.ROW_STRIDE
        rows += reader.getNumberOfRows()
        raw = bytes(spark.read.format("binaryFile").load(part.toString()).first().content)
        assert raw[:3] == b"ORC"
        stats = reader.getStatistics()[1]
        assert stats.getMinimum() <= stats.getMaximum()
        inner = reader.rows()
        footer = inner.readStripeFooter(reader.getStripes()[0])
        kinds |= {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
        encodings = [footer.getColumns(k).getKind().toString() for k in range(footer.getColumnsCount())]
        assert set(encodings[1:3]) == {"DIRECT_V2"}  # run-length encoding of integers, second version
        inner.close()
    assert rows == 3000 and ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
    assert [r.doc_id for r in token_files.find(spark, folder, [4, 5, 5998]).orderBy("doc_id").collect()] == [4, 5998]


def test_every_operator_has_its_query():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 11))
