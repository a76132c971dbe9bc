"""The ten operators against brute force, exact round trips or held-out accuracy."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import chat, chunks, common, jaccard, langid, lm, mixing, positional, quality, substrings, token_files, warc, words
from treeloom.llm.fm_index import FMIndex

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"


def split(text, pattern=SPACED, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOW) if lower else text)


def multiset(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# words and index ------------------------------------------------------------------------------


def test_word_kernel_follows_the_pattern():
    texts = ["a bb  ccc", "", "x y", " \n", "Äé foo\tBar", "tail"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = words.split(data, offs)
    assert [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == [x for t in texts for x in split(t)]
    assert list(w.counts) == [len(split(t)) for t in texts]
    for k in (1, 3, 5, 8, 20):
        seq = np.array([1, 2, 1, 2, 1, 3] * 8, np.uint64)
        h = words.windows(seq, k)
        same = {tuple(seq[i : i + k]): h[i] for i in range(len(h))}
        assert len(h) == 49 - k and len(set(same.values())) == len(same) and all(same[tuple(seq[i : i + k])] == h[i] for i in range(len(h)))


def test_fm_index_counts_and_matching_statistics():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 160)
    text[[50, 101, 159]] = 0
    index = FMIndex(text, 5, 8)
    naive = lambda p: [i for i in range(len(text) - len(p) + 1) if list(text[i : i + len(p)]) == list(p)]
    ends = np.array([e for e in range(8, 160) if 0 not in text[e - 8 : e]])
    length, low, high = index.matching_statistics(text, ends, 8)
    assert (length == 8).all() and all(z - a == len(naive(text[e - 8 : e])) for e, a, z in zip(ends, low, high))
    for least, built in ((1, 1), (2, 1), (2, 2), (3, 2)):
        index = FMIndex(text, 5, 8, built)
        every = np.arange(1, 161)
        length, low, high = index.matching_statistics(text, every, 8, least)
        for e, n, a, z in zip(every, length, low, high):
            longest = max((k for k in range(1, min(8, e) + 1) if 0 not in text[e - k : e] and len(naive(text[e - k : e])) >= least), default=0)
            assert n == longest and (n == 0 or z - a == len(naive(text[e - n : e])))
    assert not index.matching_statistics(np.array([7, 9, 7]), np.array([1, 2, 3]), 8)[0].any()


# 1 WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long, odd = "<p>" + "x" * 200 + "</p>", "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "u1", long, 0), (2, "u2", long, 0), (3, None, None, 0), (4, "u4", "short", 0), (5, "u5", "short", 0), (6, "u6", odd, 0), (0, "u0", odd, 0), (7, "a b\nc", "", 0), (None, "n", long, 0), (6, "u6", odd, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key int")
    got = multiset(warc.round_trip(spark, pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    first = {long: 1, odd: 0}
    want = collections.Counter((k, *sha(t), "revisit" if first.get(t, k) != k else "response", first[t] if first.get(t, k) != k else None) for k, _, t, _ in rows)
    assert got == want


def test_warc_reads_chosen_records_in_few_ranges(spark):
    rows = spark.createDataFrame([(k, f"u{k}", f"text {k} " * 30) for k in range(40)], "key bigint, url string, payload string").coalesce(1)
    folder = common.work_path(spark, "warc-test")
    index = warc.write_archives(spark, warc.mark_revisits(spark, rows, broadcast_rows=-1), folder)
    some = index.where("key % 10 < 3")
    assert warc.coalesce_ranges(some, gap=10).count() == 4 and warc.coalesce_ranges(some).count() == 1
    assert {(r.key, r.payload) for r in warc.read_records(spark, some, folder).collect()} == {(k, f"text {k} " * 30) for k in range(40) if k % 10 < 3}
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 2 language -----------------------------------------------------------------------------------


def test_languages_are_told_apart(spark, no_docs):
    rng = np.random.default_rng(3)
    parts = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["the", "ing", "er", "wh"], "cc": ["ção", "ñe", "él", "üm"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))
    rows = [(k, make(lang, int(rng.integers(3, 60))), lang if k % 9 else None) for k, lang in enumerate(list(parts) * 120)] + [(900, None, "aa"), (901, " 12 !", "aa"), (902, "", "bb")]
    truth = {k: list(parts)[k % 3] for k in range(360)}
    got = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [k for k in truth if got[k].held_out]
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.97 * len(held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(spark, no_docs).count() == 0


def test_without_labels_all_is_unknown(spark):
    got = langid.identify(spark, spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_each_language_is_learned_within_the_bound(spark, monkeypatch):
    seen = {}

    def train(bucket, offs, label, languages, **more):
        seen.update(zip(languages, np.bincount(label, minlength=len(languages)).tolist(), strict=True))
        return langid.Model(languages, np.zeros((langid.BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32))

    monkeypatch.setattr(langid, "train", train)
    rows = [(None, f"word{k} " * 5, "nulls") for k in range(200)] + [(k, f"long{k} " * 100_000, "long") for k in range(20)] + [(k, f"text{k} " * 10, "large") for k in range(3000)] + [(None, "same words", "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 50)
    langid.fit(spark, docs, F.lit(True))
    assert seen["nulls"] == seen["large"] == 50 and 1 <= seen["long"] <= 3 and seen["same"] == 1
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 4)
    langid.fit(spark, docs, F.lit(True))
    assert seen == {"nulls": 1, "long": 1, "large": 1, "same": 1}


# 3 Jaccard ------------------------------------------------------------------------------------


def shingles(text):
    w = split(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_truth(rows):
    sets = [shingles(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    best = {}
    for k, r in enumerate(rows):
        best[find(k)] = min(best.get(find(k), math.inf), math.inf if r[0] is None else r[0])
    return collections.Counter((r[0], len(sets[k]), None if best[find(k)] == math.inf else best[find(k)], links[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("unit", [1024, 3])
def test_jaccard_components(spark, docs, rows, monkeypatch, unit):
    monkeypatch.setattr(jaccard, "UNIT_SETS", unit)
    assert multiset(jaccard.join(spark, docs), "doc_id", "n_shingles", "component_id", "n_links") == jaccard_truth(rows)


def test_jaccard_counts_links_once_beside_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 30)
    texts = [" ".join(f"w{k}x{i}" for i in range(70)) for k in range(30)]
    rows = [(2 * k + j, t + " end" * j) for k, t in enumerate(texts) for j in (0, 1)]
    got = multiset(jaccard.join(spark, spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == jaccard_truth(rows)


def test_jaccard_unit_agrees_with_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**60, 40, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.12, rng.integers(1, 2**60, 40, dtype=np.uint64), base)) for _ in range(60)]
    size = [len(s) for s in sets]
    unit = jaccard.Unit(list(range(60)), size, [n - jaccard.least_overlap(n) + 1 for n in size], [s.tobytes() for s in sets], [0] * 60, [1] * 60)
    unit.join()
    linked = lambda a, b: 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (size[a] + size[b] - i)
    order = unit.rids
    assert list(unit.links) == [sum(linked(a, b) for b in range(60) if a != b) for a in order]


def test_jaccard_of_nothing(spark, no_docs):
    assert jaccard.join(spark, no_docs).count() == 0


# 4 mixing -------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, docs, rows, no_docs):
    got = mixing.mix(spark, docs, slices=7).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(split(r[1]))
    sources = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources) and len(got) == len(rows)
    assert multiset(mixing.mix(spark, docs.repartition(2), slices=7), "doc_id", "size", "taken") == collections.Counter((r.doc_id, r.size, r.taken) for r in got)
    assert multiset(mixing.mix(spark, docs), "doc_id", "size", "taken") == collections.Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(spark, no_docs).count() == 0


def test_mixed_corpus_has_the_words_taken(spark, docs):
    mixed = mixing.apply_mix(spark, docs)
    assert mixed.columns == docs.columns
    words_of = mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words_of == mixing.mix(spark, docs).agg(F.sum("taken")).first()[0]


# 5 token files --------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


def test_pieces_give_the_ids_of_whole_texts():
    import random

    rng, whole, enc = random.Random(1), tokenizer(), token_files.Encoder(token_files.tokenizer_path())
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "é", " ", "　", "'s", "'t", "1", "23", "<|endoftext|>", "!", "\x1f", "\x85", "𝄞", "B", "\r\n", "...", " a", " the", "…", "x,y", "ß!"]
    for _ in range(400):
        raw = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))).encode() for _ in range(4)]
        ids, ends = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [list(ids[ends[k] : ends[k + 1]]) for k in range(4)] == [whole.encode(t.decode(), add_special_tokens=False).ids for t in raw]


def test_piece_table_grows():
    table, rng = token_files.PieceTable(bits=4), np.random.default_rng(1)
    seen = {}
    for _ in range(5):
        h = rng.integers(1, 2**63, 40, dtype=np.uint64)
        table.add(h, np.full(40, 2), np.repeat(h & np.uint64(0xFFFF), 2).astype(np.int32))
        seen |= {int(x): int(x) & 0xFFFF for x in h}
    place = table.find(np.array(list(seen), np.uint64))
    assert (table.ids[table.begin[place]] == list(seen.values())).all() and table.mask.bit_length() > 4
    assert table.find(np.array([5], np.uint64)) == -1
    table.clear()
    assert table.mask.bit_length() == 4 and (table.find(np.array(list(seen), np.uint64)) == -1).all()


def test_token_files_round_trip(spark, docs, rows, no_docs):
    folder = common.work_path(spark, "tokens-test")
    token_files.write_orc(spark, docs, folder)
    whole = tokenizer()
    ids = {k: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for k, r in enumerate(rows)}
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    got = sorted(token_files.starts(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((rows[k][0], len(x), crc(x)) for k, x in ids.items())
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert {r.doc_id for r in token_files.find(spark, folder, [3, 7, 999]).collect()} == {3, 7}
    assert "PushedFilters: [In(doc_id" in token_files.find(spark, folder, [3, 7])._jdf.queryExecution().toString()
    assert token_files.round_trip(spark, no_docs).count() == 0


# 6 substrings ---------------------------------------------------------------------------------


def substring_truth(rows):
    order = sorted(range(len(rows)), key=lambda k: (math.inf if rows[k][0] is None else rows[k][0]))
    seen, out = set(), {}
    for k in order:
        w, gone = split(rows[k][1]), set()
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                gone.update(range(i, i + 20))
            seen.add(x)
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_repeated_passages_go(spark, docs, rows, hot, no_docs):
    unique = [r for r in rows if r[0] is not None][:-1]  # ids that occur twice have no fixed order
    frame = docs.where("doc_id is not null").where(~((F.col("doc_id") == 5) & F.col("text").isin([r[1] for r in rows if r[0] == 5][1:])))
    want = substring_truth(unique)
    got = multiset(substrings.report(spark, frame, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == collections.Counter((unique[k][0], *v) for k, v in want.items())
    assert sum(v[1] for v in want.values()) > 500
    if hot == 1:
        assert substrings.report(spark, no_docs).count() == 0


# 7 chat ---------------------------------------------------------------------------------------


def test_preferences_share_their_prompt(spark):
    rows = [
        (0, True, 0, "user", "hi"), (0, True, 1, "assistant", "yes <|end|>"), (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "no"), (0, False, 2, "user", None),
        (1, True, 0, None, "x"), (2, False, 0, "assistant", "only"), (3, True, 0, "user", "same"), (3, False, 0, "user", "same"), (3, False, 1, "assistant", "more"),
    ]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id bigint, chosen boolean, turn bigint, role string, text string")).collect()}
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|turn|>user\nhi<|end|>\n"
    spans = lambda text, mask: [text[slice(*map(int, m.split("-")))] for m in mask.split(",") if m]
    assert spans(got[0].chosen, got[0].chosen_mask) == ["yes < |end|><|end|>"] and spans(got[0].rejected, got[0].rejected_mask) == ["no<|end|>"]
    assert got[0].rejected.endswith("<|turn|>user\n<|end|>\n")
    assert got[1].chosen == "<|turn|>unknown\nx<|end|>\n" and got[1].rejected == "" and got[2].chosen == "" and got[3].chosen == "" and got[3].n_prompt_turns == 1


# 8 quality ------------------------------------------------------------------------------------


def statistics_truth(text):
    w, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
    seen, cover = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = multiset(quality.judge(spark, docs, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = collections.Counter()
    for r in rows:
        s = statistics_truth(r[1])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want[(r[0], *s, failed, not failed)] += 1
    assert got == want and quality.judge(spark, no_docs, labels).count() == 0


def test_rules_are_learned_and_readable():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.1) & (x[:, 2] > 0.5))
    rules = quality.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality._covers(r, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.96 and bad[hit].mean() > 0.95 and all(len(r) <= 3 for r in rules)
    assert quality.learn(x, np.zeros(3000, bool), ["a", "b", "c"]) == []


# 9 decontamination ----------------------------------------------------------------------------


def test_passages_of_the_benchmark_are_found(spark, docs, rows, no_docs):
    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: split(t, letters, True)
    items = [(1, rows[0][1][40:300]), (10, " ".join(low(rows[2][1])[:12])), (2, "One TWO!"), (3, None), (4, "..."), (None, "alone"), (7, "no such words at all in there"), (10, rows[4][1][:120]), (8, "alone")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = collections.Counter()
    for r in rows:
        w, hit, found = low(r[1]), set(), set()
        for i, t in items:
            if i is not None and (p := low(t)):
                n = min(10, len(p))
                for a in range(len(p) - n + 1):
                    for b in range(len(w) - n + 1):
                        if w[b] == p[a] and w[b : b + n] == p[a : a + n]:
                            hit.update(range(b, b + n))
                            found.add(i)
        want[(r[0], len(w), len(hit), len(found), positional.digest(sorted(found)), bool(hit))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert multiset(positional.report(spark, docs, bench), *columns) == want
    index = positional.build_index(spark, docs, segment_bytes=2000)
    assert index.count() > 5 and len(list(positional.phrase_blocks(spark, bench, block_words=20))) > 1
    again = positional.search(spark, index, bench, block_words=20)  # the same index, block by block
    assert multiset(again, "doc_id", "n_words", "n_hit") == collections.Counter(k[:3] for k in want.elements())
    for r in again.collect():
        assert len({i for s in r.spans for i in range(s.start, s.stop)}) == r.n_hit
    assert positional.report(spark, no_docs, bench).count() == 0
    assert positional.report(spark, docs, bench.limit(0)).where("contaminated").count() == 0


def near_truth(words_, phrase, slop):
    need = collections.Counter(phrase)
    span = len(phrase) + slop
    return any(not need - collections.Counter(words_[a : a + span]) for a in range(max(1, len(words_) - span + 1)))


def test_proximity_agrees_with_spans(spark):
    import random

    rng = random.Random(4)
    texts = ["red blue x green", "green y red blue", "red a b c d e blue green", "red red blue", "", None] + [" ".join(rng.choice("red blue green a b".split()) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    items = ["red blue green", "red red blue", "a b a b green", "none at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: sorted(r.near) for r in positional.decontaminate(spark, docs, bench, slop=1).collect()}
    assert got == {k: [i for i, p in enumerate(items) if near_truth((t or "").split(), p.split(), 1)] for k, t in enumerate(texts)}
    assert got[0] == got[1] == [0] and got[2] == []


# 10 language model ----------------------------------------------------------------------------


def test_scores_and_counts(spark, docs, rows, no_docs):
    got = sorted(lm.score(spark, docs).collect(), key=str)
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    tokens = [[*split(r[1], lower=True), None] for r in rows]
    one = collections.Counter(t for r, x in zip(rows, tokens) if learn(r[0]) for t in x)
    two = collections.Counter(p for r, x in zip(rows, tokens) if learn(r[0]) for p in zip([None, *x[:-1]], x))
    n, v = sum(one.values()), len(one)
    base = lambda t: (one[t] + 0.5) / (n + 0.5 * (v + 1))
    want = sorted(((r[0], not learn(r[0]), len(x), sum(one[t] > 0 for t in x), n, sum(math.log10(base(t)) for t in x)) for r, x in zip(rows, tokens)), key=str)
    key = lambda r: (str(r[0]), r[2], r[3])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5] and g.base_score == pytest.approx(w[5]) and g.score < 0
    better = [g.score - g.base_score for g in got if not g.held_out and g.n_tokens > 30]
    assert sum(better) > 0 and two
    assert lm.score(spark, no_docs).count() == 0


def test_mixture_weights_follow_the_evidence():
    cells = CELLS = lm.CELLS * lm.POWERS + 1
    at = lambda bucket, k: float((bucket * cells + k) * CELLS + 5)
    good, bad = (at(5, 3), 1000.0, 900.0, 1.0), (at(2, 0), 1000.0, 0.0, 10.0)
    w = lm.mixture([good, bad])
    assert w[5] > 0.99 and w[2] < 0.01 and w[0] == 0


def test_probabilities_sum_to_one():
    sizes = lm.Sizes(tokens=12, types=3)
    assert sum(sizes.base(np.array([7, 4, 1, 0]))) == pytest.approx(1.0)


def test_exchange_over_several_steps(spark, monkeypatch):
    """Sums are exact at any number of steps, and rows sent stay linear in the chunks."""
    monkeypatch.setattr(chunks, "FAN", 4)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i) % 90}" for i in range(60)) + " the" * 40) for k in range(60)], "doc_id bigint, text string").repartition(6)
    packed = chunks.pack(spark, docs, chunk_bytes=900).cache()
    n = packed.count()
    assert n > 20

    def keys_of(row):
        _, _, data, offs = chunks.rows_of(row)
        for kind, lower in ((1, True), (2, False)):
            keys, counts = np.unique(words.split(data, offs, lower=lower).hashes, return_counts=True)
            yield kind, keys, counts.astype(np.uint64) * np.uint64(3_000_000_000)  # beyond 32 bits

    truth, own = collections.Counter(), {}
    for r in packed.collect():
        for kind, keys, counts in keys_of(r.asDict()):
            own[r.chunk, kind] = keys
            truth.update({(kind, int(k)): int(c) for k, c in zip(keys, counts)})
    for buckets, steps in ((3, 1), (16, 2), (40, 3)):
        assert chunks._steps(buckets)[1] == steps
        made = len(common.CREATED)
        sums, last = chunks.exchange(spark, packed, keys_of, buckets)
        got = collections.defaultdict(list)
        for r in sums.collect():
            got[r.sender].append(r.asDict())
        for (chunk, kind), keys in own.items():
            assert chunks.sums_of(got[chunk], kind).tolist() == [truth[kind, int(k)] for k in keys]
        told = {r.kind: (r.n, r.t) for r in last.groupBy("kind").agg(F.sum("types").alias("n"), F.sum("total").alias("t")).collect()}
        assert told == {kind: (sum(k == kind for k, _ in truth), sum(c for (k, _), c in truth.items() if k == kind)) for kind in (1, 2)}
        for path in common.CREATED[made:]:
            if "asked" in path:
                asked = spark.read.parquet(path)
                assert asked.count() <= 2 * 4 * n and asked.groupBy("kind", "slot", "group").count().agg(F.max("count")).first()[0] <= 16


def test_packed_numbers():
    for a in ([], [0, 0], [1, 255, 256, 3], [2**64 - 1, 0, 7], [2**33]):
        a = np.array(a, np.uint64)
        assert common.unpack_numbers(common.pack_numbers(a)).tolist() == a.tolist()
        assert common.unpack_sorted(common.pack_sorted(np.sort(a))).tolist() == sorted(a.tolist())


def test_chunks_bound_texts_and_keep_order(spark):
    rows = spark.createDataFrame([(k, "w" * (k % 50) * 10) for k in range(300)], "doc_id bigint, text string").coalesce(2)
    packed = chunks.pack(spark, rows, chunk_bytes=4000)
    got = {}
    for r in packed.collect():
        _, ids, data, offs = chunks.rows_of(r.asDict())
        got |= {i: data[a:b].tobytes().decode() for i, a, b in zip(ids, offs, offs[1:])}
    assert got == {k: "w" * (k % 50) * 10 for k in range(300)} and packed.count() > 10
