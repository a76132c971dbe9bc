"""Phrases, alignment of tokenizers and byte-level BPE against brute force and the public libraries."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from treeloom.llm import alignment, byte_bpe, chunks, collocations, common
from treeloom.llm.perfect_hash import PerfectHash, StoredKeys

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 phrases ------------------------------------------------------------------------------------


def brute_phrases(rows, least, best):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + 2]) for (lang, p), a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * f[lang, p[i : i + 2]]}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:best], 1))


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, best, many", [(10, 2000, False), (2, 2000, True), (3, 5, True)])
def test_phrases(spark, rows, docs, no_docs, monkeypatch, least, best, many):
    if many:  # many shards, mappers and steps of the tree
        for name, value in (("SHARD_BYTES", 4000), ("GROUP_ENTRIES", 20), ("FAN_IN", 2)):
            monkeypatch.setattr(collocations, name, value)
    want = brute_phrases([(r[2], r[1]) for r in rows], least, best)
    assert want and told(collocations.mine(spark, docs, least, best)) == want
    assert collocations.mine(spark, no_docs, least, best).count() == 0


def test_phrases_stay_in_pieces_and_languages(spark):
    texts = [("en", "A b\tc. a  b, c!a b\nc"), ("fr", "a b c a b c"), (None, "É é É é"), ("und", "é É"), ("en", None), ("", "a b a b"), ("en", "x " * 500), ("en", "y" * 70_000 + " z")]
    rows = [(k, lang, t, "n", 0) for k, (lang, t) in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, n string, lang_key int").repartition(3)
    assert told(collocations.mine(spark, docs, 3)) == brute_phrases([(r[1], r[2]) for r in rows], 3, 2000)


def test_a_phrase_is_told_by_one_chunk(spark, docs, rows):
    packed = chunks.pack(spark, docs.selectExpr("crc32(coalesce(lang, 'und')) AS doc_id", "text").repartition(3), 2000)
    assert packed.count() > 10
    want = collections.Counter()
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((r[2], *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    want = sorted(n for n in want.values() if n >= 5)
    for salt in (0, 3):
        found = collocations._entries(spark, packed, 4, 3, 5, salt).collect()
        assert sorted(n for r in found if r["shard"] is not None for n in common.unpack_numbers(r["counts"]).tolist()) == want
        assert len({(r["shard"], name) for r in found if r["shard"] is not None for name in collocations._names(r["names"]).to_pylist()}) == len(want)
        assert sum(r["check"] for r in found) % 2**64 == 0 and any(r["check"] for r in found)


@pytest.mark.parametrize("fan", [chunks.FAN, 2])
def test_one_chunk_is_the_teller_of_a_key(spark, monkeypatch, fan):
    monkeypatch.setattr(chunks, "FAN", fan)
    packed = chunks.pack(spark, spark.range(40).selectExpr("id AS doc_id", "repeat('x', 50) AS text").repartition(4), 100)
    keys_of = lambda row: [(1, np.array([5, 2**63 + row["ids"][0] % 3, 2**64 - 1 - row["chunk"]], np.uint64), np.array([1, 2, 1], np.uint64))]
    told = collections.Counter()
    for r in chunks.exchange(spark, packed, keys_of, 8, least=3)[0].collect():
        told.update(common.unpack_numbers(r["counts"]).tolist())
    first = collections.Counter(r["ids"][0] % 3 for r in packed.collect())
    n = sum(first.values())
    want = collections.Counter({0: n})
    for count, senders in [(n, n), *((2 * k, k) for k in first.values())]:
        want.update({2 * count + 1: 1, 2 * count: senders - 1})
    assert n > 10 and told == want


def test_perfect_hash_is_minimal_and_names_are_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:0], np.arange(3000, dtype=np.uint64)):
        h = PerfectHash(some)
        assert sorted(h.slots(some)) == list(range(len(some))) and h.size == len(some)
    names = pa.array([b"a", b"b", b"c", b"d", b"e"], pa.binary())
    stored = StoredKeys(np.array([7, 7, 7, 8, 9], np.uint64), names)  # three names of one hash
    at = stored.find(np.array([7, 7, 7, 8, 9, 9, 5, 8], np.uint64), pa.array([b"a", b"b", b"c", b"d", b"e", b"x", b"a", b"a"], pa.binary()))
    assert sorted(at[:5]) == [0, 1, 2, 3, 4] and list(at[5:]) == [-1, -1, -1]
    row = lambda keys, names: {"keys": common.pack_sorted(np.array(keys, np.uint64)), "names": collocations._pack_names(names)}
    keys, names = collocations._joined(pa.Table.from_pylist([row([7, 8], [b"a", b"d"]), row([7, 9], [b"b", b"e"]), row([7, 8], [b"b", b"d"])]))
    assert sorted(zip(keys.tolist(), names.to_pylist())) == [(7, b"a"), (7, b"b"), (8, b"d"), (9, b"e")]


# 12 alignment ----------------------------------------------------------------------------------


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.vocabulary_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    counts, docs = collections.Counter(), []
    for t in texts:
        whole = (" " + (t or "")).encode()
        sides = [(a.encode(" " + t, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in a.id_to_token(i))), (b.encode(t), piece)] if t else []
        spelled = [[f(i) for i in ids] for ids, f in sides]
        if not t or any(b"".join(x) != whole for x in spelled):
            docs.append(None)
            continue
        spans = [[(sum(map(len, x[:k])) if len(x) < 400 else None, len(y)) for k, y in enumerate(x)] for x in spelled]
        for s in spans:
            at = 0
            for k, (_, size) in enumerate(s):
                s[k] = (at, at + size)
                at += size
        (ia, _), (ib, _) = sides
        links, j = [], 0
        for i, (p, q) in enumerate(spans[0]):
            while spans[1][j][1] <= p:
                j += 1
            k = j
            while k < len(ib) and spans[1][k][0] < q:
                links.append((ia[i], ib[k]))
                k += 1
        groups, i, j = [], 0, 0
        for e in sorted({q for _, q in spans[0]} & {q for _, q in spans[1]}):
            x, y = i, j
            while i < len(ia) and spans[0][i][1] <= e:
                i += 1
            while j < len(ib) and spans[1][j][1] <= e:
                j += 1
            groups.append(f"{','.join(map(str, ia[x:i]))}|{','.join(map(str, ib[y:j]))}")
        counts.update(links)
        docs.append((len(ia), len(ib), groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


ODD = ["▁ not a space", "<s> <|endoftext|> </s> <0x0A>", "  two  spaces ", " ", "\n\t\r", "日本語 ① ﬁ x　y", "a" * 3000, "é \x00 \x1c", "x", "\U0001f600 ok"]


@pytest.mark.parametrize("kept, segment", [(alignment.KEPT_PAIRS, alignment.SEGMENT_BYTES), (0, 300), (20, 64)])
def test_alignment(spark, rows, no_docs, kept, segment):
    texts = [r[1] for r in rows] + ODD
    table = [(k if k % 7 else 7, t, "x", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, row string, n_a int, pair int").repartition(3)
    got = alignment.report(spark, docs, kept_pairs=kept, segment_bytes=segment)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter((r[0], *w) for r, w in zip(table, brute_alignment(texts)))
    assert alignment.report(spark, no_docs, kept_pairs=kept).count() == 0


def test_segments_end_where_both_have_an_end():
    got = alignment._segments((np.arange(6), np.arange(4)), (np.array([2, 4, 6, 8, 10, 12]), np.array([4, 6, 9, 12])), 5)
    assert [[x.tolist() for x in s] for s in got] == [[[0, 1, 2], [2, 4, 6], [0, 1], [4, 6]], [[3, 4, 5], [2, 4, 6], [2, 3], [3, 6]]]


def test_ends_are_numbered_over_both_sides():
    got = alignment._numbered((np.array([2, 4, 900]), np.array([4, 60, 900])))
    assert [x.tolist() for x in got] == [[1, 2, 4], [2, 3, 4]]


# 13 byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    import tiktoken

    own = byte_bpe.Codec(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    return own, tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=own.merges.id_of, special_tokens={})


def one(codec, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return codec.encode(raw, np.array([0, len(raw)]))[0]


def test_ids_are_those_of_merging_by_rank(both):
    own, library = both
    rng = random.Random(2)
    alphabet = "aaabb  tionné\n'1xyzABC!!日本ü\x00\x1c  "
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 1000), rng.randrange(0x3000, 0x9000), 0x1F600])) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    for t in [*texts, *ODD, "a" * 20_000, "ab" * 9000, " " * 5000, "=-" * 4000, "don't 'RE we've"]:
        ids = one(own, t)
        assert ids.tolist() == library.encode_ordinary(t), t[:80]
        assert b"".join(own.decode(ids)) == t.encode()


def test_a_token_that_merging_never_makes_is_only_a_whole_piece(tmp_path):
    import tiktoken

    tokens = [bytes([k]) for k in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"abcd", b"xyz", b"bcd"]  # nothing merges to xyz
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate(tokens)))
    own = byte_bpe.Codec(str(path), r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=own.merges.id_of, special_tokens={})
    assert [t for t, made in zip(tokens, own.merges.made) if not made] == [b"xyz"]
    rng = random.Random(4)
    for text in ["xyz", "xyzxyz", "axyz", *("".join(rng.choice("abcdxyz ") for _ in range(rng.randint(1, 12))) for _ in range(3000))]:
        assert [i for p in own.split(text) for i in own.piece(p.encode())] == library.encode_ordinary(text), text


def test_bpe_report(spark, rows, docs, no_docs, both):
    _, library = both

    def want(text):
        ids = library.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = byte_bpe.report(spark, docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], *want(r[1])) for r in rows)
    decoded = byte_bpe.decode(byte_bpe.encode(spark, docs)).collect()
    assert collections.Counter((r.doc_id, bytes(r.data)) for r in decoded) == collections.Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.report(spark, no_docs).count() == byte_bpe.decode(byte_bpe.encode(spark, no_docs)).count() == 0
