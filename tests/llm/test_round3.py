"""Token files, phrases and resampling against plain versions of themselves, and their odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cueline.llm import mixing, phrases, quality, resample, tokenfiles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, start string, total string, ids int, f int, g int, block int, n int, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcAB") for _ in range(rnd.randrange(1, 3)))
    texts = [None, "", " \n\t", "one", "Ein Wort. Ein Wort; EIN wort\x0bein\tWort", "a <|endoftext|> b<|ENDOFTEXT|>c's, don't!!", "É́ İ ß \U0001f600x y", *[" ".join(word() + rnd.choice(["", "", ",", ".\n"]) for _ in range(rnd.randrange(5, 200))) for _ in range(40)], "w " * 150_000]
    out = [(i, t, "en" if i % 3 else None, "s", "t", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return [*out, out[9], (9, "another text under the same id", *out[0][2:]), (None, "no id", None, *[None] * 8), (None, None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("path, apart, end", [(WORD_BPE, True, 1), (BYTE_BPE, False, 50256)])
def test_token_files_give_back_what_the_library_encodes(spark, docs, rows, path, apart, end, tmp_path):
    """In the order of ids, also where documents are cut by blocks; and read back whole or in part."""
    folder = tokenfiles.token_files(docs, path, str(tmp_path / "ids"), apart=apart, end=end)
    library = Tokenizer.from_file(path)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t, *_ in rows]
    got = sorted(tokenfiles.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((i or -1, x) for i, x in want)
    assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: -1 if i is None else i)
    at, digests = 0, {r.start: r for r in tokenfiles.file_digests(spark, folder).collect()}
    for r in got:
        d = digests[at]
        assert (r.start, d.doc_id, d.n_tokens, d.ids_crc32) == (at, r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    some = spark.createDataFrame([(4,), (9,), (47,), (4,), (999,)], "doc_id long")
    assert sorted((r.doc_id, r.start, r.ids) for r in tokenfiles.read_ids(spark, folder, some).collect()) == sorted((r.doc_id, r.start, r.ids) for r in got if r.doc_id in (4, 9, 47))
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("crc", F.col("crc") + 1)
    blocks.write.parquet(f"{folder}/x/blocks")
    spark.read.parquet(f"{folder}/codes").write.parquet(f"{folder}/x/codes")
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read_pieces(spark, f"{folder}/x").collect()


def test_token_files_of_nothing(spark, docs):
    folder = tokenfiles.token_files(docs.filter("false"), WORD_BPE, apart=True)
    assert tokenfiles.file_digests(spark, folder).count() == 0
    assert tokenfiles.read_ids(spark, folder).count() == 0


def test_words_apart_are_the_library_s_ids():
    rnd, encoder, library = random.Random(3), tokenfiles.Encoder(WORD_BPE, True, remember=300), Tokenizer.from_file(WORD_BPE)
    texts = ["".join(rnd.choice("aAiIzṠ̈́'’s.,!<|>İẞ9１ \x0b\n\x1c\x85\xa0éÉΣ…‍") for _ in range(rnd.randrange(30))) for _ in range(5000)]
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], encoder([t.encode() for t in texts[at : at + 500]], 1)):
            assert np.frombuffer(ids, encoder.width).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def plain_cost(counts):
    heap, cost = sorted(c for c in counts if c), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=70), st.integers(7, 20), st.integers(0, 2**32))
def test_codes_round_trip(counts, longest, seed):
    counts = np.array(counts)
    lengths = tokenfiles.code_lengths(counts, longest)
    used = np.flatnonzero(counts)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max() <= longest
    if len(used) > 1:
        assert sum(2.0 ** -int(n) for n in lengths[used]) == 1
        if longest == 20 and plain_cost(counts.tolist()) and counts[used].min() * 2**18 > counts.sum():
            assert int((counts * lengths).sum()) == plain_cost(counts.tolist())
    if len(used):
        ids = used[np.random.default_rng(seed).integers(0, len(used), 1500)]
        payload, at = tokenfiles.packed(tokenfiles.canonical(lengths)[ids], lengths[ids])
        decode = tokenfiles.Decoder(lengths)
        assert decode([payload, payload], [at[:: tokenfiles.STEP]] * 2, [len(ids)] * 2)[1].tolist() == ids.tolist()
        assert decode([payload], [at[256::256]], [len(ids) - 256])[0].tolist() == ids[256:].tolist()  # from a checkpoint


def test_limited_codes_are_the_best():
    """Package-merge against all ways to give five symbols lengths of up to three bits."""
    from itertools import product

    for seed in range(40):
        counts = np.random.default_rng(seed).integers(1, 60, 5)
        best = min(sum(c * n for c, n in zip(counts, ns)) for ns in product((1, 2, 3), repeat=5) if sum(2.0**-n for n in ns) <= 1)
        assert int((counts * tokenfiles.code_lengths(counts, 3)).sum()) == best


def test_crc_of_pieces():
    rnd = np.random.default_rng(1)
    for n, m in ((0, 0), (5, 0), (4, 12), (100, 40_000)):
        a, b = rnd.bytes(n), rnd.bytes(m)
        assert tokenfiles._shifted(zlib.crc32(a), m) ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain_phrases(rows, longest, least, inside, top):
    f, n, out = Counter(), Counter(), []
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    drop = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and 100 * a >= inside * f[(lang, w[i:j])]}
    for (lang, w), a in found.items():
        if (lang, w) not in drop:
            score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    rank = Counter()
    return [(x[0], rank[x[0]], x[3].decode(), -x[2], x[4], x[5], n[x[0]], -x[1]) for x in out if not rank.update([x[0]]) and rank[x[0]] <= top]


@pytest.mark.parametrize("longest, least, inside, top, block", [(3, 10, 50, 2000, 1 << 21), (4, 3, 80, 25, 300), (2, 2, 50, 7, 50)])
def test_phrases(docs, rows, longest, least, inside, top, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    got = phrases.collocations(docs, longest=longest, least=least, inside=inside, top=top).collect()
    want = plain_phrases(rows, longest, least, inside, top)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


def test_phrases_of_nothing(docs):
    assert phrases.collocations(docs.filter("false")).count() == 0
    assert phrases.collocations(docs.filter("doc_id < 3")).count() == 0


def test_ratio_is_exact_beyond_64_bits(spark):
    big = [(10, 10, 10), (123_456_789_012, 123_456_789_013, 987_654_321_987), (10**13 + 1, 10**13 + 1, 10**13 + 1), (10**13, 10**13 + 1, 10**13)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(phrases.ratio(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [x[0] for x in got] == [10**6 * a * a // (l * r) for a, l, r in big]


def plain_draw(rows, target, longest, buckets, seed, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    hashed = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for r in rows for b in hashed(words(r[1]))), Counter(b for x in target for b in hashed(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r in rows:
        fs = hashed(words(r[1]))
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        out.append([r[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(r[1])) >= least])
    able = sorted((-x[3], math.inf if x[0] is None else x[0]) for x in out if x[4])
    return sorted((-1 if x[0] is None else x[0], *x[1:4]) for x in out), [x[1] for x in able[: percent * len(able) // 100]]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 55), (2, 1000, 100)])
def test_resampling(spark, docs, rows, longest, buckets, percent):
    target = ["aba b A", None, "one text; another"]
    options = {"longest": longest, "buckets": buckets, "percent": percent, "least_words": 3}
    found = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.importance(docs, found, **options).collect()
    want, drawn = plain_draw(rows, target, longest, buckets, 2024, 3, percent)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [math.inf if r.doc_id is None else r.doc_id for r in ranked] == drawn
    kept = resample.drawn_documents(docs, found, **options)
    assert kept.columns == docs.columns
    assert sorted(math.inf if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(drawn)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.importance(docs.filter("false"), none).count() == 0
    assert {r.weight for r in resample.importance(docs.filter("doc_id < 3"), none).collect()} == {0}


def test_queries_on_the_small_table(spark):
    """op11 and op13 on whole texts of the given tables against the library and the plain draw; op12 has SQL."""
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    library, at, want = Tokenizer.from_file(WORD_BPE), 0, []
    for doc_id, text in table:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfiles.op11_token_files(spark, SMALL).collect())) == want
    scores, drawn = plain_draw(table, bench, 1, 10_000, 2024, 20, 10)
    got = resample.op13_resampling(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == scores
    assert [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn


def test_rejected_rows_go_whatever_shares_their_id(spark):
    """By id, text, language and source: null and repeated ids are no cover for junk."""
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(90))
    rows = [(i, good(), "en", "s", 0) for i in range(60)] + [(1, good(), "en", "s", 1), (1, "a b", "en", "s", 2), (None, good(), None, "s", 3), (None, "junk", None, "s", 4), (None, None, None, None, 5), (7, "a b", "en", "s", 6), (7, "a b", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.kept for r in kept.collect()} == {0, 1, 3} and quality.kept_documents(docs.filter("false")).count() == 0


def test_mixed_rows_follow_the_mix(spark):
    """As many rows as are taken, also of texts under one id, of copies and of null ids; the same again on a rerun."""
    rnd = random.Random(2)
    rows = [(i if i % 7 else None, " ".join("w" * rnd.randrange(1, 20)), rnd.choice(("a", "b", None)), i, i) for i in range(120)]
    rows += [(500, "x y", "a", 1, 1)] * 5 + [(500, "y x", "a", 1, 1), (500, "y x", "b", 1, 1), (501, None, "a", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _own int, size int")
    taken, got = Counter(), Counter()
    for r in mixing.mix(docs, max_epochs=3).collect():
        taken[(r.doc_id, r.source, r.text_hash)] += r.reps if r.size else 0
    mixed = mixing.mixed_documents(docs.repartition(5)).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    assert mixed.columns == [*docs.columns, "h"]
    for r in mixed.collect():
        got[(r.doc_id, r.source, r.h)] += 1
    assert {k: v for k, v in got.items() if k[0] != 501} == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(docs.filter("false")).count() == 0
