import hashlib
import random
import re
from collections import Counter

import pytest
from cueline.llm import exact, fmindex, licences, mixing, near, packing, quality, segments, sharding, suffix, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in any column, empty, blank and long texts, copies, near copies, shared passages, repeated rows, clashing names."""
    rnd = random.Random(8)
    passage, base = prose(rnd, 120), prose(rnd, 300)
    words = base.split(" ")
    texts = [None, "", " \n\t", "one", "one  two", "one two", base, base, " ".join(["x", *words[1:]]), f"{prose(rnd, 50)} {passage} {prose(rnd, 40)}", f"{passage} {prose(rnd, 90)}", passage + " " + passage, "a b " * 400, prose(rnd, 9000), "é" * 900 + " ü" * 300]
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", 1, True, i) for i, t in enumerate(texts)]
    return [*out, out[9], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def unique(spark, rows):
    return spark.createDataFrame(rows[:15], SCHEMA)


OPERATORS = [suffix.suffix_dedup, fmindex.substring_dedup, mixing.mix, sharding.shard, quality.quality, tokens.count_tokens, near.near_groups, exact.exact_groups, tokens.token_trees]


@pytest.mark.parametrize("op", OPERATORS)
def test_odd_rows_and_empty_tables(spark, docs, op):
    assert op(docs).count() == docs.count()
    assert op(docs.filter("false")).count() == 0


@pytest.mark.parametrize("most", [4096, 1])
def test_repeated_bytes(unique, rows, most, monkeypatch):
    monkeypatch.setattr(segments, "MOST", most)
    texts = {r[0]: (r[1] or "").encode() for r in rows[:15]}
    seen = Counter(b[i : i + 400] for b in texts.values() for i in range(len(b) - 399))
    for r in suffix.suffix_dedup(unique).collect():
        b = texts[r.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("most", [4096, 1])
def test_repeated_windows_of_words(unique, rows, most, monkeypatch):
    monkeypatch.setattr(segments, "MOST", most)
    texts, first = {r[0]: WORD.findall(r[1] or "") for r in rows[:15]}, {}
    for i, w in sorted(texts.items()):
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for r in fmindex.substring_dedup(unique).collect():
        w = texts[r.doc_id]
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (r.doc_id, k):
                gone.update(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_deep_shallow_sorts():
    rnd = random.Random(2)
    for _ in range(50):
        base = bytes(rnd.choice(b"ab") for _ in range(120))
        strings = [base[: rnd.randrange(0, 120)] + bytes(rnd.choice(b"\0ab") for _ in range(rnd.randrange(0, 12))) for _ in range(40)]
        assert [strings[k] for k in suffix.deep_shallow(strings, 16)] == sorted(strings)


def test_groups_of_odd_rows(unique):
    got = {r.doc_id: r for r in near.near_groups(unique, shingle=3, percent=85).collect()}
    assert got[6].component_id == got[7].component_id == got[8].component_id == 6
    assert got[4].component_id == got[5].component_id == 4 and got[4].n_shingles == 1
    assert [got[i].component_id for i in (0, 1, 2, 3)] == [0, 1, 2, 3] and got[0].n_shingles == 0
    assert sum(r.kept for r in got.values()) == 12


def test_exact_groups(unique):
    got = {r.doc_id: r for r in exact.exact_groups(unique).collect()}
    assert got[0].keep_id == got[1].keep_id == 0 and not got[1].kept
    assert got[2].keep_id == 2 and got[5].keep_id == 4 and got[7].keep_id == 6 and got[7].group_size == 2


def test_chunks_join_to_the_text():
    data = prose(random.Random(1), 5000).encode()
    ends = exact.chunk_ends(data)
    assert ends[-1] == len(data) and all(b - a <= exact.MOST for a, b in zip([0, *ends], ends))


def test_shards_are_even_and_gapless(docs):
    got = sharding.shard(docs).collect()
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(got) // 8, -(-len(got) // 8))


def test_mix_targets(unique, rows):
    got = mixing.mix(unique).collect()
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9 for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6


def test_edits_count_as_a_full_encoding():
    c, rnd, alpha = tokens.Counter(), random.Random(4), "ab  \n'st1.é  ll,"
    for _ in range(400):
        t = "".join(rnd.choice(alpha) for _ in range(rnd.randrange(0, 60)))
        cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t) // 4 * 2, 6)))
        edits = [(a, b, "".join(rnd.choice(alpha) for _ in range(rnd.randrange(0, 4)))) for a, b in zip(cuts[::2], cuts[1::2])]
        tree = tokens.TokenTree(t, c)
        tree.edit(edits)
        for a, b, x in reversed(edits):
            t = t[:a] + x + t[b:]
        assert tree.text == t and tree.total == len(c.encoding.encode_ordinary(t))


def test_bins_hold_their_pieces(docs):
    got = packing.packed_sequences(docs).collect()
    used = Counter()
    for r in got:
        used[r.block, r.bin] += r.size
    assert all(used[r.block, r.bin] <= r.capacity and r.at + r.size <= r.capacity for r in got)
    assert sum(r.size for r in got if r.doc_id == 13) == 9001


def test_licences_are_inherited(spark):
    rows = [(1, "x/LICENSE", "Released under the MIT License."), (2, "x/y/a.txt", "hello"), (3, "z/b.txt", None), (4, "x/y/c.txt", "a\nLicensed under CC BY-NC 4.0.\nb"), (5, None, "free")]
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "directory"), 3: (None, "none"), 4: ("CC-BY-NC-4.0", "header"), 5: (None, "none")}


def test_base_rules(unique, rows):
    for r in quality.quality(unique).collect():
        w = WORD.findall(rows[r.doc_id][1] or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_small_groups_and_clean_texts_are_judged(spark):
    """A source of 5 rows is judged by its language, a language of 5 by all rows; a clean text in a symbol-heavy source stays."""
    rnd = random.Random(6)
    plain = lambda: prose(rnd, 80)
    texts = [(plain(), "de", "big") for _ in range(90)]
    for lang, source in (("de", "small"), ("xx", None)):
        texts += [(plain().replace(" ", "%%% &&&"), lang, source), *[(plain(), lang, source) for _ in range(4)]]
    texts += [(plain().replace(" ", " & "), "en", "loud") for _ in range(20)] + [(plain(), "en", "loud")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(got) == list(range(len(texts))) and all(r.distance2 is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {90, 95}
    assert got[len(texts) - 1].distance2 > quality.CUTOFF


def test_licence_wordings_and_whole_files(spark):
    """Titles, other wordings, notices beside a copyright or broken over lines, whole files; and plain words that are no notice."""
    bsd = "Copyright (c) 2020, Jane Roe\n\n" + "\n".join(re.findall(r".{1,70}(?: |$)", licences.BSD_TEXT.replace("\n", " ")))
    texts = ["MIT License", "Distributed under the MIT license.", "Copyright 2024 ACME. Released under the MIT License.", "It is released under the MIT License, see the LICENSE file for details.", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met"]
    rows = [(i, f"a/{i}.txt", t) for i, t in enumerate(texts)] + [(6, "b/LICENSE", bsd), (7, "b/x.txt", "hello"), (8, "c/y.txt", "We lost the driving licence and asked for permission to go."), (9, "c/z.txt", "copyright laws differ")]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: "GPL-3.0", 5: "BSD-3-Clause", 6: "BSD-3-Clause", 7: "BSD-3-Clause", 8: None, 9: None}
