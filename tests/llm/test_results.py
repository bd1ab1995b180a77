"""Operators against plain versions of themselves, and cases that once lost or changed rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from cueline.llm import exact, fmindex, graph, licences, near, packing, quality, segments, tokens
from cueline.llm.common import fresh

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(n))


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_groups_match_all_pairs_of_texts(spark):
    """The small table and 60 planted pairs just above and just below the threshold: every pair of texts is compared."""
    rnd = random.Random(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for k in range(60):
        base = prose(rnd, 400).split(" ")
        other = list(base)
        for i in rnd.sample(range(0, 400, 4), rnd.randrange(8, 13)):
            other[i] = "zz"
        texts[10_000 + 2 * k], texts[10_001 + 2 * k] = " ".join(base), " ".join(other)
    sets, root, links = {i: shingles(t, 3) for i, t in texts.items()}, {i: i for i in texts}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links += i >= 10_000
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert 10 < links < 60
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_texts_under_one_id_are_kept_apart(spark):
    """Near and exact deduplication drop rows by id and text, never a different text under the same id."""
    rnd = random.Random(5)
    a, b = prose(rnd, 60), prose(rnd, 60)
    docs = spark.createDataFrame([(1, a, 7), (2, b, 8), (2, a, 9), (None, None, 1)], "doc_id long, text string, _sha int")
    for kept in (near.kept_documents(docs), exact.kept_documents(docs)):
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r._sha) for r in kept.collect() if r.doc_id) == [(1, 7), (2, 8)]


def test_exact_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "x  y"), (3, "x  y"), (3, "z"), (None, "q"), (None, "q"), (None, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact.kept_documents(docs).collect()) == [(0, "q"), (3, "x  y"), (3, "z")]


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for op in (near.near_groups, tokens.count_tokens, fmindex.substring_dedup):
        with pytest.raises(TypeError):
            op(docs)
    assert [r.doc_id for r in packing.packed_sequences(docs).collect()] == ["a"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 3), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


@pytest.mark.parametrize("part", [1 << 20, 500])
def test_segments_of_texts_end_to_end(monkeypatch, part):
    """Segments of several texts, one of them of many parts, are the windows of each text, each once, with its anchor; none crosses a seam."""
    rnd = random.Random(1)
    texts = [prose(rnd, n) for n in (0, 700, 3, 60, 0, 1, 80)]
    x, offsets = segments.text_data(pa.array(texts))
    assert x.tobytes() == "".join(texts).encode() and offsets.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    monkeypatch.setattr(segments, "PART", part)
    of, fp, ctx, lo, d0, n = segments.text_segments(x, offsets, 100, 16)
    assert [(t, w) for t, a, k in zip(of, lo, n) for w in range(a, a + k)] == [(t, w) for t, s in enumerate(texts) for w in range(len(s) - 99)]
    assert (segments.gram_hashes(x, 16)[offsets[of] + lo + d0].view(np.int64) == fp).all()
    contents = {(texts[t][a : a + k + 99], d) for t, a, k, d in zip(of, lo, n, d0)}
    assert len(contents) == len(set(ctx.tolist()))


def test_words_of_texts_end_to_end():
    texts = ["a b", "", "c", "  d\te ", "é\u00a0x \x0b", "a", "b a"]
    column = pa.array(["cut off", *texts]).slice(1)
    data, offsets = segments.text_data(column)
    first, end, counts = fmindex.word_places(data, offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(first[i:j], end[i:j])] for i, j in zip(counts, counts[1:])]
    assert found == [WORD.findall(t) for t in texts]
    for slice_bytes in (1 << 20, 3):
        h, at = fmindex.words(column, slice_bytes)
        known = {}
        assert at.tolist() == counts.tolist() and all(known.setdefault(w, v) == v for w, v in zip([w for t in found for w in t], h.tolist()))
        assert len(set(known.values())) == len(known)


def test_index_locates_and_counts():
    """The compressed index gives back every place of a pattern, and the statistics of a stream of other documents."""
    rnd = np.random.default_rng(2)
    docs = [rnd.integers(1, 4, n) for n in (1, 3, 80, 0, 200)]
    index, text = fmindex.FMIndex(docs), np.concatenate([np.append(d, 0) for d in docs])
    assert sorted(index.locate(np.arange(len(text)))) == list(range(len(text)))
    stream = np.concatenate([rnd.integers(1, 4, 60), [0], docs[2]])
    found, lo, hi = index.matching_statistics(stream, 5, 1)
    for e in range(len(stream)):
        best = 0
        for k in range(1, 6):
            p = stream[e + 1 - k : e + 1]
            if k > e + 1 or 0 in p or not any((text[i : i + k] == p).all() for i in range(len(text) - k + 1)):
                break
            best = k
        assert found[e] == best
        if best:
            p = stream[e + 1 - best : e + 1]
            assert sorted(index.locate(np.arange(lo[e], hi[e]))) == [i for i in range(len(text) - best + 1) if (text[i : i + best] == p).all()]


def plain_pack(sizes, caps):
    """The cheapest of the plain best fits over all choices of bin sizes."""
    tried = [plain_best_fit(sizes, o, caps) for n in range(1, len(caps) + 1) for o in itertools.combinations(caps, n) if o[-1] >= max(sizes)]
    least = min(sum(map(packing.cost, t[1])) for t in tried)
    return [t for t in tried if sum(map(packing.cost, t[1])) == least]


def plain_best_fit(sizes, opening, caps):
    """Best fit by looking at every bin and every size that is left."""
    bins, out = [], []
    for k, s in enumerate(sizes):
        fits = [b for b in bins if b["cap"] - b["used"] >= s]
        if fits:
            b = min(fits, key=lambda b: (b["cap"] - b["used"], -b["when"]))
        else:

            def per_unit(c, s=s, k=k):
                free = c - s
                for x in sorted(sizes[k + 1 :], reverse=True):
                    free -= x if x <= free else 0
                return packing.cost(c) / (c - free), c

            b = {"cap": min((c for c in opening if c >= s), key=per_unit), "used": 0, "no": len(bins)}
            bins.append(b)
        out.append((b["no"], b["used"]))
        b["used"] += s
        b["when"] = k
    return out, [min(c for c in caps if c >= b["used"]) for b in bins], [b["cap"] for b in bins]


def test_packing_matches_a_plain_best_fit(spark):
    rnd = random.Random(9)
    for _ in range(8):
        sizes = sorted((min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(60)), reverse=True)
        bins, at, caps, opened = packing.pack(sizes)
        assert (list(zip(bins, at)), caps, opened) in plain_pack(sizes, packing.CAPACITIES)
    rows = [(i, prose(rnd, rnd.choice((0, 3, 100, 700, 1500)))) for i in range(120)] + [(None, prose(rnd, 5000)), (None, None), (2**60 + 1, "a"), (2**60 + 3, "b c")]
    got = packing.packed_sequences(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=40).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r)
    assert len(blocks) > 2
    for rs in blocks.values():
        rs.sort(key=lambda r: (-r.size, r.doc_id is None, r.doc_id or 0, r.piece))
        assert [(r.bin, r.at, r.capacity) for r in rs] in [[(b, a, caps[b]) for b, a in places] for places, caps, _ in plain_pack([r.size for r in rs], packing.CAPACITIES)]


def test_several_lengths_beat_the_longest_alone():
    total = lambda caps: sum(map(packing.cost, caps))
    for sizes in ([2040] * 30 + [3100] * 20 + [1000] * 30 + [505] * 40, [1500] * 60 + [900] * 40 + [450] * 30 + [2500] * 10):
        sizes = sorted(sizes, reverse=True)
        _, _, caps, opened = packing.pack(sizes)
        assert total(caps) <= min(total(packing.best_fit(sizes, (c,), packing.CAPACITIES)[2]) for c in packing.CAPACITIES if c >= sizes[0])
        if 2040 in sizes:
            assert len(set(opened[: len(opened) // 2])) > 1
            assert total(caps) < total(packing.best_fit(sizes, (4096,), packing.CAPACITIES)[2])


def test_two_batches_of_edits_on_kept_trees(spark):
    rnd, c = random.Random(7), tokens.Counter()
    texts = {i: None if i == 3 else prose(rnd, rnd.randrange(0, 300)) + "\n\n12345678" * (i % 3) for i in range(40)}

    def batch(now):
        out = []
        for i, t in now.items():
            cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t), 6) // 2 * 2))
            out.append((i, [(a, b, rnd.choice(("", " x", "it's ", "\n"))) for a, b in zip(cuts[::2], cuts[1::2])] if i % 5 else None))
        return out

    trees, now = tokens.token_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), {i: t or "" for i, t in texts.items()}
    for _ in range(2):
        edits = batch(now)
        for i, es in edits:
            for a, b, x in reversed(es or ()):
                now[i] = now[i][:a] + x + now[i][b:]
        given = spark.createDataFrame(edits, "doc_id long, edits array<struct<start:int,end:int,text:string>>")
        trees = tokens.edited_trees(trees.join(given, "doc_id"))
        for r in trees.collect():
            assert r.text == now[r.doc_id] and r.n_tokens == len(c.encoding.encode_ordinary(r.text)) == sum(r.counts)


def test_token_counts_match_full_encodings(spark):
    c = tokens.Counter()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokens.count_tokens(docs).collect():
        t, edits = texts[r.doc_id], tokens.cleaning_edits(texts[r.doc_id])
        assert (r.n_tokens, r.n_edits) == (len(c.encoding.encode_ordinary(t)), len(edits))
        for a, b, x in reversed(edits):
            t = t[:a] + x + t[b:]
        assert r.n_tokens_after == len(c.encoding.encode_ordinary(t))


def test_licences_match_a_plain_tf_idf(spark):
    docs = [(r.doc_id, f"d/{r.doc_id}.txt", r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs += [(10_000, "e/LICENSE", licences.BSD_TEXT), (10_001, "e/a.txt", None), (10_002, "e/b.txt", ""), (10_003, "f/COPYING", "MIT License\n\n" + licences.MIT_TEXT)]
    units = {}
    for i, path, text in docs:
        t = re.sub("\r\n?", "\n", text or "")
        noticed = lambda parts: [x for x in parts if re.search(licences.NOTICE, x)]
        blocks = noticed(re.split(licences.BLANK, t))
        found = noticed(t.split("\n")) + blocks + [c for b in blocks for c in noticed(re.split(licences.CLAUSE, b))]
        if re.match(licences.LICENCE_FILE, path.split("/")[-1]) and re.search(licences.NOTICE, t):
            found.append(t)
        units[i] = list(dict.fromkeys(found))
    bag = lambda s: Counter(re.findall(licences.TERM, s.lower()))
    bags, own = {i: [bag(u) for u in us] for i, us in units.items()}, [(name, bag(s)) for name, s in licences.TEMPLATES]
    every = [b for bs in bags.values() for b in bs if b]
    df = Counter(t for b in [*every, *[b for _, b in own]] for t in b)
    n = len(every) + len(own)
    weigh = lambda b: {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, weigh(b)) for name, b in own]
    want = {}
    for i, bs in bags.items():
        scores = []
        for v in map(weigh, (b for b in bs if b)):
            scores += [(-round(sum(w * m.get(t, 0) for t, w in v.items()) / norm(v) / norm(m), 6), name) for name, m in templates]
        best = min((s for s in scores if -s[0] >= licences.THRESHOLD), default=None)
        want[i] = (best[1], -best[0]) if best else (None, None)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()}
    assert sum(v[0] is not None for v in want.values()) > 3
    for i, (name, score) in want.items():
        if got[i].origin == "directory":
            assert name is None and i in (10_001, 10_002) and got[i].licence == "BSD-3-Clause"
        else:
            assert got[i].licence == name and (name is None or abs(got[i].score - score) < 1e-5)


def test_odd_rows_of_licences(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "a/LICENSE", "Released under the MIT License.", None), (2, "a//b", "", "y"), (3, "a/b/c.txt", "x" * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    got = licences.scan(docs).collect()
    assert len(got) == 5 and {r.doc_id: r.licence for r in got} == {None: "MIT", 1: None, 2: "MIT", 3: "MIT"}
    assert licences.scan(docs.filter("false")).count() == 0


def plain_mcd(x, share, starts, seed):
    """Minimum covariance determinant with the same floors: many random starts, exact subsets, steps until nothing changes."""
    rnd, n, floors = np.random.default_rng(seed), len(x), np.diag([quality._floor(i) for i in range(4)])
    h, best = math.ceil(n * share), (np.inf, None, None)
    for _ in range(starts):
        keep = rnd.choice(n, 10, replace=False)
        last = np.inf
        while True:
            m, c = x[keep].mean(0), np.cov(x[keep].T, bias=True) * quality.consistency(share) + floors
            d = np.linalg.slogdet(c)[1]
            if d >= last - 1e-9 and len(keep) == h:
                break
            last = d
            keep = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:h]
        best = min(best, (d, tuple(m), keep.tobytes()))
    return best


def test_estimates_match_a_plain_mcd(spark):
    """Groups with a fifth of outliers in one heap: the determinant is as low as that of a plain search, and the heap is far."""
    rnd, rows, want = np.random.default_rng(4), [], {}
    for g, (n, bad) in enumerate(((300, 60), (90, 15), (40, 0))):
        x = np.concatenate([rnd.normal((5000, 800, 100, 200), (600, 400, 60, 90), (n - bad, 4)), rnd.normal((9000, 4000, 800, 100), (50, 60, 20, 20), (bad, 4))]).round().astype(int)
        rows += [(g * 1000 + i, f"l{g}", "s", *map(int, v)) for i, v in enumerate(x)]
        want[f"l{g}"] = plain_mcd(x.astype(float), quality.SHARE, 60, g)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, x0 long, x1 long, x2 long, x3 long")
    params = quality.robust_parameters(docs)
    got = {r.lang: r for r in params.collect()}
    assert sorted(got) == sorted(want)
    for lang, (det, centre, _) in want.items():
        assert got[lang].logdet <= det + 0.1
        assert np.allclose([got[lang][f"m{i}"] for i in range(4)], centre, atol=150)
    far = {r.doc_id for r in quality._distances(docs, params, 4, quality.LEVELS[0]).filter(f"d2 > {quality.CUTOFF}").collect()}
    assert {d for d in far if d < 2000} >= {*range(240, 300), *range(1075, 1090)}
    assert len(far) < 85


ODD = "doc_id long, text string, lang string, source string, n_chars long, _sha string, reps long, bin int"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(12)
    base = prose(rnd, 200)
    texts = [None, "", " \n", "one", base, base, base.replace(" ", "  "), base + " end", prose(rnd, 9000), *[prose(rnd, 90) for _ in range(12)]]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", 1, "x", 5, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], ODD)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_the_pipeline(spark, odd, name, stage):
    """Columns stay (but in the last stage), nothing is made up, and empty tables give none."""
    out = stage(spark, odd, SMALL)
    assert stage(spark, odd.filter("false"), SMALL).count() == 0
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
        return
    assert out.columns == odd.columns
    given = Counter(map(tuple, odd.collect()))
    got = Counter(map(tuple, rows))
    assert all(given[r] and (n <= given[r] or name == "mixing") for r, n in got.items())
    ids = {r.doc_id for r in rows}
    if name == "quality":
        assert ids == {4, 5, 6, 7, 8, *range(9, 21), None}
    if name == "exact_dedup":
        assert ids == {0, 2, 3, 4, 7, 8, *range(9, 21)} and got[tuple(odd.filter("doc_id = 9").first())] == 1
    if name == "near_dedup":
        assert ids >= {0, 1, 2, 3, 4, 8, *range(9, 21)} and not ids & {5, 6, 7}


def test_pipeline_runs_its_stages_in_turn(spark):
    from cueline.llm import mixing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = near.kept_documents(exact.kept_documents(quality.kept_documents(docs)))
    want = Counter({r.doc_id: r.reps for r in mixing.mix(kept).filter("reps > 0").collect()})
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SMALL).filter("piece = 0").collect())
    assert got == want and len(want) > 50


def test_fresh_names(spark):
    assert fresh(spark.range(1).selectExpr("id AS _sha", "id AS _SHA_"), "_sha") == "_sha__"
