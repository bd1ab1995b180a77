import difflib
import random

import pytest
from cueline.functions import normal as nm
from cueline.operators import folds as fo
from cueline.operators import pairs as pr
from cueline.operators import samples as sa
from pyspark.sql import functions as F

CUE = "track string, pos int, start_ms long, end_ms long, text string"
FULL = CUE + ", collapsed boolean, source_text string"


def rows_of(seed, n=150):
    rnd, out = random.Random(seed), []
    for t in "ab":
        at = 0
        for i in range(n):
            at += rnd.choice((0, 20, 200, 900, 1600, 9000))
            text = rnd.choice(("ha", "hello there", "hello theres", "go on", "x" * 30, " ", "hello, there you are"))
            out.append((t, i, at, at + rnd.choice((0, 300, 700, 2500)), text, rnd.random() < 0.4, rnd.choice((None, "s1", "s2"))))
    return out


def by_track(rows):
    for t in "ab":
        yield sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[3], r[1]))


@pytest.fixture(scope="module")
def small_batches(spark):
    """Tracks are longer than an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "16")
    yield
    spark.conf.set(name, was)


def got(df, *more):
    return sorted((r.track, r.pos, r.start_ms, r.end_ms, r.text, *[r[m] for m in more]) for r in df.collect())


def test_close_cues(spark, small_batches):
    rows, want = rows_of(1), []
    for track in by_track(rows):
        out = []
        for t, p, s, e, x, _, _ in track:
            if out:
                q = out[-1]
                a, b = fo.timed(q[4]), fo.timed(x)
                lo, hi = sorted((len(a), len(b)))
                twin = b and lo >= 0.6 * hi and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8
                if 0 <= s - q[3] < 1500 and len(a) + len(b) <= 30 and e - q[2] <= 8000 and not twin:
                    out[-1] = (*q[:3], e, q[4].rstrip() + x.lstrip())
                    continue
            out.append((t, p, s, e, x))
        want += out
    assert got(fo.merge_close(spark.createDataFrame([r[:5] for r in rows], CUE), 1500, 30, 8000)) == sorted(want)


def test_squeezed_duplicates(spark, small_batches):
    rows, want = rows_of(2), []
    for track in by_track(rows):
        out = []
        for t, p, s, e, x, _, _ in track:
            if out and s - out[-1][3] <= 1000 and difflib.SequenceMatcher(None, fo.squeezed(out[-1][4]), fo.squeezed(x)).ratio() >= 0.7 and min(out[-1][3] - out[-1][2], e - s) < 500:
                if e - s >= out[-1][3] - out[-1][2]:
                    out[-1] = (t, p, s, e, x)
                continue
            out.append((t, p, s, e, x))
        want += out
    assert got(fo.squeezed_duplicates(spark.createDataFrame([r[:5] for r in rows], CUE), 1000, 0.7, 500)) == sorted(want)


def test_short_cues_join_their_source(spark, small_batches):
    rows, want = rows_of(3), []
    for track in by_track(rows):
        cues, out = [list(r) for r in track], []
        for i, c in enumerate(cues):
            if c[3] - c[2] >= 500:
                out.append(c)
            elif c[6] is None:
                continue
            elif out and out[-1][6] == c[6]:
                out[-1][4] += c[4]
                out[-1][3] = max(out[-1][3], c[3])
            elif i + 1 < len(cues) and cues[i + 1][6] == c[6]:
                cues[i + 1][4] = c[4] + cues[i + 1][4]
                cues[i + 1][2] = min(c[2], cues[i + 1][2])
            else:
                out.append(c)
        want += [tuple(c[:5]) for c in out]
    assert got(fo.settle_short(spark.createDataFrame(rows, FULL), 500)) == sorted(want)


def test_piles_prefer_real_spans_and_join_one_source(spark):
    rows = [("t", 1, 0, 0, "a", True, None), ("t", 2, 30, 900, "b", False, None), ("t", 3, 60, 70, "c", False, None), ("t", 4, 500, 500, "d", True, "s"), ("t", 5, 540, 700, "e", False, "s"), ("t", 6, 551, 900, "f", False, None)]
    r = fo.same_start_piles(spark.createDataFrame(rows, FULL)).orderBy("start_ms").collect()
    assert [(x.text, x.start_ms, x.end_ms, x.collapsed) for x in r] == [("b", 30, 900, False), ("de", 500, 700, False), ("f", 551, 900, False)]


def test_windowed_dedup_compares_with_survivors(spark):
    df = spark.createDataFrame([("t", i, s, s, "A") for i, s in enumerate((0, 7, 14))] + [("t", 9, 3, 4, " ")], CUE)
    assert sorted(r.start_ms for r in fo.windowed_dedup(df, 8).collect()) == [0, 14]


def test_regions_bound_the_merging(spark):
    rows = [("t", 1, 0, 400, "a", 0), ("t", 2, 500, 900, "b", 0), ("t", 3, 1000, 1300, "c", None), ("t", 4, 1400, 1800, "d", 7), ("t", 5, 1900, 2000, "e", 7)]
    r = fo.merge_close_in_regions(spark.createDataFrame(rows, CUE + ", region_ms long"), 1500, 80, 8000).orderBy("start_ms").collect()
    assert [x.text for x in r] == ["ab", "c", "de"]


def plain_edits(r, c):
    prev = [(j, j, 0) for j in range(len(c) + 1)]
    for i, x in enumerate(r, 1):
        cur = [(i, i, i)]
        for j, y in enumerate(c, 1):
            (p, d, n) = prev[j - 1], prev[j], cur[j - 1]
            cur.append(p if x == y else min((p[0] + 1, p[1], p[2]), (d[0] + 1, d[1] + 1, d[2] + 1), (n[0] + 1, n[1] + 1, n[2])))
        prev = cur
    e, b, d = prev[-1]
    return e - b, b - d, d


def test_texts_functions():
    rnd = random.Random(1)
    word = lambda k, n: "".join(rnd.choice(k) for _ in range(rnd.randrange(0, n)))
    for _ in range(500):
        a, b = word("abc", 14), word("abc", 14)
        assert nm.edit_counts(a, b) == plain_edits(a, b)
        assert nm.longest_common(a, b) == max([0] + [j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b])
    assert nm.folded_repeats("aaaab" * 6) == "aaaabaaaab" and nm.folded_repeats("go" * 7) == "gogo" and nm.folded_repeats("go go go") == "go go go"
    assert nm.plain("がー、 A.") == "がーA" and nm.core("「ｱｰっ…」") == "ア"


def test_groups_of_two_runs(spark):
    assert pr.aligned_groups(["hello there", "you"], ["hello there you"]) == [(0, 2, 0, 1)]
    assert pr.aligned_groups(["abc", "zzzz", "defg"], ["abc", "defg"]) == [(0, 1, 0, 1), (1, 2, 1, 1), (2, 3, 1, 2)]
    a = spark.createDataFrame([("t", 1, 0, 1000, "hello, there"), ("t", 2, 1500, 2000, "you"), ("u", 1, 0, 5, "x" * 9000)], CUE)
    b = spark.createDataFrame([("t", 1, 200, 2100, "hello there you"), ("t", 2, 9000, 9100, "more words")], CUE)
    r = {x.track: x for x in pr.comparison(a, b).collect()}
    assert (r["t"].status, r["t"].matched, r["t"].exact, r["t"].start_mean, r["t"].end_mean) == ("evaluated", 1, 1, 200.0, 100.0)
    assert r["t"].plain_insertions == 9 and r["t"].true_rate is None and r["u"].status == "unavailable" and r["u"].rate is None
    c = spark.createDataFrame([("t", i, i, i + 1, "x") for i in range(pr.CUES + 1)], CUE)
    assert pr.cue_groups(c, b).count() == 0


def test_differing_windows(spark):
    a = spark.createDataFrame([("t", 1, 0, 5, "same words here"), ("t", 2, 21_000, 5, "this is one thing"), ("t", 3, 41_000, 5, "ab")], CUE)
    b = spark.createDataFrame([("t", 1, 0, 5, "same words here"), ("t", 2, 22_000, 5, "quite another"), ("t", 3, 61_000, 5, "only one side")], CUE)
    assert sorted(r.window for r in pr.differing_windows(a, b, 20_000, 8, 0.6).collect()) == [1, 3]


def test_samples_keep_their_distance(spark):
    df = spark.createDataFrame([(t, w) for t in "abc" for w in range(0, 30) if w % 7], "track string, window long")
    r = sa.spaced_sample(df, 20, 3).collect()
    assert r == sa.spaced_sample(df.repartition(5), 20, 3).collect() and len(r) == 20
    assert max(x.turn for x in r) == 7 and not any((x.track, x.window + 1) in {(y.track, y.window) for y in r} for x in r)
    w = spark.createDataFrame([("t", "dev", i * 300, i * 300 + 250) for i in range(40)], "track string, split string, start_ms long, end_ms long")
    k = sorted((x.start_ms, x.end_ms) for x in sa.separated(w, 500, 5, ("start_ms",)).collect())
    assert len(k) == 5 and all(b[0] - a[1] >= 500 for a, b in zip(k, k[1:]))


def test_glossaries_of_any_size(spark, monkeypatch):
    from cueline.operators import tracks as tr

    terms = spark.createDataFrame([("the", "A"), ("then", "B"), ("a", "C"), ("of", "D")], "source string, target string")
    cues = spark.createDataFrame([(1, "then a man"), (2, "of"), (3, ""), (4, "the")], "id int, text string")
    small = {tuple(r) for r in tr.matched_terms(cues, terms, ["id"]).collect()}
    monkeypatch.setattr(tr, "SMALL_GLOSSARY", 0)
    assert {tuple(r) for r in tr.matched_terms(cues, terms, ["id"]).collect()} == small == {(1, "then", "B"), (1, "a", "C"), (2, "of", "D"), (4, "the", "A")}


def test_edit_counts_of_tracks(spark):
    from cueline.operators import tracks as tr

    a = spark.createDataFrame([("t", 1, "kitten"), ("t", 2, "abc"), ("u", 1, "")], "track string, pos int, text string")
    b = spark.createDataFrame([("t", 1, "sitting"), ("t", 2, "ab"), ("t", 3, "new"), ("u", 1, "x")], "track string, pos int, text string")
    r = {x.track: x for x in tr.edit_rate(a, b).collect()}
    assert (r["t"].edits, r["t"].substitutions, r["t"].insertions, r["t"].deletions, r["t"].chars) == (7, 2, 4, 1, 9)
    assert r["u"].rate is None and r["u"].insertions == 1
    assert tr.edit_rate(a, b, cells=10).filter("track = 't'").first().unsplit == 1


def test_echoes(spark):
    df = spark.createDataFrame([("please go home now", "he said please go home now or else"), ("short", "short"), (None, "x")], "t string, c string")
    assert [r.e for r in df.select(nm.echoes(F.col("t"), F.col("c")).alias("e")).collect()] == [True, False, False]
