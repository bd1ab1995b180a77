"""Rows that repeat, nulls in any column, blanks of any kind, tracks that only one run has; expectations follow from the rules."""

import random
from functools import cache

import pytest
from cueline.functions import text as tx
from cueline.functions.normal import plain, ratio
from cueline.operators import checks as ck
from cueline.operators import folds as fo
from cueline.operators import intervals as iv
from cueline.operators import pairs as pr
from cueline.operators import signals as sg
from pyspark.sql import functions as F

CUE = "track string, pos int, start_ms long, end_ms long, text string"


@pytest.fixture(scope="module")
def spans(spark):
    rows = [("t", 0, 100, "x"), ("t", 0, 100, "x"), ("t", 0, 100, None), (None, 0, 100, "x"), ("t", None, 100, "x"), ("t", 500, None, "x"), ("t", 200, 300, None), ("u", 0, 100, None)]
    return spark.createDataFrame(rows, "track string, start_ms long, end_ms long, note string")


@pytest.fixture(scope="module")
def speech(spark):
    rows = [("t", 0, 50, None), ("t", 0, 50, None), ("t", 40, 60, "y"), (None, 90, 95, "y"), ("t", None, 10, "y")]
    return spark.createDataFrame(rows, "track string, start_ms long, end_ms long, note string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overlap_of_repeated_rows_and_null_columns(spans, speech):
    want = [("t", 0, 100, "x", 60), ("t", 0, 100, "x", 60), ("t", 0, 100, None, 60), (None, 0, 100, "x", 5), ("t", None, 100, "x", 0), ("t", 500, None, "x", 0), ("t", 200, 300, None, 0), ("u", 0, 100, None, 0)]
    assert rows_of(iv.overlap_ms(spans, speech.filter("start_ms is not null"))) == sorted(want, key=str)


def test_rebased_repeated_windows(spans, speech):
    got = rows_of(iv.rebased(spans.filter("end_ms = 100 and start_ms = 0"), speech))
    each = [("t", 0, 100, n, a, b) for n in ("x", "x", None) for a, b in ((0, 50), (0, 50), (40, 60))]
    assert got == sorted([*each, (None, 0, 100, "x", 90, 95), ("u", 0, 100, None, 0, 100)], key=str)


def test_outside_keeps_rows_as_they_are(spans, speech):
    want = [("t", None, 100, "x"), ("t", 500, None, "x"), ("t", 200, 300, None), ("u", 0, 100, None)]
    assert rows_of(iv.outside(spans, speech)) == sorted(want, key=str)
    assert rows_of(iv.outside(spans.union(spans), speech)) == sorted(want * 2, key=str)
    held = rows_of(iv.range_join(spans, speech, how="left_semi"))
    assert held == sorted([("t", 0, 100, "x"), ("t", 0, 100, "x"), ("t", 0, 100, None), (None, 0, 100, "x")], key=str)


@pytest.mark.parametrize("values, want", [([1, 0, 0, 0, 0], [0.6, 0.4, 0.2, 0.0, 0.0]), ([0, 0, 1], [0.2, 0.4, 0.6]), ([1, 0], [1.0, 0.0]), ([5.0], [5.0])])
def test_smoothing_repeats_the_ends(spark, values, want):
    """A mean of five with the series continued by its first and last value; fewer than three frames stay."""
    df = spark.createDataFrame([("t", k, float(v)) for k, v in enumerate(values)], "track string, frame int, v double")
    assert [round(r.smooth, 9) for r in sg.smoothed(df, "v").orderBy("frame").collect()] == want


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaner(spark):
    given = ["　はい　", "　", "‥‥行く", "行く‥…‥ね", "...そう", "…！", "あ…", "？」", "♪ら～", "…　‥はい!", "", None, "\x0b待って\x85"]
    assert one(spark, given, tx.asr_clean) == ["はい。", "", "行く。", "行く…ね。", "...そう。", "", "あ…", "？」。", "♪ら～", "はい!", "", None, "待って。"]


def test_ideographic_blanks(spark):
    assert one(spark, ["ああ　んっ", "　うっ　", "ふ\xa0ふ"], tx.voiced) == ["啊啊　嗯", "呜", "呼\xa0呼"]
    df = spark.createDataFrame([(1, "a", "　"), (2, "a", " \xa0"), (3, "a", "b")], "i int, source_text string, text string")
    assert {r.i: r.issues for r in ck.reviewed(df).collect()} == {1: "empty", 2: "empty", 3: ""}
    assert one(spark, ["　[1] a　\n　", "[1] 　"], lambda x: ck.numbered_lines(x, F.lit(1))) == [["a"], None]


def test_null_texts_are_empty(spark):
    cues = [("t", 1, 0, 500, None), ("t", 2, 520, 900, "ab"), ("t", 3, 910, 1000, None), ("t", 4, 1100, 2000, "ab")]
    df = spark.createDataFrame(cues, CUE)
    assert [(r.pos, r.end_ms, r.text) for r in fo.merge_short(df, 3, 200, 20).collect()] == [(1, 2000, "abab")]
    assert [(r.pos, r.text) for r in fo.merge_close(df, 150, 20, 9000).orderBy("pos").collect()] == [(1, "ab"), (4, "ab")]
    assert {r.pos for r in fo.squeezed_duplicates(df, 500, 0.9, 600).collect()} <= {1, 2, 3, 4}
    piled = df.withColumns({"collapsed": F.lit(False), "source_text": F.lit("s"), "start_ms": F.lit(0)})
    assert [r.text for r in fo.same_start_piles(piled).collect()] == ["abab"]
    assert [r.text for r in fo.settle_short(df.withColumn("source_text", F.lit("s")), 600).collect()] == ["ab", "ab"]
    assert {r.status for r in pr.cue_groups(df, df).collect()} >= {"matched"}
    assert pr.comparison(df, df).collect()[0].raw_substitutions == 0


def test_tracks_of_one_run(spark):
    ref = spark.createDataFrame([("a", 1, 0, 9, "x y"), ("b", 1, 0, 9, "hello"), ("b", 2, 10, 19, "there"), (None, 1, 0, 9, "none")], CUE)
    other = spark.createDataFrame([("a", 1, 0, 9, "x y"), ("c", 1, 0, 9, "only here"), (None, 1, 0, 9, "none")], CUE)
    groups = sorted((str(r.track), r.n, r.status) for r in pr.cue_groups(ref, other).collect())
    assert groups == [("None", 0, "matched"), ("a", 0, "matched"), ("b", 0, "missing_reference_text"), ("b", 1, "missing_reference_text"), ("c", 0, "extra_candidate_text")]
    got = {str(r.track): r for r in pr.comparison(ref, other).collect()}
    assert {k: (r.status, r.matched, r.reference_cues, r.candidate_cues) for k, r in got.items()} == {"a": ("evaluated", 1, 1, 1), "b": ("evaluated", 0, 2, 0), "c": ("unavailable", None, 0, 1), "None": ("evaluated", 1, 1, 1)}
    assert (got["b"].raw_deletions, got["b"].raw_insertions, got["c"].raw_deletions) == (10, 0, None)


def test_inputs_that_are_not_valid(spark):
    ref = spark.createDataFrame([(k, 1, 0, 9, "x") for k in "abc"], CUE)
    inputs = spark.createDataFrame([("a", "valid", "empty"), ("b", "partial_invalid", "valid"), ("d", "missing", "valid")], "track string, reference_status string, candidate_status string")
    assert {r.track: r.status for r in pr.comparison(ref, ref.filter("track <> 'a'"), inputs=inputs).collect()} == {"a": "evaluated", "b": "unavailable", "c": "unavailable", "d": "unavailable"}


def test_budget_is_checked_before_texts_are_joined(spark):
    long = spark.createDataFrame([("t", k, k, k + 1, "x" * 90) for k in range(100)], CUE)
    r = pr.comparison(long, long).collect()[0]
    assert (r.status, r.reference_chars, r.matched, r.rate) == ("unavailable", 9000, None, None)


def cheapest(reference, candidate):
    """Least cost of all monotone alignments, by trying every step."""
    size = lambda t: max(1, len(plain(t)))

    @cache
    def rest(i, p):
        ways = [0.0] if (i, p) == (len(reference), len(candidate)) else []
        ways += [size(reference[i]) + rest(i + 1, p)] if i < len(reference) else []
        ways += [size(candidate[p]) + rest(i, p + 1)] if p < len(candidate) else []
        for a in range(1, 4):
            for b in range(1, 4):
                if i + a <= len(reference) and p + b <= len(candidate):
                    x, y = plain("".join(reference[i : i + a])), plain("".join(candidate[p : p + b]))
                    if x and y and ratio(x, y) >= 0.5:
                        ways.append((1 - ratio(x, y)) * (len(x) + len(y)) + 0.05 * (a + b - 2) + rest(i + a, p + b))
        return min(ways)

    return rest(0, 0)


def cost_of(groups, reference, candidate):
    total = 0.0
    for i, k, p, q in groups:
        x, y = plain("".join(reference[i:k])), plain("".join(candidate[p:q]))
        total += (1 - ratio(x, y)) * (len(x) + len(y)) + 0.05 * (k - i + q - p - 2) if k > i and q > p else max(1, len(x or y))
    return total


def test_alignment_is_the_cheapest():
    rnd = random.Random(4)
    for _ in range(60):
        a = ["".join(rnd.choice("abc 。") for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(7))]
        b = [t if rnd.random() < 0.6 else t[::-1] for t in a if rnd.random() < 0.8] + [""] * rnd.randrange(2)
        groups = pr.aligned_groups(a, b)
        assert abs(cost_of(groups, a, b) - cheapest(tuple(a), tuple(b))) < 1e-6
        assert [x for g in groups for x in range(*g[:2])] == list(range(len(a))) and [x for g in groups for x in range(*g[2:])] == list(range(len(b)))


@pytest.mark.parametrize("a, b, want", [(["ab", "cd"], ["abcd"], [(0, 2, 0, 1)]), (["abcd"], ["ab", "cd"], [(0, 1, 0, 2)]), (["x"], ["q"], [(0, 0, 0, 1), (0, 1, 1, 1)]), ([], [], []), (["aa", "aa"], ["aa"], [(0, 1, 0, 0), (1, 2, 0, 1)])])
def test_alignments(a, b, want):
    assert pr.aligned_groups(a, b) == want
