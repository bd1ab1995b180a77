import random

from cueline.functions import times as tm
from cueline.operators import intervals as iv
from cueline.operators import tracks as tr
from pyspark.sql import functions as F

SCHEMA = "track string, pos int, start_ms long, end_ms long"


def cues(spark, rows):
    return spark.createDataFrame([("t", i, a, b) for i, (a, b) in enumerate(rows)], SCHEMA)


def test_touching_intervals_merge(spark):
    got = iv.merge_intervals(cues(spark, [(0, 10), (10, 20), (25, 30)])).collect()
    assert sorted((r.start_ms, r.end_ms) for r in got) == [(0, 20), (25, 30)]


def test_union_overlap_and_range_join_match_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [(s, s + rnd.randrange(1, 50)) for s in (rnd.randrange(0, 1000) for _ in range(60))]
    df = cues(spark, rows)
    covered = {x for a, b in rows for x in range(a, b)}
    assert sum(r.end_ms - r.start_ms for r in iv.merge_intervals(df).collect()) == len(covered)
    pairs = iv.range_join(df, df.select("track", "start_ms", "end_ms"), width=30).count()
    assert pairs == sum(a < d and c < b for a, b in rows for c, d in rows)


def test_full_span_gaps_of_an_empty_track(spark):
    tracks = spark.createDataFrame([("t", 10), ("u", 7)], "track string, duration_ms long")
    got = iv.full_span_gaps(cues(spark, [(2, 4)]), tracks).collect()
    assert sorted((r.track, r.start_ms, r.end_ms) for r in got) == [("t", 0, 2), ("t", 4, 10), ("u", 0, 7)]


def test_long_tracks_are_dealt_by_time(spark):
    """Slots of time of any width give the same islands, also where rows repeat and a slot is empty."""
    rnd = random.Random(5)
    rows = [(s, s + rnd.randrange(0, 40)) for s in (rnd.randrange(0, 2000) for _ in range(80))]
    df = cues(spark, rows + rows[:5])
    want = {(r.start_ms, r.end_ms, r.reach) for r in iv.running_max(df, F.col("end_ms"), "reach").collect()}
    assert {(r.start_ms, r.end_ms, r.reach) for r in iv.running_max(df, F.col("end_ms"), "reach", width=37).collect()} == want


def test_sign_test_and_times(spark):
    row = spark.range(1).select(tr.sign_test(F.lit(20).cast("long"), F.lit(5).cast("long")).alias("p"), tm.srt_time(F.lit(3723004)).alias("s"), tm.ass_time(F.lit(25)).alias("a"), tm.parse_srt_time(F.lit("01:02:03,004")).alias("x")).first()
    assert abs(row.p - 0.0041) < 1e-4 and row.s == "01:02:03,004" and row.a == "0:00:00.02" and row.x == 3723004
