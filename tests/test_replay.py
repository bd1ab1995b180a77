"""Chunks to cues, one case a mode, and the finishing of a track."""

import pytest
from cueline.operators import replay as rp
from pyspark.sql import functions as F

CHUNK = "track string, chunk int, start_ms long, end_ms long, text string, keep_lo long, keep_hi long, superseded boolean"
ITEM = "track string, chunk int, pos int, word string, start_ms long, end_ms long"
TEXT = "ああ。いい。"


@pytest.fixture(scope="module")
def tables(spark):
    chunks = [("t", 1, 10_000, 14_000, TEXT, None, None, None), ("t", 2, 20_000, 24_000, TEXT, 20_000, 22_000, False), ("t", 3, 30_000, 34_000, TEXT, None, None, True), ("t", 4, 40_000, 44_000, None, None, None, False), ("t", 5, 50_000, 54_000, TEXT, None, None, False), ("t", 6, 60_000, 64_000, "これは文脈です", None, None, False)]
    both = lambda k, by: [("t", k, 0, "ああ", by, 400 + by), ("t", k, 1, "いい", 2000 + by, 2400 + by)]
    items = [x for k in (1, 2, 3) for x in both(k, 0)] + [("t", 6, 0, "これは文脈です", 0, 900)]
    raw = both(1, 100) + [("t", 5, 0, "ああいい", 700, 700)]
    speech = [("t", k, *r) for k in (1, 2, 3, 5) for r in ((0, 1000), (3000, 4200))]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(items, ITEM), spark.createDataFrame(raw, ITEM), spark.createDataFrame(speech, "track string, chunk int, start_ms long, end_ms long")


def cues(df):
    return sorted((r.start_ms, r.end_ms, r.text) for r in df.collect())


def test_items_else_raw_items(tables):
    want = [(10_000, 10_500, "ああ。"), (12_000, 12_500, "いい。"), (20_000, 20_500, "ああ。"), (50_700, 51_200, "ああ。"), (50_700, 51_200, "いい。")]
    assert cues(rp.replayed(*tables, context="長い前の文。これは文脈ですよね")) == want


def test_raw_items_first(tables):
    got = cues(rp.replayed(*tables, mode="aligner_only"))
    assert got[:2] == [(10_100, 10_600, "ああ。"), (12_100, 12_600, "いい。")] and (20_000, 20_500, "ああ。") in got


def test_regions(tables):
    got = cues(rp.replayed(*tables, mode="vad_only", most_ms=600))
    assert got == [(10_000, 11_000, "ああ。"), (13_100, 14_200, "いい。"), (20_000, 21_000, "ああ。"), (50_000, 51_000, "ああ。"), (53_100, 54_200, "いい。")]


def test_frames(tables):
    assert cues(rp.replayed(*tables, mode="vad_only", frame_native=True)) == [(10_000, 14_000, TEXT), (20_000, 24_000, TEXT), (50_000, 54_000, TEXT), (60_000, 64_000, "これは文脈です")]


def test_frames_fall_back_to_regions(tables):
    """Raw items of one instant are a fault: that chunk goes by its regions; marks alone cut its cues, the whole text is their source."""
    got = rp.replayed(*tables, frame_native=True, most_ms=600).filter("chunk in (1, 5)").collect()
    assert sorted((r.chunk, r.start_ms, r.end_ms, r.text) for r in got) == [(1, 10_000, 10_500, "ああ。"), (1, 12_000, 12_500, "いい。"), (5, 50_000, 51_000, "ああ。"), (5, 53_100, 54_200, "いい。")]
    assert {(r.source_text, r.source_end_ms - r.source_start_ms) for r in got} == {(TEXT, 4000)}


def test_close_cues_of_a_region(spark, tables):
    """Neighbours join within a region of the chunk; a cue outside all of them stays alone."""
    chunks, items, raw, speech = tables
    one = spark.createDataFrame([("t", 1, 10_000, 13_000)], "track string, chunk int, start_ms long, end_ms long")
    apart = spark.createDataFrame([("t", 1, 10_000, 11_000), ("t", 1, 11_500, 13_000)], "track string, chunk int, start_ms long, end_ms long")
    run = lambda regroup: cues(rp.replayed(chunks.filter("chunk = 1"), items, raw, speech, regroup, usual_ms=1900, least_ms=0))
    assert run(one) == [(10_000, 12_400, TEXT)] == run(None)
    assert run(apart) == [(10_000, 10_400, "ああ。"), (12_000, 12_400, "いい。")]


def test_unknown_mode(tables):
    with pytest.raises(ValueError):
        rp.replayed(*tables, mode="other")


def test_finished_track(spark):
    rows = [(1, 0, 4000, "はい行くぞ"), (2, 4500, 4600, "短"), (3, 5000, 9000, "ねえねえねえねえねえ、来て"), (4, 5020, 9000, "同時"), (5, 30_000, 31_000, "うーん……"), (6, 60_000, 61_000, None), (7, 90_000, 93_000, "終わり"), (8, 92_000, 95_000, "次")]
    df = spark.createDataFrame([("t", *r) for r in rows], "track string, pos int, start_ms long, end_ms long, text string")
    got = rp.finished_track(df).orderBy("pos").collect()
    assert [(r.pos, r.end_ms, r.text) for r in got] == [(1, 4000, "はい行くぞ"), (3, 9000, "ねえねえ、来て"), (6, 61_000, ""), (7, 92_000, "終わり"), (8, 95_000, "次")]
    framed = df.filter("pos < 3").withColumn("source_text", F.lit("はい行くぞ短"))
    assert [(r.end_ms, r.text) for r in rp.finished_track(framed).collect()] == [(4600, "はい行くぞ短")]
