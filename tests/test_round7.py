"""Findings on larger tables: what differed from the SQL, and steps that moved or computed more than they need."""

from datetime import datetime, timedelta

import duckdb
from cueline.operators import folds as fo
from cueline.plans.queries import ORACLES, QUERIES
from cueline.plans.views import cue_ev
from cueline.sources import dumps as du
from cueline.streaming import sessions as st
from pyspark.sql import Window
from pyspark.sql import functions as F


def by_sql(query, folder, *tables):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, con.execute(ORACLES[query]).fetchall()), key=str)


def test_cut_counts_of_a_track_without_cuts(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 2) + timedelta(seconds=s)
    rows = [(1, at(0), 1, "one", 50.0, "{}"), (2, at(90_000), 1, "gap", 50.0, "{}"), (3, at(190_000), 1, "gap", 50.0, "{}"), (4, at(0), 1, "cut", 70.0, "{}"), (5, at(1450), 1, "cut", 70.0, "{}"), (6, at(2930), 1, "cut", 70.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["g08_cut_counts"](spark, str(tmp_path)).collect()), key=str)
    assert got == [("cut", 3, 2, 0, 1), ("gap", 2, 2, None, None), ("one", 1, 1, None, None)]
    assert got == by_sql("g08_cut_counts", tmp_path, "events")


def test_frames_are_cut_without_meeting_again(spark):
    plan = QUERIES["g16_replayed_frames"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == plan.count("windowspecdefinition") <= 2 and "regexp_extract_all" not in plan


def test_events_are_numbered_by_slots(spark, tmp_path):
    at = lambda s: datetime(2023, 12, 30) + timedelta(seconds=s)
    rows = [(k, None if k % 50 == 7 else at(k * 7919 % 400_000), k % 3, ("a", "b", None)[k % 3], float(k % 90), "{}") for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    t = cue_ev(spark, str(tmp_path))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    want = spark.read.parquet(f"{tmp_path}/events.parquet").select("event_type", place, F.unix_millis("ts") - 1704067200000)
    assert sorted(map(tuple, t.select("track", "pos", "start_ms").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    numbers = [line for line in t._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in line and "Window" in line]
    assert numbers and all("_slot" in line.split("windowspecdefinition")[1] for line in numbers)


def test_survivors_share_a_bucket(spark, tmp_path):
    rows = [(k % 3 or None, ("x", "y", None)[k * 7 % 5 % 3], k, k * 1000 - k % 4, k * 1000 + 500) for k in range(60)]
    kind, folder = "track long, text string, pos int, start_ms long, end_ms long", f"{tmp_path}/in"
    for k in (0, 30):  # two files, read one a batch, so that numbers are kept from one to the next
        spark.createDataFrame(rows[k : k + 30], kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    until, want = {}, []
    for track, text, pos, start, end in sorted(rows, key=lambda r: r[3]):
        if (track, text) not in until or start - until[track, text] > 7000:
            until[track, text] = end
            want.append((track, pos, start, end, text))
    got = st.drained(st.surviving_cues(stream, 7000, "long", buckets=2), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) < 60
    names = got.columns
    assert names == ["track", "pos", "start_ms", "end_ms", "text"] and dict(got.dtypes)["track"] == "bigint"


def test_survivors_ask_fewer_groups_than_texts(spark):
    """Grouping by bucket: the number of calls does not grow with the texts."""
    rows = spark.readStream.format("rate").load().selectExpr("value as track", "cast(value as string) as text", "1 as pos", "value as start_ms", "value as end_ms")
    plan = st.surviving_cues(rows, 1, "long")._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(track" in plan and "bucket" in plan


def test_short_tracks_are_not_cut(spark):
    kind = "track string, pos int, start_ms long, end_ms long, text string, region_ms long"
    day = 86_400_000
    short = [("t", k, k * 1000, k * 1000 + 900, "abc"[k % 3] * 2, 0) for k in range(9)] + [(None, 1, 5, 6, "x", 0), (None, 2, 7, 8, " x", 0), (None, 3, 9, 10, None, 0)]
    long = [("u", k, k * day // 2, k * day // 2 + 500, "z", 0) for k in range(5)]
    for rows, cut in ((short, False), (short + long, True)):
        t = spark.createDataFrame(rows, kind)
        kept, merged = fo.windowed_dedup(t, 2500), fo.merge_close_in_regions(t, 200, 80, 12_000)
        for q in (kept, merged):
            assert ("_slot" in q._jdf.queryExecution().optimizedPlan().toString()) == cut
        got = sorted(((r.track, r.pos) for r in kept.collect()), key=str)
        assert got == sorted([("t", 0), ("t", 1), ("t", 2), ("t", 6), ("t", 7), ("t", 8), (None, 1)] + ([("u", k) for k in range(5)] if cut else []), key=str)
        assert sorted((r.track, r.pos) for r in merged.collect() if r.track) == ([("t", 0), ("u", 0), ("u", 1), ("u", 2), ("u", 3), ("u", 4)] if cut else [("t", 0)])


def test_regions_are_read_once(spark):
    chunks = '{"chunks": [{"start": 1.5, "speech_regions": [[0, 1], [2], ["x", 3], 7, [1.0, "2.5"], [4, 3], null]}, {"start": "?", "speech_regions": [[0.25, 0.5]]}, {"speech_regions": {"a": 1}}, 5, [1], {"start": 9}]}'
    t = du.speech_regions(spark.createDataFrame([("f", chunks), ("g", "[1]"), ("h", "{"), ("i", None)], "file string, text string"))
    assert sorted(map(tuple, t.collect())) == [("f", 250, 500), ("f", 1500, 4000)]
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "try_cast(get(from_json" not in plan


def test_phrases_are_counted_once(spark):
    plan = QUERIES["a07_without_phrases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan and "percentile" not in plan and plan.count("documents.parquet") + plan.count("posexplode") <= 2
