"""Queries on intervals and times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import intervals as iv
from .views import ALT, DOC, EV, cue_alt, cue_doc, cue_ev

ISLANDS = """
isl as (select *, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from cue_ev),
isl2 as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by track order by start_ms, end_ms rows unbounded preceding) island from isl),
merged as (select track, min(start_ms) start_ms, max(end_ms) end_ms from isl2 group by track, island)"""


def tracks(df):
    return df.groupBy("track").agg(F.max("end_ms").alias("duration_ms"))


def times(spark, d):
    """TM-01 to TM-09 over every line of the documents."""
    c = cue_doc(spark, d)
    nxt = F.lead("start_ms").over(Window.partitionBy("track").orderBy("pos"))
    s, e = F.col("start_ms"), F.col("end_ms")
    return c.select("track", "pos", tm.parse_srt_time(tm.srt_time(s)).alias("parsed"), tm.srt_time(s).alias("srt"), tm.ass_time(e).alias("ass"), tm.report_time(s - 1000).alias("report"), tm.clamp(e - s, 1000, 5000).cast("long").alias("clamped"), tm.display_duration(F.length("text")).cast("long").alias("display"), tm.padded_end(s, e, nxt, 300, 1200).cast("long").alias("padded"), tm.token_budget(e - s, 12.0, 32, 64).cast("long").alias("budget"), tm.fraction_label(F.col("pos") % 3, F.col("pos") % 7).alias("share"))


TIMES = f"""with {DOC},
p as (select *, lead(start_ms) over (partition by track order by pos) nxt from cue_doc)
select track, pos, start_ms parsed,
  lpad((start_ms // 3600000)::varchar, greatest(2, length((start_ms // 3600000)::varchar))::int, '0') || ':' || lpad((start_ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::varchar, 2, '0') || ',' || lpad((start_ms % 1000)::varchar, 3, '0') srt,
  (cs // 360000) || ':' || lpad((cs // 6000 % 60)::varchar, 2, '0') || ':' || lpad((cs // 100 % 60)::varchar, 2, '0') || '.' || lpad((cs % 100)::varchar, 2, '0') ass,
  lpad((r // 3600000)::varchar, greatest(2, length((r // 3600000)::varchar))::int, '0') || ':' || lpad((r // 60000 % 60)::varchar, 2, '0') || ':' || lpad((r // 1000 % 60)::varchar, 2, '0') || '.' || lpad((r % 1000)::varchar, 3, '0') report,
  greatest(1000, least(end_ms - start_ms, 5000))::bigint clamped, greatest(800, least(length(text) * 280, 8000))::bigint display,
  greatest(end_ms, coalesce(least(greatest(end_ms + 300, start_ms + 1200), nxt - 40), greatest(end_ms + 300, start_ms + 1200)))::bigint padded,
  least(64, greatest(32, ceil((end_ms - start_ms) / 1000 * 12.0)))::bigint budget,
  case when pos % 7 = 0 then 'n/a' else format('{{:.1f}}%', 100.0 * (pos % 3) / (pos % 7)) end || ' (' || pos % 3 || '/' || pos % 7 || ')' share
from (select *, round_even(end_ms / 10, 0)::bigint cs, greatest(0, start_ms - 1000) r from p)"""


def overlap(spark, d):
    c = cue_ev(spark, d)
    a = c.filter("track <> 'view'").select(F.col("track").alias("name"), F.lit("all").alias("track"), "pos", "start_ms", "end_ms")
    return iv.overlap_ms(a, c.filter("track = 'view'").select(F.lit("all").alias("track"), "start_ms", "end_ms")).drop("track")


OVERLAP = f"""with {EV}, {ISLANDS}
select a.track as name, a.pos, a.start_ms, a.end_ms, coalesce(sum(case when b.track is not null then least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) end), 0)::bigint overlap_ms
from cue_ev a left join merged b on b.track = 'view' and a.start_ms < b.end_ms and b.start_ms < a.end_ms where a.track <> 'view' group by all"""


def rebased(spark, d):
    c = cue_ev(spark, d)
    windows = iv.tiles(tracks(c), 3600_000, 0).select("track", "tile", "start_ms", "end_ms")
    return iv.rebased(windows, iv.merge_intervals(c.select("track", "start_ms", "end_ms")))


REBASED = f"""with {EV}, {ISLANDS}, w as (select track, t tile, t * 3600000 start_ms, least((t + 1) * 3600000, dur) end_ms from
  (select track, dur, unnest(range(0, greatest(0, ceil((dur - 3600000) / 3600000))::bigint + 1)) t from (select track, max(end_ms) dur from cue_ev group by track)))
select w.track, tile, w.start_ms, w.end_ms, coalesce(greatest(w.start_ms, b.start_ms) - w.start_ms, 0) rel_start, coalesce(least(w.end_ms, b.end_ms) - w.start_ms, w.end_ms - w.start_ms) rel_end
from w left join merged b on w.track = b.track and w.start_ms < b.end_ms and b.start_ms < w.end_ms"""


def outside(spark, d):
    c = cue_ev(spark, d).withColumn("all", F.lit(1))
    return iv.outside(c.filter("track = 'click'").select("all", "pos", "start_ms", "end_ms"), c.filter("track = 'error'").select("all", "start_ms", "end_ms"), ["all"]).drop("all")


OUTSIDE = f"with {EV} select pos, start_ms, end_ms from cue_ev a where track = 'click' and not exists (from cue_ev b where b.track = 'error' and a.start_ms < b.end_ms and b.start_ms < a.end_ms)"


def owned(spark, d):
    c = cue_doc(spark, d).select("track", "pos", "start_ms", "end_ms")
    return iv.owned(c, iv.tiles(tracks(c), 30_000, 6_000))


OWNED = f"""with {DOC}, n as (select track, greatest(0, ceil((max(end_ms) - 30000) / 24000))::bigint hi from cue_doc group by track)
select c.track, pos, start_ms, end_ms, least(hi, (start_ms + end_ms) // 2 // 24000) tile from cue_doc c join n using (track)"""


QUERIES = {
    "tm_times": (times, TIMES),
    "w01_merge_intervals": (lambda s, d: iv.merge_intervals(cue_ev(s, d).select("track", "start_ms", "end_ms")), f"with {EV}, {ISLANDS} select * from merged"),
    "w02_gaps": (lambda s, d: iv.gaps(cue_ev(s, d)), f"with {EV}, {ISLANDS} select track, reach start_ms, start_ms end_ms from isl where start_ms > reach"),
    "w03_full_span_gaps": (lambda s, d: iv.full_span_gaps(cue_ev(s, d), tracks(cue_ev(s, d)).withColumn("duration_ms", F.col("duration_ms") + 5000)), f"""with {EV}, {ISLANDS},
t as (select track, max(end_ms) + 5000 dur from cue_ev group by track), m as (select track, start_ms, end_ms from merged union all select track, 0, 0 from t union all select track, dur, dur from t),
g as (select track, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) a, start_ms b from m)
select track, a start_ms, b end_ms from g where b > a"""),
    "w04_clusters": (lambda s, d: iv.clusters(cue_ev(s, d).select("track", "start_ms", "end_ms"), 60000, 2000, 10**12), f"""with {EV},
a as (select *, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from cue_ev),
b as (select *, sum(case when reach is null or start_ms > reach + 60000 then 1 else 0 end) over (partition by track order by start_ms, end_ms rows unbounded preceding) island from a)
select track, greatest(0, min(start_ms) - 2000) start_ms, max(end_ms) + 2000 end_ms from b group by track, island"""),
    "w05_resolve_overlaps": (lambda s, d: iv.resolve_overlaps(cue_ev(s, d)).drop("text"), f"""with {EV}, a as (select *, lead(start_ms) over (partition by track order by start_ms, end_ms, pos) nxt from cue_ev)
select track, pos, start_ms, case when nxt > start_ms and end_ms > nxt then nxt else end_ms end end_ms from a"""),
    "w06_retime": (lambda s, d: cue_alt(s, d).select("track", "pos", "start_ms", tm.padded_end(F.col("start_ms"), F.col("end_ms"), F.lead("start_ms").over(Window.partitionBy("track").orderBy("pos")), 500, 1500).cast("long").alias("end_ms")), f"""with {ALT}, p as (select *, lead(start_ms) over (partition by track order by pos) nxt from cue_alt)
select track, pos, start_ms, greatest(end_ms, coalesce(least(greatest(end_ms + 500, start_ms + 1500), nxt - 40), greatest(end_ms + 500, start_ms + 1500)))::bigint end_ms from p"""),
    "j02_overlap": (overlap, OVERLAP),
    "j03_rebased": (rebased, REBASED),
    "j13_outside": (outside, OUTSIDE),
    "j04_owned": (owned, OWNED),
    "s01_tiles": (lambda s, d: iv.tiles(tracks(cue_doc(s, d)), 30_000, 6_000), f"""with {DOC}, n as (select track, max(end_ms) dur, greatest(0, ceil((max(end_ms) - 30000) / 24000))::bigint hi from cue_doc group by track),
t as (select *, unnest(range(0, hi + 1)) tile from n) select track, tile, tile * 24000 start_ms, least(tile * 24000 + 30000, dur) end_ms, tile * 24000 keep_lo, case when tile < hi then tile * 24000 + 24000 end keep_hi from t"""),
}
