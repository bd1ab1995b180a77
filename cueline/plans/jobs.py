"""Queries on jobs of speech groups and on scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import intervals as iv
from ..operators import jobs as jb
from ..operators import signals as sg
from .folds import steps
from .reports import union_sql
from .views import ALT, EV, cue_alt, cue_doc, cue_ev, signal_ev, table

MERGE, TARGET, AFTER, LONGEST, SHORT = 600_000, 1_200_000, 60_000, 3_600_000, 5_000


def groups(spark, d):
    """Covered time of each kind of event as speech groups."""
    return iv.merge_intervals(cue_ev(spark, d).select("track", "start_ms", "end_ms")).withColumn("pos", F.lit(0))


def packed(spark, d):
    return jb.context_jobs(groups(spark, d), MERGE, TARGET, AFTER, LONGEST, SHORT)


_gap = "n.start_ms - f.end_ms"
_near = f"{_gap} <= case when f.end_ms - f.job < {TARGET} then {MERGE} else {AFTER} end"
_same = f"({_near} and n.end_ms - f.job <= {LONGEST})"
JOBS = f"with recursive {EV}, {union_sql('merged', 'cue_ev')}, " + steps(f"(select *, 0 pos from merged where end_ms - start_ms >= {SHORT})", {
    "start_ms": ("n.start_ms", "n.start_ms"), "end_ms": ("n.end_ms", "n.end_ms"), "job": ("n.start_ms", f"case when {_same} then f.job else n.start_ms end"),
    "cut": ("null::varchar", f"case when {_same} then f.cut when {_near} then 'hard_cut' when {_gap} <= {MERGE} then 'soft_break' end"),
}, "n.rn > 1") + ", j as (select track, job start_ms, max(end_ms) end_ms, count(*) frames, any_value(cut) cut from f group by track, job)"


def chunks(spark, d):
    """Tiles of half a minute as jobs; some have failed."""
    c = cue_doc(spark, d)
    t = iv.tiles(c.groupBy("track").agg(F.max("end_ms").alias("duration_ms")), 30_000, 6_000).withColumnRenamed("tile", "job")
    return t.withColumn("status", F.when((F.col("track") + F.col("job")) % 3 == 0, F.lit("COLLAPSED")).otherwise(F.lit("OK")))


def own_cues(spark, d):
    c = cue_doc(spark, d)
    return iv.owned(c, chunks(spark, d).withColumnRenamed("job", "tile").drop("status")).withColumnRenamed("tile", "job").select("track", "job", "pos", "start_ms", "end_ms", "text")


def finer(spark, d):
    """What a failed job holds, in stretches without a pause of a second, from its start."""
    c = own_cues(spark, d).join(chunks(spark, d).filter("status = 'COLLAPSED'").select("track", "job", F.col("start_ms").alias("at")), ["track", "job"])
    return iv.merge_intervals(c.select("track", "job", (F.col("start_ms") - F.col("at")).alias("start_ms"), (F.col("end_ms") - F.col("at")).alias("end_ms")), ["track", "job"], 1000)


def stepped(spark, d):
    return jb.stepped_down(chunks(spark, d), finer(spark, d), 1500)


def replaced(spark, d):
    """The other run's cues in place of those of failed jobs."""
    new = stepped(spark, d).filter("part is not null")
    found = iv.range_join(cue_alt(spark, d), new)
    found = found.select("track", F.col("b_job").alias("job"), "pos", "start_ms", "end_ms", "text", F.col("b_keep_lo").alias("keep_lo"), F.col("b_keep_hi").alias("keep_hi"))
    return jb.superseded(own_cues(spark, d), chunks(spark, d), found)


STEPPED = f"""{ALT}, dur as (select track, max(end_ms) dur, greatest(0, ceil((max(end_ms) - 30000) / 24000))::bigint hi from cue_doc group by track),
ch as (select track, unnest(range(0, hi + 1)) job, dur, hi from dur),
jobs as (select track, job, job * 24000 start_ms, least(job * 24000 + 30000, dur) end_ms, job * 24000 keep_lo, case when job < hi then job * 24000 + 24000 end keep_hi, (track + job) % 3 = 0 failed from ch),
own as (select c.*, least(hi, (start_ms + end_ms) // 2 // 24000) job from cue_doc c join dur using (track)),
ga as (select o.track, o.job, o.start_ms - j.start_ms s, o.end_ms - j.start_ms e from own o join jobs j using (track, job) where failed),
gb as (select *, max(e) over (partition by track, job order by s, e rows between unbounded preceding and 1 preceding) reach from ga),
gc as (select *, sum(case when reach is null or s > reach + 1000 then 1 else 0 end) over (partition by track, job order by s, e rows unbounded preceding) island from gb),
gd as (select track, job, min(s) s, max(e) e from gc group by track, job, island having max(e) - min(s) >= 1500),
ge as (select *, row_number() over w part, lead(s) over w nxt from gd window w as (partition by track, job order by s)),
finer as (select track, job, part - 1 part, j.start_ms + s start_ms, j.start_ms + e end_ms, case when part = 1 then keep_lo else j.start_ms + s end keep_lo, case when nxt is null then keep_hi else j.start_ms + e end keep_hi from ge join jobs j using (track, job) where j.end_ms - j.start_ms >= 1500),
stepped as (select track, job, null::int part, start_ms, end_ms, keep_lo, keep_hi from jobs where not failed union all select track, job, part::int, start_ms, end_ms, keep_lo, keep_hi from finer)"""
REPLACED = f"""with {STEPPED}
select track, job, pos, start_ms, end_ms, text from own semi join (select track, job from jobs where not failed) using (track, job)
union all select a.track, f.job, a.pos, a.start_ms, a.end_ms, a.text from cue_alt a join finer f on f.track = a.track and a.start_ms < f.end_ms and f.start_ms < a.end_ms and a.start_ms + a.end_ms >= 2 * f.keep_lo and (f.keep_hi is null or a.start_ms + a.end_ms < 2 * f.keep_hi)"""


def scene_segments(spark, d):
    """Speech groups of overlapping scenes of two hours, each grouped on its own."""
    c = cue_ev(spark, d)
    tiles = iv.tiles(c.groupBy("track").agg(F.max("end_ms").alias("duration_ms")), 7_200_000, 900_000)
    t = iv.range_join(tiles.select("track", F.col("tile").alias("scene"), "start_ms", "end_ms"), groups(spark, d))
    t = t.select("track", "scene", F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"), F.lit(0).alias("pos"))
    t = t.withColumn("end_reason", F.when(F.col("end_ms") % 3 == 0, F.lit("forced_max_speech")).otherwise(F.lit("silence")))
    t = fo.capped_groups(t, 60_000, 1_800_000, ["track", "scene"]).withColumnRenamed("group_ms", "group").drop("pos")
    return t.withColumns({"left_reason": F.coalesce("reason", F.lit("scene_start")), "right_reason": F.concat(F.lit("scene_"), F.col("scene").cast("string"))}).drop("reason")


def vectors(spark, d):
    """Vectors as frames of four tracks."""
    t = table(spark, d, "embeddings")
    return t.select((F.col("vec_id") % 4).alias("track"), F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("label") % 3).alias("label"), F.abs(F.element_at("embedding", 1)).cast("double").alias("energy"), F.col("embedding").cast("array<double>").alias("vector"))


def merged_scenes(spark, d):
    t = vectors(spark, d)
    return sg.merged_scenes(sg.scene_means(t, sg.scenes(t, 3)), 6, 30)


QUERIES = {
    "g08_context_jobs": (lambda s, d: packed(s, d).select("track", "start_ms", "end_ms", "keep_hi", "frames", F.size("regions").alias("regions"), "cut"), JOBS + " select track, start_ms, end_ms, case when lead(start_ms) over (partition by track order by start_ms) is not null then end_ms end keep_hi, frames, case when frames > 1 then frames else 0 end::int regions, cut from j"),
    "g08_cut_counts": (lambda s, d: jb.cut_counts(packed(s, d)), JOBS + " select track, sum(frames)::bigint frames, count(*) jobs, count_if(cut = 'hard_cut') hard_cuts, count_if(cut = 'soft_break') soft_breaks from j group by track"),
    "g12_merged_scenes": (merged_scenes, None),
    "g13_reconciled": (lambda s, d: jb.reconciled(scene_segments(s, d), 60_000, 1_800_000), None),
    "g17_stepped_down": (stepped, f"with {STEPPED} select * from stepped"),
    "g17_superseded": (replaced, REPLACED),
    "w18_valley_segments": (lambda s, d: sg.valley_segments(signal_ev(s, d), 5, 8, 2, 0.2, 2, 2, 1), None),
}
