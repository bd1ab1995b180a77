"""Queries on measures of tracks: summaries, speech coverage, suspicious gaps, repeats, alignment health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import EDGE
from ..operators import intervals as iv
from ..operators import reports as rp
from .views import ALT, DOC, EV, TURNS, cue_alt, cue_doc, cue_ev, table, turns

B = r"[\x20\x09-\x0D\x{3000}]+"
C = f"regexp_replace(text, '{B}', '', 'g')"
#: Tracks of cue_ev but ``view``, whose intervals serve as speech, and how many minutes the speech of each is late.
LATE = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
RISKY = ("the", "que", "der")


def union_sql(name: str, src: str, gap: int = 0) -> str:
    """Common table expressions that end in ``name``: the union of the intervals of ``src``."""
    return f"""{name}_a as (select *, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from {src}),
{name}_b as (select *, sum(case when reach is null or start_ms > reach + {gap} then 1 else 0 end) over (partition by track order by start_ms, end_ms rows unbounded preceding) island from {name}_a),
{name} as (select track, min(start_ms) start_ms, max(end_ms) end_ms from {name}_b group by track, island)"""


def ev_cues(spark, d):
    return cue_ev(spark, d).filter("track <> 'view'")


def ev_speech(spark, d):
    """Intervals of ``view``, copied to each other track with its delay."""
    view = iv.merge_intervals(cue_ev(spark, d).filter("track = 'view'").select("track", "start_ms", "end_ms"))
    late = F.explode(F.array(*[F.struct(F.lit(k).alias("track"), F.lit(60_000 * n).alias("late")) for k, n in LATE.items()])).alias("t")
    t = view.select(late, "start_ms", "end_ms")
    return t.select("t.track", (F.col("start_ms") + F.col("t.late")).alias("start_ms"), (F.col("end_ms") + F.col("t.late")).alias("end_ms"))


def ev_tracks(spark, d):
    return ev_cues(spark, d).groupBy("track").agg((F.max("end_ms") + 5000).alias("duration_ms"))


MIN_GAP, MIN_SPEECH, PAD = 60_000, 30_000, 2_000
SPEECH = f"""with {EV}, cues as (select * from cue_ev where track <> 'view'), {union_sql('view', "(select * from cue_ev where track = 'view')")},
speech as (select l.track, start_ms + late start_ms, end_ms + late end_ms from view, (values {', '.join(f"('{k}', {60_000 * n})" for k, n in LATE.items())}) l(track, late)),
tracks as (select track, max(end_ms) + 5000 dur from cues group by track), {union_sql('covered', 'cues')},
edges as (select track, start_ms, end_ms from covered union all select track, 0, 0 from tracks union all select track, dur, dur from tracks),
holes as (select track, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) a, start_ms b from edges),
gaps as (select h.track, a start_ms, b end_ms, sum(least(b, s.end_ms) - greatest(a, s.start_ms))::bigint speech_ms from holes h join speech s on s.track = h.track and s.start_ms < b and a < s.end_ms where b - a >= {MIN_GAP} group by all having sum(least(b, s.end_ms) - greatest(a, s.start_ms)) >= {MIN_SPEECH})"""
COVERAGE = f"""{SPEECH}, wide as (select track, greatest(0, start_ms - {PAD}) start_ms, end_ms + {PAD} end_ms from cues), {union_sql('padded', 'wide')},
t as (select track, sum(end_ms - start_ms)::bigint speech_ms from speech group by track),
k as (select s.track, sum(least(s.end_ms, p.end_ms) - greatest(s.start_ms, p.start_ms))::bigint covered_ms from speech s join padded p on p.track = s.track and p.start_ms < s.end_ms and s.start_ms < p.end_ms group by s.track),
g as (select track, count(*) gaps_with_speech from gaps group by track)
select tracks.track, coalesce(speech_ms, 0) speech_ms, coalesce(covered_ms, 0) covered_ms, coalesce(gaps_with_speech, 0) gaps_with_speech, coalesce(speech_ms, 0) - coalesce(covered_ms, 0) uncovered_ms,
  case when speech_ms > 0 then round(coalesce(covered_ms, 0) / speech_ms, 3) end coverage from tracks left join t using (track) left join k using (track) left join g using (track)"""


def summary_sql(view: str, source: str) -> str:
    few = ", ".join(f"count_if(c <= {n}) chars_to_{n}" for n in (1, 2, 3, 5))
    holes = ", ".join(f"count_if(start_ms - reach > {n}000) gaps_{n}s" for n in (10, 30, 60))
    parts = [f"round(quantile_cont({v}, {q / 100}), 3) {n}_p{q}" for n, v in (("dur", "end_ms - start_ms"), ("chars", "c")) for q in (50, 95)]
    return f"""with {view}, {union_sql('merged', source)},
u as (select track, sum(end_ms - start_ms)::bigint union_ms, count(*) islands from merged group by track),
h as (select track, {holes}, max(start_ms - reach) gap_max, round(quantile_cont(start_ms - reach, 0.95), 3) gap_p95 from merged_a where start_ms > reach group by track),
b as (select track, count(*) entries, sum(end_ms - start_ms)::bigint display_ms, min(start_ms) first_ms, max(end_ms) last_ms, {', '.join(parts)}, {few},
  count_if(end_ms - start_ms < 400) under_400, count_if(end_ms - start_ms > 8000) over_8000, count(*) filter (prev > start_ms) n_overlaps
  from (select *, length({C}) c, lag(end_ms) over (partition by track order by pos) prev from {source}) group by track)
select b.*, union_ms, islands, coalesce(gaps_10s, 0) gaps_10s, coalesce(gaps_30s, 0) gaps_30s, coalesce(gaps_60s, 0) gaps_60s, gap_max, gap_p95, display_ms - union_ms overlap_ms, round(union_ms / (last_ms - first_ms), 6) coverage
from b join u using (track) left join h using (track)"""


def doubtful(spark, d):
    """Lines with made-up confidences, some absent."""
    pos = F.col("pos")
    return cue_doc(spark, d).withColumns({"no_speech_prob": F.when(pos % 4 != 0, (pos % 10) / F.lit(10.0)), "avg_logprob": F.when(pos % 3 != 0, -(pos % 8) / F.lit(4.0))})


DOUBTFUL = "doubtful as (select *, case when pos % 4 <> 0 then (pos % 10) / 10.0::double end no_speech_prob, case when pos % 3 <> 0 then -(pos % 8) / 4.0::double end avg_logprob from cue_doc)"
PHRASES = f"""with {DOC}, {DOUBTFUL}, p as (select *, trim({C}, '{EDGE}') phrase from doubtful),
g as (select track, phrase, count(*) times, median(no_speech_prob) ns, median(avg_logprob) lp from p where phrase <> '' group by all),
r as (select track, phrase, unnest(list_filter([{', '.join(f"'{x}'" for x in RISKY)}], lambda k: contains(phrase, k))) core, times from g),
m as (select track, core from r group by all having sum(times) >= 12), k as (select distinct track, phrase from r semi join m using (track, core))
select * from (select g.track, g.phrase, times, case when k.phrase is not null then 'risky' when times >= 2 and (coalesce(ns >= 0.6, false) or coalesce(lp <= -1.0, false)) then 'repeated' end reason from g left join k using (track, phrase)) where reason is not null"""


def phrases(spark, d):
    return rp.repeated_phrases(doubtful(spark, d), 2, 0.6, -1.0, RISKY, 12)


def words(spark, d):
    """Lines as aligned words of chunks of six; some chunks are squeezed to points or to zero."""
    chunk = F.floor((F.col("pos") - 1) / 6).cast("int")
    own = Window.partitionBy("track", "chunk")  # rows of a track are together already, so lines move once
    t = cue_doc(spark, d).withColumn("chunk", chunk).withColumns({"low": F.min("start_ms").over(own), "high": F.max("end_ms").over(own)})
    kind = (F.col("track") + F.col("chunk")) % 5
    start = F.when(kind == 1, F.lit(0)).when(kind == 2, F.floor((F.col("start_ms") - F.col("low")) / 400)).otherwise(F.col("start_ms") - F.col("low"))
    end = F.when(kind == 1, F.lit(0)).when(kind == 3, F.col("start_ms") - F.col("low")).when(kind == 2, F.floor((F.col("end_ms") - F.col("low")) / 400)).otherwise(F.col("end_ms") - F.col("low"))
    return t.select("track", "chunk", "pos", F.col("text").alias("word"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), (F.col("high") - F.col("low")).alias("scene_ms"))


def health(spark, d):
    w = words(spark, d)
    return rp.alignment_health(w, w.groupBy("track", "chunk").agg(F.max("scene_ms").alias("scene_ms")))


WORDS = f"""{DOC}, wa as (select *, ((pos - 1) // 6)::int chunk from cue_doc), wb as (select *, min(start_ms) over w low, max(end_ms) over w - min(start_ms) over w scene_ms, (track + chunk) % 5 kind from wa window w as (partition by track, chunk)),
words as (select track, chunk, pos, text word, scene_ms, case kind when 1 then 0 when 2 then (start_ms - low) // 400 else start_ms - low end start_ms, case kind when 1 then 0 when 2 then (end_ms - low) // 400 when 3 then start_ms - low else end_ms - low end end_ms from wb)"""
HEALTH = f"""with {WORDS}, g as (select track, chunk, max(scene_ms) scene_ms, count(*) words, sum(length(word))::bigint chars, greatest(0, arg_max(end_ms, pos) - arg_min(start_ms, pos)) span_ms, count_if(start_ms = 0 and end_ms = 0) zeros, count_if(start_ms = end_ms) points from words group by all),
t as (select *, case when chars <= 10 or scene_ms <= 0 then '' else concat_ws(',', case when span_ms < 0.05 * scene_ms then 'coverage' end, case when span_ms = 0 or chars * 1000.0 > 50 * span_ms then 'cps' end, case when span_ms < 500 then 'span' end,
  case when zeros > 0.1 * words then 'zero_position' end, case when points > 0.4 * words then 'degenerate' end) end triggers from g)
select track, chunk, words, chars, span_ms, triggers, case when triggers = '' then 'OK' else 'COLLAPSED' end status from t"""


def rollup(spark, d):
    return rp.chunk_rollup(table(spark, d, "events"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.col("value") == 0, ["user_id"])


def ranges(spark, d):
    """Items of a clip of 30 s: the lines of a document that begin in its first half minute, and those just before its end."""
    t = cue_alt(spark, d)
    return rp.item_ranges(t.filter("start_ms < 31000"), t.groupBy("track").agg(F.lit(30_000).alias("clip_ms")), 1500, ["track"])


QUERIES = {
    "a02_distribution": (lambda s, d: rp.distribution(table(s, d, "events"), F.when(F.col("value") > 1, F.col("value") - 50), ["event_type"]), "select event_type, count(v) n, round(avg(v), 6) mean_abs, round(quantile_cont(v, 0.5), 6) median_abs, round(quantile_cont(v, 0.95), 6) p95_abs from (select event_type, case when value > 1 then abs(value - 50) end v from events) group by event_type"),
    "a03_track_summary": (lambda s, d: rp.track_summary(cue_ev(s, d)), summary_sql(EV, "cue_ev")),
    "a03_document_summary": (lambda s, d: rp.track_summary(cue_doc(s, d)), summary_sql(DOC, "cue_doc")),
    "a04_speech_coverage": (lambda s, d: rp.speech_coverage(ev_cues(s, d), ev_speech(s, d), ev_tracks(s, d), PAD, MIN_GAP, MIN_SPEECH), COVERAGE),
    "k02_suspicious_gaps": (lambda s, d: rp.top_per_track(rp.suspicious_gaps(ev_cues(s, d), ev_speech(s, d), ev_tracks(s, d), MIN_GAP, MIN_SPEECH), 5, F.desc("speech_ms"), "start_ms"), f"{SPEECH} select *, row_number() over (partition by track order by speech_ms desc, start_ms)::int as rank from gaps qualify rank <= 5"),
    "k03_first_lines": (lambda s, d: rp.top_per_track(cue_doc(s, d), 3, "pos").select("track", "pos", "text", "rank"), f"with {DOC} select track, pos, text, row_number() over (partition by track order by pos)::int as rank from cue_doc qualify rank <= 3"),
    "k01_track_order": (lambda s, d: cue_ev(s, d).repartitionByRange("track", "start_ms").sortWithinPartitions("track", "start_ms", "end_ms", "pos"), f"with {EV} select * from cue_ev order by track, start_ms, end_ms, pos"),
    "a05_chunk_rollup": (rollup, "select user_id, count(*) chunks, count_if(try_cast(json_extract_string(props, '$.k') as bigint) is null) unreadable, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint model_ms, count_if(value = 0) as empty from events group by user_id"),
    "a07_repeated_phrases": (phrases, PHRASES),
    "a07_without_phrases": (lambda s, d: rp.without_phrases(cue_doc(s, d), phrases(s, d)).select("track", "pos", "text"), f"with x as ({PHRASES}), {DOC} select track, pos, text from cue_doc anti join x on x.track = cue_doc.track and x.phrase = trim({C}, '{EDGE}')"),
    "a08_alignment_health": (health, HEALTH),
    "a10_item_ranges": (ranges, f"with {ALT}, i as (select * from cue_alt where start_ms < 31000) select t.track, count(i.track) items, min(i.start_ms) start_ms, max(i.end_ms) end_ms, min(i.start_ms) >= -1500 and max(i.end_ms) <= 31500 inside from (select distinct track from cue_alt) t left join i using (track) group by t.track"),
    "a11_reasons": (lambda s, d: rp.reason_counts(table(s, d, "events"), F.nullif("event_type", F.lit("view"))), "select coalesce(nullif(event_type, 'view'), 'unknown') reason, count(*) frames from events group by 1"),
    "a21_slots": (lambda s, d: rp.slot_statistics(turns(s, d), "role", 20), f"with {TURNS} select role, count(*) slots, count(*) - count(distinct text) hits, count_if(length(text) < 20) short from turns group by role"),
}
