"""Queries on several runs over the same tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fragments import FILLERS, REPLIES
from ..functions.normal import filler_core
from ..functions.text import compact
from ..operators import intervals as iv
from ..operators import runs as rn
from .views import ALT, EV, TERM_ROWS, TURNS, cue_alt, cue_doc, cue_ev, table, terms, turns

DOC = ALT.split(",\ncue_alt as")[0]
PAD, SHARE, LEAST = 500, 0.5, 4
B = r"[\x20\x09-\x0D\x{3000}]+"


def two_runs(spark, d):
    late = cue_doc(spark, d).withColumns({"start_ms": F.col("start_ms") + 30000, "end_ms": F.col("end_ms") + 30000})
    return cue_alt(spark, d).withColumn("run", F.lit("alt")).unionByName(late.withColumn("run", F.lit("late")))


def durations(cues):
    return cues.groupBy("track").agg(F.max("end_ms").alias("duration_ms"))


def pairs_of(x: str) -> str:
    chars = f"regexp_extract_all(regexp_replace({x}, '{B}', '', 'g'), '(?s).')"
    return f"(case when len({chars}) < 2 then [] else list_distinct(list_transform(list_zip({chars}[1:-2], {chars}[2:]), lambda p: p[1] || p[2])) end)"


RUNS = ALT + ", runs as (select 'alt' run, * from cue_alt union all by name select 'late' run, track, pos, start_ms + 30000 start_ms, end_ms + 30000 end_ms, text from cue_doc)"
HITS = f""", seg as (select * from cue_doc where length(regexp_replace(text, '{B}', '', 'g')) >= {LEAST}),
win as (select r.run, s.track, s.pos, string_agg(r.text, ' ' order by r.start_ms, r.pos) wt from seg s join runs r on s.track = r.track and r.end_ms >= s.start_ms - {PAD} and r.start_ms <= s.end_ms + {PAD} group by all),
sb as (select track, pos, {pairs_of('text')} a from seg), wb as (select run, track, pos, {pairs_of('wt')} b from win),
hits as (select q.run, s.track, s.pos, coalesce(len(list_intersect(s.a, w.b)) >= {SHARE} * len(s.a), false) hit from sb s cross join (select distinct run from runs) q left join wb w on w.run = q.run and w.track = s.track and w.pos = s.pos)"""
TIMES = "select run, count(*) cues, count_if(end_ms - start_ms < 400) too_short, count_if(end_ms - start_ms > 8000) too_long, count_if(start_ms < b) overlapping from (select *, lag(end_ms) over (partition by run, track order by start_ms, end_ms, pos) b from runs) group by run"
ISLES = "isl as (select *, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from cue_ev), isn as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by track order by start_ms, end_ms, pos) island from isl), regions as (select track, min(start_ms) start_ms, max(end_ms) end_ms from isn group by track, island)"
SHARES = (0.2, 0.5, 0.8)


def nearest(spark, d):
    c = cue_doc(spark, d)
    t = rn.nearest(rn.anchors(durations(c), SHARES), c.filter(F.length(compact(F.col("text"))) >= 4), 90000)
    return t.withColumn("window_ms", F.greatest(F.col("start_ms") - 2000, F.lit(0)))


def flagged(spark, d):
    return cue_doc(spark, d).withColumns({"hard": F.contains(F.col("text"), F.lit("and")), "risky": F.contains(F.col("text"), F.lit("er"))})


def cored(spark, d):
    """Lines of which some are mumbled: fillers and replies with their marks."""
    pos = F.col("pos")
    text = F.when(pos % 4 == 1, F.lit("「うーん、」")).when(pos % 9 == 2, F.lit("はい。")).when(pos % 6 == 5, F.lit("あっ……")).otherwise(F.col("text"))
    return cue_doc(spark, d).withColumn("text", text).withColumn("core", filler_core("text"))


def texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def told_records(spark, d):
    """Two runs' records of the turns: one joins pairs and says nothing of each fifth pair, the other lacks each seventh turn and has each third twice."""
    t = turns(spark, d).select("track", "pos", F.md5("text").alias("text"))
    pair = F.floor(F.col("pos") / 2).cast("int")
    a = t.groupBy("track", pair.alias("number")).agg(F.array_sort(F.collect_list("pos")).alias("ids"), F.max("text").alias("text")).withColumn("text", F.when(F.col("number") % 5 < 4, F.col("text")))
    b = t.filter("pos % 7 <> 3").withColumn("number", F.explode(F.when(F.col("pos") % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0))))).select("track", "number", F.array("pos").alias("ids"), F.concat(F.col("number").cast("string"), "text").alias("text"))
    return a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")))


RECORDS = f"""with {TURNS}, t as (select track, pos, md5(text) m from turns), g as (select track, pos // 2 as n, list(pos order by pos) ids, max(m) m from t group by all),
a as (select track, n, ids, unnest(ids) id, case when n % 5 < 4 then m else '[deleted]' end m from g)
select t.track, t.pos id, case when len(a.ids) > 1 then '[merged ' || array_to_string(a.ids, ',') || '] ' else '' end || a.m a,
  case when t.pos % 7 = 3 then '[uncovered]' when t.pos % 3 = 0 then '0' || t.m || ' | 1' || t.m else '0' || t.m end b from t join a on a.track = t.track and a.id = t.pos"""
FILLER = """with {doc}, a0 as (select * exclude (text), case when pos % 4 = 1 then '「うーん、」' when pos % 9 = 2 then 'はい。' when pos % 6 = 5 then 'あっ……' else text end text, case when pos % 4 = 1 then 'うん' when pos % 9 = 2 then 'はい' when pos % 6 = 5 then 'あ' else '' end core from cue_doc),
a as (select *, core <> '' filler from a0),
b as (select *, filler and not coalesce(core = 'はい' and start_ms - last_value(case when not filler then end_ms end ignore nulls) over (partition by track order by start_ms, end_ms, pos rows between unbounded preceding and 1 preceding) <= 3000, false) f from a),
c as (select *, start_ms - lag(end_ms) over w g, lead(start_ms) over w - end_ms h, lag(f) over w pf from b window w as (partition by track order by start_ms, end_ms, pos)),
e as (select *, sum(case when f and coalesce(pf and g <= 5000, false) then 0 else 1 end) over (partition by track order by start_ms, end_ms, pos) island from c),
i as (select track, island, count(*) n, arg_min(coalesce(g, 5000), pos) g, arg_max(coalesce(h, 5000), pos) h from e group by all)
select track, pos, text from e join i using (track, island) where not (f and (n >= 3 or (i.g >= 5000 and i.h >= 5000)))"""
NEAR = "coalesce({f}(hard) over w and (abs({f}(start_ms) over w - end_ms) <= 5000 or abs(start_ms - {f}(end_ms) over w) <= 5000), false)"

QUERIES = {
    "j05_first_region": (lambda s, d: rn.first_region(cue_ev(s, d), iv.merge_intervals(cue_ev(s, d).filter("pos % 3 = 0"))), f"with {EV}, {ISLES.replace('from cue_ev', 'from (select * from cue_ev where pos % 3 = 0)')} select c.track, c.pos, min(r.start_ms) region_ms from cue_ev c left join regions r on c.track = r.track and floor((c.start_ms + c.end_ms) / 2) >= r.start_ms and floor((c.start_ms + c.end_ms) / 2) <= r.end_ms group by c.track, c.pos"),
    "j06_window_texts": (lambda s, d: rn.window_texts(cue_doc(s, d), cue_alt(s, d), PAD), f"with {ALT} select s.track, s.pos, string_agg(r.text, ' ' order by r.start_ms, r.pos) window_text from cue_doc s join cue_alt r on s.track = r.track and r.end_ms >= s.start_ms - {PAD} and r.start_ms <= s.end_ms + {PAD} group by all"),
    "j07_recall": (lambda s, d: rn.recall(cue_doc(s, d), cue_alt(s, d), PAD, SHARE, LEAST), f"with {RUNS}{HITS} select track, count(*) segments, count_if(hit) hits, min(case when not hit then pos end) first_missed from hits where run = 'alt' group by track"),
    "j08_consensus": (lambda s, d: rn.consensus(cue_doc(s, d), two_runs(s, d), PAD, SHARE, LEAST), f"with {RUNS}{HITS} select track, pos, count_if(hit) runs, bool_or(hit) confirmed from hits group by track, pos"),
    "j09_run_scores": (lambda s, d: rn.run_scores(cue_doc(s, d), two_runs(s, d), PAD, SHARE, LEAST), f"with {RUNS}{HITS}, h as ({TIMES}), k as (select run, count(*) segments, count_if(hit) hits from hits group by run) select *, round(hits / segments, 3) recall from k join h using (run)"),
    "j10_nearest": (nearest, f"with {DOC}, a as (select track, unnest([0, 1, 2])::int anchor, floor(m * unnest([0.2::double, 0.5::double, 0.8::double]))::bigint at_ms from (select track, max(end_ms) m from cue_doc group by track)), k as (select a.*, pos, start_ms from a join cue_doc c on a.track = c.track and abs(start_ms - at_ms) <= 90000 and length(regexp_replace(text, '{B}', '', 'g')) >= 4 qualify row_number() over (partition by a.track, anchor order by abs(start_ms - at_ms), start_ms) = 1) select *, greatest(start_ms - 2000, 0) window_ms from k"),
    "j14_timeline": (lambda s, d: rn.timeline_to_real(cue_ev(s, d).select("track", "pos", F.col("start_ms").alias("at_ms")), iv.merge_intervals(cue_ev(s, d))), f"with {EV}, {ISLES}, cum as (select *, sum(end_ms - start_ms) over (partition by track order by start_ms) t from regions where end_ms > start_ms) select e.track, e.pos, e.start_ms at_ms, coalesce(c.start_ms + e.start_ms - (c.t - (c.end_ms - c.start_ms)), m.last)::bigint real_ms from cue_ev e join (select track, max(end_ms) last from regions group by track) m using (track) left join cum c on c.track = e.track and greatest(e.start_ms, 1) > c.t - (c.end_ms - c.start_ms) and greatest(e.start_ms, 1) <= c.t"),
    "j16_lock_differences": (lambda s, d: rn.table_differences(cue_doc(s, d), cue_alt(s, d).withColumns({"start_ms": F.col("start_ms") - 150}), ("track", "pos"), ("start_ms", "end_ms", "text")), f"with {ALT} select track, pos, case when b.text is null then 'missing' else 'differs' end kind, case when b.text is null then '' when a.text <> b.text then 'end_ms,text' else 'end_ms' end fields from cue_doc a left join cue_alt b using (track, pos)"),
    "j21_computed_once": (lambda s, d: rn.computed_once(cue_doc(s, d), "text", ("track", "pos"), F.md5).select("track", "pos", "result", "sent"), f"with {DOC} select track, pos, md5(text) result, row_number() over (partition by text order by track, pos) = 1 sent from cue_doc"),
    "j22_merged_sources": (lambda s, d: rn.merged_sources(texts(s, d), "digest", ("lang", "source", "n_chars"), "doc_id"), "select md5(coalesce(text, '')) digest, count(*) \"rows\", count(distinct {'l': lang, 's': source, 'n': n_chars}) = 1 consistent, max(doc_id) \"last\" from documents group by 1"),
    "w07_neighbour_filter": (lambda s, d: rn.neighbour_filter(flagged(s, d)).select("track", "pos", "risky"), f"with {DOC}, a as (select *, contains(text, 'and') hard, contains(text, 'er') risky from cue_doc), b as (select *, {NEAR.format(f='lag')} or {NEAR.format(f='lead')} n from a window w as (partition by track order by pos)) select track, pos, risky from b where not (hard or (risky and n))"),
    "w08_filler_drop": (lambda s, d: rn.filler_drop(cored(s, d), FILLERS, REPLIES, 5000).select("track", "pos", "text"), FILLER.format(doc=DOC)),
    "w20_offsets": (lambda s, d: rn.concatenated(turns(s, d), F.greatest(F.lit(800), F.length("text") * 60)).select("track", "pos", "offset_ms"), f"with {TURNS} select track, pos, coalesce(sum(greatest(800, length(text) * 60) + 4000) over (partition by track order by pos rows between unbounded preceding and 1 preceding), 0)::bigint offset_ms from turns"),
    "w21_block_terms": (lambda s, d: rn.block_terms(cue_doc(s, d), terms(s), 3, 10000), f"""with {DOC}, {TERM_ROWS}, h as (select track, pos, source from cue_doc join terms on contains(text, source)), k as (select * from h a where not exists (from h b where a.track = b.track and a.pos = b.pos and b.source <> a.source and contains(b.source, a.source))),
s0 as (select *, case when start_ms - lag(end_ms) over (partition by track order by pos) > 10000 then 1 else 0 end nw from cue_doc), s1 as (select *, sum(nw) over (partition by track order by pos rows unbounded preceding)::bigint as session from s0), s2 as (select track, pos, session, (row_number() over (partition by track, session order by pos) - 1) // 3 as block from s1),
f as (select track, session, block, source, min(pos) first from k join s2 using (track, pos) group by all) select track, session, block, string_agg(source, '|' order by first, source) terms from f group by track, session, block"""),
    "s02_tumbling": (lambda s, d: rn.tumbling(cue_doc(s, d), 60000), f'with {DOC}, e as (select track, max(end_ms) m from cue_doc group by track) select track, start_ms // 60000 as "window", count(*) cues, sum(length(text))::bigint chars, start_ms // 60000 * 60000 as start_ms, least((start_ms // 60000 + 1) * 60000, max(m)) end_ms from (select c.*, m from cue_doc c join e using (track)) group by track, start_ms // 60000'),
    "s04_blind_sides": (lambda s, d: rn.blind_sides(texts(s, d), "lang", "doc_id", 7), "select lang, doc_id, row_number() over (partition by lang order by md5('7:' || doc_id), doc_id)::int rank, case when substr(md5('7:' || doc_id), 1, 1) < '8' then 'ab' else 'ba' end sides from documents"),
    "a16_acceptance": (lambda s, d: rn.review_acceptance(texts(s, d), table(s, d, "labels").select("doc_id", ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("eligible")), "doc_id", "source"), "with l as (select doc_id, count(*) n, bool_and(toxic = 0 and quality = 1) e from labels group by doc_id) select source, count(*) cues, count_if(n = 1) reviewed, count_if(n is null) undecided, count_if(n > 1) repeated, count_if(n = 1 and e) eligible, bool_and(coalesce(n = 1 and e, false)) accepted from documents left join l using (doc_id) group by source"),
    "a17_split_conflicts": (lambda s, d: rn.split_conflicts(texts(s, d), "digest", "source"), "select md5(coalesce(text, '')) digest, count(distinct source) splits, count(*) \"rows\" from documents group by 1 having count(distinct source) > 1"),
    "a18_batch_budgets": (lambda s, d: rn.batch_budgets(turns(s, d).withColumn("batch", F.floor(F.col("track") / 4)), "batch", F.greatest(F.lit(64), F.length("text"))), f"with {TURNS}, b as (select track // 4 as batch, greatest(64, length(text)) n from turns) select batch, max(n)::int budget, count(distinct n) budgets, count(distinct n) > 1 regroup from b group by batch"),
    "a20_fingerprint": (lambda s, d: texts(s, d).select("doc_id", rn.fingerprint("source", "n_chars", "lang", "doc_id").alias("fingerprint")), "select doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})) fingerprint from documents"),
    "a22_record_pivot": (lambda s, d: rn.record_pivot(turns(s, d).select("track", F.col("pos").alias("id")), told_records(s, d), ("a", "b")), RECORDS),
    "a22_pivot": (lambda s, d: rn.run_pivot(two_runs(s, d), ("alt", "late")), f"with {RUNS} select track, pos, coalesce(max(text) filter (run = 'alt'), '[uncovered]') alt, coalesce(max(text) filter (run = 'late'), '[uncovered]') late from runs group by track, pos"),
}
