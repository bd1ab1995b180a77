"""Queries on scans and sinks: files are made of the given tables, as texts in a column, and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import srt_time
from ..operators import checks as ck
from ..operators import tracks as tr
from ..sources import dumps as du
from ..sources import subtitles as sub
from .views import ALT, DOC, EV, TERM_ROWS, TURNS, cue_alt, cue_doc, cue_ev, table, terms, turns

SRT = "lpad((m // 3600000)::varchar, greatest(2, length((m // 3600000)::varchar))::int, '0') || ':' || lpad((m // 60000 % 60)::varchar, 2, '0') || ':' || lpad((m // 1000 % 60)::varchar, 2, '0') || ',' || lpad((m % 1000)::varchar, 3, '0')"


def files(spark, d):
    """Documents as subtitle files with faults: ids that repeat or aren't numbers, settings, blank lines in texts, ends before starts."""
    c = cue_doc(spark, d)
    pos = F.col("pos")
    text = F.regexp_replace(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")), r"[\x09-\x0D]", " ")
    name = F.when(pos % 6 == 5, F.lit("x")).when(pos % 9 == 8, (pos - 1).cast("string")).otherwise(pos.cast("string"))
    end = F.when(pos % 10 == 9, F.col("start_ms") - 1000).otherwise(F.col("end_ms"))
    head = F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.greatest(end, F.lit(0))), F.when(pos % 4 == 0, F.lit(" align:start")).otherwise(F.lit("")))
    body = F.when(pos % 3 == 0, F.concat(text, F.lit("\n  second line "))).otherwise(text)
    block = F.concat_ws("\n", name, head, body)
    t = c.select("track", F.struct("pos", block.alias("b")).alias("s")).groupBy("track").agg(F.array_sort(F.collect_list("s")).alias("all"))
    return t.select(F.col("track").alias("file"), F.array_join(F.col("all.b"), "\n\n").alias("text"))


CUES = rf"""{DOC}, k as (select *, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x09-\x0D]', ' ', 'g') one, case when pos % 6 = 5 then 'x' when pos % 9 = 8 then (pos - 1)::varchar else pos::varchar end id, case when pos % 10 = 9 then greatest(0, start_ms - 1000) else end_ms end stop from cue_doc)"""
FINE = f"{CUES}, v as (select *, regexp_full_match(id, '\\d+') and stop > start_ms and one <> '' fine from k), w as (select *, fine and row_number() over (partition by track, id, fine order by pos) = 1 ok from v)"


def dump_files(spark, d):
    """Documents as recogniser dumps: a chunk for each six lines with words, regions and keep windows; some chunks replaced, some without windows."""
    c = cue_doc(spark, d).withColumn("chunk", F.floor((F.col("pos") - 1) / 6))
    sec = lambda x: F.round(x / 1000.0, 3)
    low = F.min("start_ms").over(Window.partitionBy("track", "chunk"))
    t = c.withColumn("low", low).groupBy("track", "chunk", "low").agg(F.max("end_ms").alias("high"), F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "text"))).alias("l"))
    item = F.transform("l", lambda x: F.struct(x["text"].alias("text"), sec(x["start_ms"] - F.col("low")).alias("start"), F.when(x["pos"] % 5 > 0, sec(x["end_ms"] - F.col("low"))).alias("end")))
    regions = F.transform("l", lambda x: F.array(sec(x["start_ms"] - F.col("low")), sec(x["end_ms"] - F.col("low") - 300)))
    chunk = F.struct("chunk", sec(F.col("low")).alias("start"), sec(F.col("high")).alias("end"), F.when(F.col("chunk") % 3 == 0, sec(F.col("low"))).alias("keep_lo"), F.when(F.col("chunk") % 6 == 0, sec(F.col("high"))).alias("keep_hi"), F.array_join(F.col("l.text"), "").alias("text"), item.alias("items"), regions.alias("speech_regions"), (F.col("chunk") % 4 == 3).alias("superseded_by_stepdown"))
    t = t.select("track", "high", chunk.alias("c")).groupBy("track").agg(F.max("high").alias("high"), F.array_sort(F.collect_list("c")).alias("chunks"))
    dump = F.struct(sec(F.col("high")).alias("duration"), F.lit(30.0).alias("chunk_seconds"), F.lit(6.0).alias("chunk_overlap_seconds"), "chunks")
    return t.select(F.col("track").alias("file"), F.when(F.col("track") % 7 == 6, F.concat(F.lit("{"), F.to_json(dump))).otherwise(F.to_json(dump)).alias("text"))


CHUNKS = f"{DOC}, c as (select *, (pos - 1) // 6 chunk from cue_doc where track % 7 <> 6), g as (select track, chunk, min(start_ms) low, max(end_ms) high, string_agg(text, '' order by pos) t from c group by track, chunk), h as (select *, max(high) over (partition by track) dur from g)"


def chunk_sides(spark, d):
    """Chunks of a dump, and a run that lacks every fifth and has other texts."""
    t = du.dump_chunks(dump_files(spark, d)).select("file", "chunk", "start_ms", "end_ms", "text", F.when(F.col("chunk") % 2 == 0, F.size("regions")).alias("regions"))
    run = t.filter("chunk % 5 <> 4").withColumns({"text": F.concat(F.lit("run:"), "text"), "regions": F.lit(-1)})
    return du.reconciled_chunks(t, run, ("start_ms", "end_ms", "text"), ("regions",))


def ass_files(spark, d):
    return sub.ass_text(tr.paired(cue_doc(spark, d), cue_alt(spark, d))).withColumnsRenamed({"track": "file", "value": "text"})


def esc(x: str) -> str:
    return rf"replace(translate(replace({x}, '\', '\\'), '{{}}', '()'), chr(10), '\N')"


def ass(x: str) -> str:
    return f"((round_even({x} / 10, 0)::bigint) // 360000) || ':' || lpad(((round_even({x} / 10, 0)::bigint) // 6000 % 60)::varchar, 2, '0') || ':' || lpad(((round_even({x} / 10, 0)::bigint) // 100 % 60)::varchar, 2, '0') || '.' || lpad(((round_even({x} / 10, 0)::bigint) % 100)::varchar, 2, '0')"


ASS_LINE = f"'Dialogue: 0,' || {ass('d.start_ms')} || ',' || {ass('d.end_ms')} || ',TL,,0,0,0,,' || {esc('d.text')} || case when coalesce(a.text, '') = '' then '' else '\\N{{\\rSL}}' || {esc('a.text')} end".replace("\\\\", "\\")
HEADER = sub.ass_header().replace("'", "''").replace("\n", "' || chr(10) || '")


def listing(spark, d):
    """Documents as a listing of files of three kinds in folders by source."""
    t = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, F.lit(".old.srt")).when(F.col("doc_id") % 3 == 0, F.lit(".src.srt")).otherwise(F.lit(".srt"))
    return t.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"), kind).alias("path"), "n_chars", F.coalesce("source", F.lit("none")).alias("folder"))


LISTING = "l as (select coalesce(source, 'none') || '/' || (doc_id // 3) || case when doc_id % 5 = 0 then '.old.srt' when doc_id % 3 = 0 then '.src.srt' else '.srt' end path, n_chars, coalesce(source, 'none') folder from documents)"


def pairs_of_files(spark, d):
    return du.paired_files(listing(spark, d).filter("path not like '%.old.srt' and path not like '%.src.srt'").unionByName(listing(spark, d).filter("path like '%.old.srt' or path like '%.src.srt'")).select("path").distinct().withColumn("path", F.regexp_replace("path", r"(/\d+)\.srt$", "$1.new.srt")), ".new.srt", ".old.srt", ".src.srt")


def issue_terms(spark, d):
    hit = tr.glossary_issues(cue_doc(spark, d), cue_alt(spark, d), terms(spark), ["track", "pos"])
    return du.term_review(hit.join(terms(spark).select("source", "forbidden"), "source"))


def parts(spark, d):
    t = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("reference"), F.lit("audio").alias("kind"), F.col("doc_id").alias("id"))
    return t.filter("id % 3 = 0").unionByName(t.filter("id % 50 = 0").withColumn("id", -F.col("id") - 1))


def samples(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("reference"), F.col("doc_id").alias("id"), "n_chars")


QUERIES = {
    "io01_strict_cues": (lambda s, d: sub.strict_cues(files(s, d))[0].select("file", "block", "id", "start_ms", "end_ms", "settings", "text"), f"with {FINE} select track file, pos - 1 as block, id, start_ms, stop end_ms, case when pos % 4 = 0 then 'align:start' else '' end settings, case when pos % 3 = 0 then one || chr(10) || '  second line ' else one end as text from w where ok"),
    "io01_file_status": (lambda s, d: sub.strict_cues(files(s, d))[1].drop("sha256"), f"with {FINE}, f as (select track, count_if(ok) cues, count_if(not ok) rejected from w group by track) select track file, case when cues = 0 then 'invalid' when rejected > 0 then 'partial_invalid' else 'valid' end status, cues::bigint cues, rejected::bigint rejected, true as \"ordered\" from f"),
    "io02_lenient_cues": (lambda s, d: sub.srt_blocks(files(s, d)).filter("long").select("file", "block", "id", "start_ms", "settings"), f"with {CUES} select track file, pos - 1 as block, id, start_ms, case when pos % 4 = 0 then 'align:start' else '' end settings from k where one <> '' or pos % 3 = 0"),
    "io03_display_cues": (lambda s, d: sub.display_cues(files(s, d)), f"with {CUES} select track file, pos - 1 as block, id, start_ms, stop end_ms, case when pos % 3 <> 0 then one when one = '' then 'second line' else one || chr(10) || 'second line' end as text from k where one <> '' or pos % 3 = 0"),
    "io04_legacy_cues": (lambda s, d: sub.legacy_cues(files(s, d)), f"with {CUES} select track file, pos - 1 as block, start_ms, stop end_ms, case when pos % 3 = 0 then one || '   second line ' else one end as text from k where (one <> '' or pos % 3 = 0) and start_ms < 360000000 and stop < 360000000"),
    "io05_ass_cues": (lambda s, d: sub.ass_cues(ass_files(s, d)), rf"with {ALT}, p as (select d.*, translate(replace(a.text, '\', '\\'), '{{}}', '()') st, row_number() over (partition by d.track order by d.pos) n from cue_doc d left join cue_alt a using (track, pos)) select track file, (n - 1 + {len(sub.ass_header().splitlines())})::int as line, (round_even(start_ms / 10, 0) * 10)::bigint start_ms, (round_even(end_ms / 10, 0) * 10)::bigint end_ms, regexp_replace(st, '\\[Nn]', ' ', 'g') as text from p where coalesce(st, '') <> ''"),
    "io06_dump_chunks": (lambda s, d: du.dump_chunks(dump_files(s, d)).select("file", "chunk", "start_ms", "end_ms", "keep_lo", "keep_hi", "text"), f"with {CHUNKS} select track file, chunk::int chunk, low start_ms, high end_ms, low keep_lo, case when chunk % 3 = 0 then case when chunk % 6 = 0 then high end when high < dur - 1 then low + 24000 end keep_hi, t as text from h where chunk % 4 <> 3"),
    "io06_dump_items": (lambda s, d: du.dump_items(du.dump_chunks(dump_files(s, d))), f"with {CHUNKS} select c.track file, c.chunk::int chunk, ((c.pos - 1) % 6)::int pos, text word, start_ms - low start_ms, end_ms - low end_ms from c join g using (track, chunk) where c.chunk % 4 <> 3 and c.pos % 5 > 0"),
    "io07_speech_regions": (lambda s, d: du.speech_regions(dump_files(s, d)), f"""with {DOC}, cues as (select track, start_ms, end_ms - 300 end_ms from cue_doc where track % 7 <> 6 and end_ms - 300 > start_ms),
a as (select *, max(end_ms) over (partition by track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from cues), b as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by track order by start_ms, end_ms rows unbounded preceding) island from a)
select track file, min(start_ms) start_ms, max(end_ms) end_ms from b group by track, island"""),
    "io08_reconciled_chunks": (chunk_sides, f"with {CHUNKS}, n as (select track, chunk, count(*)::int k from c group by all) select h.track file, h.chunk::int chunk, low start_ms, high end_ms, case when h.chunk % 5 = 4 then t else 'run:' || t end as text, case when h.chunk % 2 = 0 then k when h.chunk % 5 <> 4 then -1 end regions from h join n using (track, chunk) where h.chunk % 4 <> 3"),
    "io10_folder_digests": (lambda s, d: du.folder_digest(listing(s, d), "folder", "path", "n_chars"), f"with {LISTING}, j as (select folder, sha256(to_json({{'path': path, 'n_chars': n_chars}})) h from l) select folder, count(*) files, sha256(string_agg(h, ',' order by h)) digest from j group by folder"),
    "io12_ass_text": (lambda s, d: sub.ass_text(tr.paired(cue_doc(s, d), cue_alt(s, d))), f"with {ALT} select d.track, '{HEADER}' || chr(10) || string_agg({ASS_LINE}, chr(10) order by d.pos) || chr(10) as value from cue_doc d left join cue_alt a using (track, pos) group by d.track"),
    "io11_srt_rows": (lambda s, d: sub.srt_rows(cue_ev(s, d)), f"with {EV}, n as (select *, row_number() over (partition by track order by start_ms, end_ms, pos)::int n from cue_ev), f as (select *, list_transform([start_ms, end_ms], lambda m: {SRT}) t from n) select track, n, n || chr(10) || t[1] || ' --> ' || t[2] || chr(10) || text || chr(10) as value from f"),
    "io14_review_rows": (lambda s, d: du.review_rows(turns(s, d).filter("length(text) < 60").withColumn("text", F.md5("text"))), f"with {TURNS} select track, to_json({{'schema': 1, 'review_count': count(*), 'cues': list({{'pos': pos, 'role': role, 'text': md5(text)}} order by pos)}})::varchar as value from turns where length(text) < 60 group by track"),
    "io14_term_review": (issue_terms, f"""with {ALT}, {TERM_ROWS}, h as (select track, pos, source, target, forbidden from cue_doc join terms on contains(text, source)), k as (select * from h a where not exists (from h b where a.track = b.track and a.pos = b.pos and b.source <> a.source and contains(b.source, a.source))),
i as (select k.* from k join cue_alt a on a.track = k.track and a.pos = k.pos where len(list_filter(forbidden, lambda f: contains(a.text, f))) > 0), w as (select track, pos, unnest(forbidden) f from i)
select i.track, i.pos, string_agg(distinct source || '->' || target, ', ' order by source || '->' || target) expected, max(w.f) forbidden from i join (select track, pos, string_agg(distinct f, ', ' order by f) f from w group by all) w on w.track = i.track and w.pos = i.pos group by i.track, i.pos"""),
    "io15_event_lines": (lambda s, d: du.event_lines(table(s, d, "events").withColumn("job", F.when(F.col("user_id") % 3 > 0, F.col("user_id"))), F.col("event_type"), F.col("ts").cast("timestamp"), "job", "event_id"), "select to_json({'schema_version': 1, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', 'event': event_type, 'job': user_id, 'event_id': event_id})::varchar as value from events where user_id % 3 > 0 union all select to_json({'schema_version': 1, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', 'event': event_type, 'event_id': event_id})::varchar from events where user_id % 3 = 0"),
    "io16_named_inputs": (lambda s, d: du.named_inputs(table(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit(" =")).otherwise(F.concat("lang", F.lit(" ="))), F.lit("a.b/"), F.col("doc_id").cast("string"), F.lit(".x.srt")).alias("value"))), "select case when doc_id % 3 = 2 then lang else doc_id || '.x' end run, 'a.b/' || doc_id || '.x.srt' path from documents"),
    "io17_paired_files": (pairs_of_files, f"with {LISTING}, u as (select distinct regexp_replace(path, '\\.(old\\.|src\\.)?srt$', '') stem, case when path like '%.old.srt' then 'o' when path like '%.src.srt' then 's' else 'n' end kind from l), g as (select stem, bool_or(kind = 'n') n, bool_or(kind = 'o') o, bool_or(kind = 's') s from u group by stem) select stem, case when n then stem || '.new.srt' when o then stem || '.old.srt' end target, case when s then stem || '.src.srt' end source, case when not n and not o then 'no target' when not s then 'no source' end skipped from g"),
    "io19_cue_counts": (lambda s, d: sub.complete_pairs(sub.cue_counts(files(s, d)), sub.cue_counts(files(s, d).filter("file % 4 > 0"))), f"with {CUES}, n as (select track, count(*)::int n from k group by track) select track file, n cues, case when track % 4 > 0 then n end source_cues, track % 4 > 0 complete from n"),
    "io20_selected_parts": (lambda s, d: du.selected_parts(parts(s, d), samples(s, d))[0], "select source reference, doc_id id, n_chars from documents where doc_id % 3 = 0 and source is not null"),
    "io20_part_faults": (lambda s, d: du.selected_parts(parts(s, d), samples(s, d))[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "with p as (select doc_id id from documents where doc_id % 3 = 0 and source is not null union all select -doc_id - 1 from documents where doc_id % 50 = 0 and source is not null) select 'unknown' kind, count(*) n from p where id < 0"),
    "j15_left_to_do": (lambda s, d: ck.left_to_do(cue_doc(s, d).select("track", "pos", F.md5("text").alias("digest"), F.when(F.col("pos") % 2 == 0, F.col("end_ms")).alias("end_ms")), cue_alt(s, d).select("track", "pos", F.md5("text").alias("digest"), F.when(F.col("pos") % 2 == 0, F.col("end_ms") - 150).alias("end_ms")), ["track", "pos"], ["digest", "end_ms"]), f"with {ALT} select d.track, d.pos, md5(d.text) digest, case when d.pos % 2 = 0 then d.end_ms end end_ms, case when a.pos is null then 'new' else 'changed' end reason from cue_doc d left join cue_alt a using (track, pos) where a.pos is null or a.text <> d.text"),
}
