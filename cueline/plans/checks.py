"""Queries on checks of outputs, timing rules, samples, pairs of runs and text rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import checks as ck
from ..operators import folds as fo
from ..operators import intervals as iv
from ..operators import pairs as pr
from ..operators import runs as rn
from ..operators import samples as sa
from ..operators import signals as sg
from ..operators import tracks as tr
from .reports import WORDS, words
from .views import ALT, DOC, SIGNAL, TURNS, cue_alt, cue_doc, cue_ev, signal_ev, table, turns


def records(spark, d):
    """Outputs of the lines of a document: two lines a record, with ids that repeat, are unknown, out of order or left out, blank texts and deletions."""
    pos = F.col("pos")
    t = cue_alt(spark, d).withColumn("number", F.floor(pos / 2))
    got = F.when(pos % 13 == 0, pos + 100_000).when(pos % 17 == 0, pos - 1).otherwise(pos)
    g = t.groupBy("track", "number").agg(F.sort_array(F.collect_list(got), asc=True).alias("ids"), F.min("pos").alias("pos"), F.max_by("text", "pos").alias("text"))
    ids = F.when(F.col("number") % 19 == 7, F.reverse("ids")).otherwise(F.col("ids"))
    text = F.when(F.col("number") % 7 == 3, F.lit(None)).when(F.col("number") % 23 == 5, F.lit("  ")).otherwise(F.concat(F.lit("x"), "text"))
    return g.select("track", "number", ids.cast("array<int>").alias("ids"), text.alias("text"))


RECORDS = f"""{ALT}, r0 as (select track, pos // 2 as number, case when pos % 13 = 0 then pos + 100000 when pos % 17 = 0 then pos - 1 else pos end id, pos, text from cue_alt),
r1 as (select track, number, list(id order by id) ids, arg_max(text, pos) t from r0 group by track, number),
records as (select track, number, case when number % 19 = 7 then list_reverse(ids) else ids end ids, case when number % 7 = 3 then null when number % 23 = 5 then '  ' else 'x' || t end as text from r1)"""
MAPPING = f"""with {RECORDS}, s as (select track, pos id, row_number() over (partition by track order by pos) place from cue_doc),
u as (select track, number, text is null gone, unnest(ids) id, unnest(range(len(ids))) k from records), v as (select u.*, place from u left join s using (track, id)),
i as (select track, id, count(*) n, bool_or(gone) gone from u group by all), b as (select coalesce(s.track, i.track) track, coalesce(s.id, i.id) id, place, n, gone from s full join i on s.track = i.track and s.id = i.id),
l as (select track, list(id order by id) filter (n is null) missing, list(id order by id) filter (place is null) un, list(id order by id) filter (n > 1) rep, list(id order by id) filter (gone) del from b group by track),
w as (select track, number, bool_and(place is not null) ok, list(place order by k) a from v group by all), x as (select track, bool_or(ok and a <> range(a[1], a[1] + len(a))) apart from w group by track),
y as (select track, bool_or(d < 0) falls from (select track, place - lag(place) over (partition by track order by number, k) d from v where place is not null) group by track),
z as (select track, bool_or(trim(text) = '') blank from records group by track),
o as (select l.*, concat_ws(',', case when blank then 'blank text' end, case when apart then 'merged ids apart' end, case when missing is not null then 'missing' end, case when un is not null then 'unknown' end, case when rep is not null then 'repeated' end, case when falls then 'reordered' end) issues from l left join x using (track) left join y using (track) left join z using (track))
select track, issues, issues = '' \"valid\", coalesce(array_to_string(missing, ','), '') missing, coalesce(array_to_string(un, ','), '') \"unknown\", coalesce(array_to_string(rep, ','), '') \"repeated\", coalesce(array_to_string(del, ','), '') \"deleted\" from o""".replace('\\"', '"')


def outputs(spark, d):
    """JSON outputs of the turns of a conversation: records of two, some with booleans, quoted times, other keys or wrong times; some no JSON."""
    t = clocked(spark, d).withColumn("n", F.floor(F.col("pos") / 2))
    g = t.groupBy("track", "n").agg(F.array_sort(F.collect_list("pos")).alias("ids"), F.min("start_ms").alias("start"), F.max("end_ms").alias("end"))
    n = F.col("n")
    ids = F.when(n % 9 == 4, F.lit("[true]")).when(n % 9 == 5, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")))
    start = F.when(n % 5 == 2, F.col("start") + 7).otherwise(F.col("start")).cast("string")
    start = F.when(n % 8 == 6, F.concat(F.lit('"'), start, F.lit('"'))).otherwise(start)
    more = F.when(n % 10 == 7, F.lit(', "note": 1')).otherwise(F.lit(""))
    rec = F.concat(F.lit('{"ids": '), ids, F.lit(', "text": '), F.when(n % 4 == 1, F.lit("null")).otherwise(F.lit('"a b"')), F.lit(', "start": '), start, F.lit(', "end": '), F.col("end").cast("string"), more, F.lit("}"))
    t = g.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", rec.alias("r")))), lambda x: x["r"]), ", ").alias("r"))
    raw = F.when(F.col("track") % 11 == 3, F.concat(F.lit("["), "r")).when(F.col("track") % 11 == 5, F.lit('{"a": 1}')).otherwise(F.concat(F.lit("["), "r", F.lit("]")))
    return t.select("track", raw.alias("raw"))


def clocked(spark, d):
    """Turns with times by length."""
    span = F.length("text") * 60 + 800
    t = turns(spark, d).withColumn("start_ms", F.coalesce(F.sum(span).over(Window.partitionBy("track").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.withColumn("end_ms", F.col("start_ms") + span)


CLOCKED = f"{TURNS}, clocked as (select *, coalesce(sum(length(text) * 60 + 800) over w, 0)::bigint start_ms, coalesce(sum(length(text) * 60 + 800) over w, 0)::bigint + length(text) * 60 + 800 end_ms from turns window w as (partition by track order by pos rows between unbounded preceding and 1 preceding))"
REC = f"{CLOCKED}, g as (select track, pos // 2 as n, list(pos order by pos) ids, min(start_ms) start_ms, max(end_ms) end_ms from clocked where track % 11 not in (3, 5) group by all), r as (select *, case when n % 10 = 7 then 'keys' when n % 9 in (4, 5) then 'ids' when n % 8 = 6 then 'times' else 'ok' end kind, (row_number() over (partition by track order by n))::int as number from g)"
SUMMARY = f"with {REC} select t.track, case t.track % 11 when 3 then 'invalid JSON' when 5 then 'no array' else 'ok' end form, count(r.n) records, count(*) filter (kind = 'keys') bad_keys, count(*) filter (kind = 'ids') bad_ids, count(*) filter (kind = 'times') bad_times, count(*) filter (kind = 'ok' and n % 5 = 2) time_claims from (select distinct track from turns) t left join r using (track) group by t.track"


def sources(spark, d):
    return clocked(spark, d).select("track", F.col("pos").alias("id"), "start_ms", "end_ms")


def blocks(spark, d):
    """Blocks of four lines and their outputs: some lines run away, leak kana, use a forbidden word; some blocks lack a line."""
    pos = F.col("pos")
    line = F.when(pos % 9 == 4, F.concat("text", F.lit("\u3042"))).when(pos % 10 == 6, F.concat("text", F.repeat(F.lit("ab"), 7))).otherwise(F.col("text"))
    t = cue_doc(spark, d).withColumns({"block": F.floor((pos - 1) / 4).cast("int"), "line": line})
    g = t.groupBy("track", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "line"))).alias("l"))
    lines = F.when(F.col("block") % 5 == 3, F.slice("l.line", 1, F.size("l") - 1)).otherwise(F.col("l.line"))
    return g.select("track", "block", F.col("l.text").alias("sources"), lines.alias("lines"))


def repeated_sql(cs: str, times: int) -> str:
    """Whether a unit of one to five characters stands so many times in a row in a list of characters: as many matches in a row of each character with the one that far
    behind it."""
    same = f"list_transform(range(1, len({cs}) - k + 1), lambda i: case when {cs}[i] = {cs}[i + k] then '1' else '0' end)"
    return f"len(list_filter([1, 2, 3, 4, 5], lambda k: contains(array_to_string({same}, ''), repeat('1', {times - 1} * k)))) > 0"


def degenerate_sql(s: str, x: str, cs: str) -> str:
    return f"(length({x}) > greatest(40, 3 * length({s}) + 10) or {repeated_sql(cs, 6)})"


REASON = "case when regexp_matches(x.line, '[\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}]') then 'kana-leak' when x.line <> '' and x.bad then 'degenerate' when contains(x.line, 'ting') then 'glossary' end".replace("\\\\", "\\")
CHECKED = f"""with {DOC}, a as (select *, (pos - 1) // 4 as block, case when pos % 9 = 4 then text || chr(12354) when pos % 10 = 6 then text || repeat('ab', 7) else text end line, row_number() over (partition by track, (pos - 1) // 4 order by pos) k, count(*) over (partition by track, (pos - 1) // 4) n from cue_doc),
b as (select *, {degenerate_sql('text', 'line', 'cs')} bad from (select *, string_split(line, '') cs from a)), c as (select x.*, {REASON} reason from b x)
select track, block, case when block % 5 = 3 then 'line-count:' || max(n) || '->' || (max(n) - 1) when count(reason) = 0 then 'accepted' else 'partial-' || string_agg(distinct reason, '+' order by reason) end status,
  case when block % 5 <> 3 then count(*) - count(reason) end kept from c group by track, block"""


def numbered(spark, d):
    """Requests of numbered lines answered: in order, out of order, with a gap, with a stray line."""
    g = turns(spark, d).groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.md5(x["text"])).alias("t"))
    lines = F.transform("t", lambda x, i: F.concat(F.lit("["), (i + F.when(F.col("track") % 5 == 3, i).otherwise(0) + 1).cast("string"), F.lit("] "), x))
    raw = F.array_join(F.when(F.col("track") % 4 == 1, F.reverse(lines)).otherwise(lines), "\n")
    raw = F.when(F.col("track") % 7 == 5, F.concat(raw, F.lit("\nSure!"))).otherwise(raw)
    return g.select("track", F.array_join(ck.numbered_lines(raw, F.size("t")), ",").alias("texts"))


def paired_turns(spark, d):
    """Turns as translations of the turn before, some empty, some runaway, some of sounds only."""
    pos = F.col("pos")
    t = turns(spark, d).withColumn("source_text", F.when(pos % 5 == 2, F.lit("ああんっ")).when(pos % 7 == 3, F.repeat(F.lit("ha"), 8)).otherwise(F.col("text")))
    return t.withColumn("text", F.when(pos % 4 == 1, F.lit(" ")).when(pos % 6 == 5, F.repeat(F.lit("ha"), 9)).when(pos % 11 == 7, F.concat("text", F.lit("\u30A2"))).otherwise(F.col("text"))).drop("role")


REVIEW = rf"""with {TURNS}, p as (select track, pos, case when pos % 5 = 2 then 'ああんっ' when pos % 7 = 3 then repeat('ha', 8) else text end s, case when pos % 4 = 1 then ' ' when pos % 6 = 5 then repeat('ha', 9) when pos % 11 = 7 then text || chr(12450) else text end t from turns),
q as (select *, trim(t) = '' e, regexp_matches(t, '[\x{{3041}}-\x{{3096}}\x{{30A1}}-\x{{30FA}}]') k, {degenerate_sql('s', 't', 'tc')} g, s = 'ああんっ' v, {repeated_sql('sc', 4)} r from (select *, string_split(s, '') sc, string_split(t, '') tc from p)),
o as (select *, concat_ws(',', case when e then 'empty' end, case when k then 'kana_residue' end, case when g then 'degenerate' end) issues, case when not (e or k or g) then 'accepted' when v then 'phonetic_fallback' when e or g then case when not e and r and length(t) <= greatest(20, 3 * length(s)) then 'retained_source_repetition' else 'review_placeholder' end else 'retained_for_review' end act from q)
select track, pos, issues, act \"action\", case act when 'phonetic_fallback' then '啊啊嗯' when 'review_placeholder' then '{ck.PLACEHOLDER}' else t end \"output\" from o""".replace('\\"', '"')


def collapsed_words(spark, d):
    return words(spark, d).filter("chunk % 2 = 1")


def chunk_regions(spark, d):
    """Speech of a chunk: its lines but every third, in time of the chunk."""
    return words(spark, d).filter("pos % 3 <> 0 and end_ms > start_ms").select("track", "chunk", "start_ms", "end_ms")


def merged_regions(spark, d):
    return iv.merge_intervals(chunk_regions(spark, d), ["track", "chunk"])


REGIONS = f"""{WORDS}, ra as (select *, max(end_ms) over (partition by track, chunk order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from words where pos % 3 <> 0 and end_ms > start_ms), rb as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by track, chunk order by start_ms, end_ms rows unbounded preceding) island from ra),
regions as (select track, chunk, min(start_ms) start_ms, max(end_ms) end_ms from rb group by track, chunk, island), cum as (select *, sum(end_ms - start_ms) over (partition by track, chunk order by start_ms)::bigint t from regions)"""
_real = "case when greatest({c}, 1) > tot then lastend else (select c.start_ms + {c} - (c.t - (c.end_ms - c.start_ms)) from cum c where c.track = x.track and c.chunk = x.chunk and greatest({c}, 1) > c.t - (c.end_ms - c.start_ms) and greatest({c}, 1) <= c.t) end"
SPREAD = f"""with {REGIONS}, w as (select track, chunk, pos, word, greatest(1, length(word)) n from words where chunk % 2 = 1), v as (select *, sum(n) over (partition by track, chunk order by pos) upto, sum(length(word)) over p chars, count(*) over p cnt from w window p as (partition by track, chunk)),
x as (select v.*, tot, lastend, round_even((upto - n) * tot / case when chars > 0 then chars else cnt end, 0)::bigint a, round_even(upto * tot / case when chars > 0 then chars else cnt end, 0)::bigint b from v join (select track, chunk, max(t) tot, max(end_ms) lastend from cum group by all) using (track, chunk)),
y as (select track, chunk, pos, word, {_real.format(c='a')} s, {_real.format(c='b')} e from x)
select track, chunk, pos, word, s start_ms, case when e <= s then s + 20 else e end end_ms from y"""
ANCHOR = f"""with {WORDS}, w as (select *, greatest(1, length(word)) n from words where chunk % 2 = 1), v as (select *, sum(n) over (partition by track, chunk order by pos) upto, sum(length(word)) over p chars, count(*) over p cnt, first_value(start_ms) over (partition by track, chunk order by pos) anchor from w window p as (partition by track, chunk)),
t as (select *, case when chars > 0 then chars else cnt end al from v), u as (select *, al * 1000.0::double / 10 want, least(anchor + al * 1000.0::double / 10, scene_ms::double) en from t),
x as (select *, case when anchor + want > scene_ms and scene_ms - anchor < want * 0.5 then greatest(0.0, scene_ms - want) else anchor::double end st from u), y as (select *, case when en <= st then 0.0 else st end s, case when en <= st then scene_ms::double else en end e from x),
z as (select *, s + (upto - n) / al * (e - s) a, s + upto / al * (e - s) b from y)
select track, chunk, pos, word, round_even(a, 0)::bigint start_ms, round_even(case when b <= a then a + 20 else b end, 0)::bigint end_ms from z"""
TIMED = "regexp_extract_all(translate({t}, '" + tx.UNTIMED.replace("'", "''") + "', ''), '(?s).')"
CHARACTERS = f"""with {REGIONS}, t as (select track, chunk, string_agg(word, '' order by pos) s from words group by all), c as (select *, {TIMED.format(t='s')} cs from t), k as (select track, chunk, unnest(cs) ch, unnest(range(len(cs))) k, len(cs) n from c),
x as (select k.*, floor(tot * 1000 * k / n)::bigint a, floor(tot * 1000 * (k + 1) / n)::bigint b from k join (select track, chunk, max(t) tot from cum group by all) using (track, chunk)),
y as (select x.*, c.start_ms * 1000 + a - (c.t - (c.end_ms - c.start_ms)) * 1000 s, case when b <= c.t * 1000 then c.start_ms * 1000 + b - (c.t - (c.end_ms - c.start_ms)) * 1000 else c.end_ms * 1000 end e from x join cum c on c.track = x.track and c.chunk = x.chunk and greatest(a, 1) > (c.t - (c.end_ms - c.start_ms)) * 1000 and greatest(a, 1) <= c.t * 1000)
select track, chunk, k::int k, ch, s // 1000 start_ms, greatest(s, e) // 1000 end_ms from y"""
ITEMS = f"""with {WORDS}, c as (select *, {TIMED.format(t='word')} cs from words), k as (select track, chunk, pos, start_ms, end_ms, len(cs) n, unnest(cs) ch, unnest(range(len(cs))) k from c),
x as (select *, (end_ms - start_ms) / n per from k), y as (select *, case when end_ms <= start_ms then 0.0 when per > 200 then 200.0 else per end pace, case when per > 200 then end_ms - n * 200.0 else start_ms::double end base from x)
select track, chunk, pos, k::int k, ch, round(base + k * pace, 3) start_ms, round(base + (k + 1) * pace, 3) end_ms from y"""

SEGMENTS = f"""with recursive {SIGNAL}, sizes as (select track, max(frame) + 1 size from signal group by track),
f as (select track, frame, prob >= 0.5 trig, frame start, null::int t, null::int done_s, null::int done_e from signal where frame = 0
 union all select n.track, n.frame, case when f.trig and n.prob < 0.35 and n.frame - coalesce(f.t, n.frame) >= 2 then false when n.prob >= 0.5 then true else f.trig end,
  case when not f.trig and n.prob >= 0.5 then n.frame else f.start end, case when n.prob >= 0.5 then null when f.trig and n.prob < 0.35 and n.frame - coalesce(f.t, n.frame) >= 2 then null when f.trig and n.prob < 0.35 then coalesce(f.t, n.frame) else f.t end,
  case when f.trig and n.prob < 0.35 and n.frame - coalesce(f.t, n.frame) >= 2 then f.start end, case when f.trig and n.prob < 0.35 and n.frame - coalesce(f.t, n.frame) >= 2 then coalesce(f.t, n.frame) end
  from f join signal n on n.track = f.track and n.frame = f.frame + 1),
s as (select track, done_s a, done_e b, 'silence' reason from f where done_s is not null union all select f.track, start, size, 'series_end' from f join sizes on sizes.track = f.track and f.frame = size - 1 where trig),
k as (select s.*, size from s join sizes using (track) where b - a >= 2), p as (select *, least(coalesce(lead(a) over (partition by track order by a), size), b + 1) e from k)
select track, greatest(coalesce(lag(e) over (partition by track order by a), 0), a - 1) as start, e as \"end\", reason from p""".replace('\\"', '"')


CAPPED = f"""with recursive {SIGNAL}, sizes as (select track, max(frame) + 1 size from signal group by track),
f as (select track, frame, case when prob >= 0.4 then frame end start, null::int q, null::int a, null::int b, null::varchar reason from signal where frame = 0
 union all select track, frame, case when cut or done then null when s is null and prob >= 0.4 then frame else s end, case when cut or done or s is null or prob >= 0.4 then null when prob < 0.25 then coalesce(q, frame) else q end,
  case when cut or done then s end, case when cut then s + 4 when done then q end, case when cut then 'forced_max_speech' when done then 'silence' end
  from (select n.track, n.frame, n.prob, f.start s, f.q, f.start is not null and n.frame - f.start > 4 cut, f.start is not null and n.frame - f.start <= 4 and n.prob < 0.25 and n.frame - coalesce(f.q, n.frame) >= 2 done from f join signal n on n.track = f.track and n.frame = f.frame + 1)),
s as (select track, a, b, reason from f where reason is not null union all select f.track, start, size, 'series_end' from f join sizes on sizes.track = f.track and f.frame = size - 1 where start is not null)
select track, a as start, b as \"end\", reason from s where reason = 'forced_max_speech' or b - a >= 2""".replace('\\"', '"')


def timed_sources(spark, d):
    """Events against streams of their texts' characters that lack every seventh and change every fifth."""
    e, k = cue_ev(spark, d).withColumnsRenamed({"pos": "chunk", "text": "word"}).withColumn("pos", F.lit(0)), F.col("k")
    c = sg.item_characters(e, 2000).filter(k % 7 != 3).withColumn("ch", F.when(k % 5 == 2, F.lit("#")).otherwise(F.col("ch")))
    a = c.groupBy("track", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ch", "start_ms", "end_ms"))), lambda x: F.struct(x["ch"].alias("ch"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("aligned"))
    t = e.filter(tx.n_timed(F.col("word")) > 0).join(a, ["track", "chunk"], "left").select("track", "chunk", sg.source_times("word", "aligned").alias("t"))  # those with characters
    return t.select("track", "chunk", F.size("t").alias("characters"), F.round(F.element_at("t.end_ms", -1), 3).alias("end_ms"))


def frames(spark, d):
    """Vectors in order as frames of four tracks, with labels and an energy."""
    t = table(spark, d, "embeddings")
    return t.select((F.col("vec_id") % 4).alias("track"), F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("label") % 3).alias("label"), F.abs(F.element_at("embedding", 1)).cast("double").alias("energy"))


SCENES = """with f as (select vec_id % 4 track, vec_id // 4 as frame, label % 3 as label, abs(embedding[1])::double energy from embeddings), c as (select track, frame place from (select *, lag(label) over (partition by track order by frame) p from f) where label <> p),
m as (select c.track, c.place, arg_min(frame, {'e': energy, 'f': frame}) start from c join f on f.track = c.track and f.frame >= place - 3 and f.frame < place + 3 group by all), b as (select distinct track, start from m union select track, min(frame) from f group by track)
select b.track, start, coalesce(lead(start) over (partition by b.track order by start), hi) as "end" from b join (select track, max(frame) + 1 hi from f group by track) using (track)"""


def candidates(spark, d):
    return rn.tumbling(cue_doc(spark, d), 60_000).select("track", "window").filter("window % 4 <> 3")


def seen(spark, d):
    return cue_doc(spark, d).filter("pos % 40 = 39").select("track", "start_ms", F.col("end_ms"))


def ends(spark, d):
    return cue_doc(spark, d).groupBy("track").agg(F.max("end_ms").alias("duration_ms"))


GROUP, GUARD = 60_000, 5_000


def windows(spark, d):
    return sa.dialogue_windows(cue_doc(spark, d), ends(spark, d), seen(spark, d), GROUP, GUARD, 2_000)


def splits(spark, d):
    return sa.group_splits(windows(spark, d), seen(spark, d), 1, 7, GROUP, GUARD)


WINDOWS = f"""{DOC}, du as (select track, max(end_ms) dur from cue_doc group by track), near as (select track, greatest(0, start_ms - {GUARD}) a, end_ms + {GUARD} b from cue_doc where pos % 40 = 39),
w0 as (select c.track, pos, (start_ms - 500) // {GROUP} g, start_ms - 500 f, dur from cue_doc c join du using (track)), w1 as (select *, g * {GROUP} lo, least((g + 1) * {GROUP}, dur) hi from w0), w2 as (select * from w1 where f >= lo + {GUARD} and f < hi - {GUARD} - 20000),
w3 as (select w.track, w.pos, g, f, hi, count_if(length(c.text) >= 5) n, max(c.end_ms) l from w2 w join cue_doc c on c.track = w.track and c.end_ms > f and c.start_ms < f + 20000 group by all),
w4 as (select distinct track, g, f, greatest(f + 15000, l + 500) e, hi from w3 where n >= 2), windows as (select track, g::bigint as \"group\", f start_ms, e end_ms from w4 where e - f <= 35000 and e + 2000 <= hi - {GUARD} and not exists (from near where near.track = w4.track and e + 2000 > a and f - 2000 < b))""".replace('\\"', '"')
SPLITS = f"""{WINDOWS}, gr as (select distinct track, \"group\" g from windows), fresh as (select *, row_number() over (partition by track order by md5('7:' || track || ':' || g), g) r from gr where not exists (from near where near.track = gr.track and (g + 1) * {GROUP} > a and g * {GROUP} < b)),
splits as (select gr.track, gr.g as \"group\", case when r <= 1 then 'heldout' else 'development' end split from gr left join fresh using (track, g))""".replace('\\"', '"')
HINTS = {"the": "the|der", "stop": r"\.$", "comma": ","}


def hinted(spark, d):
    return sa.hinted_windows(cue_doc(spark, d), splits(spark, d), HINTS, 8_000, 12_000, GROUP, GUARD, 4, 2)


HINTED = f"""with {SPLITS}, t0 as (select distinct c.track, (start_ms - 500) // {GROUP} g, start_ms - 500 f from cue_doc c), t1 as (select t0.*, split from t0 join splits s on s.track = t0.track and s.\"group\" = t0.g where f - 8000 >= g * {GROUP} + {GUARD} and f + 20000 <= (g + 1) * {GROUP} - {GUARD}),
t2 as (select t.track, g, split, f, count_if(length(text) >= 5) cn, count_if(length(text) >= 5 and end_ms > f and start_ms < f + 12000) fn, bool_or(end_ms > f and start_ms < f + 12000 and regexp_matches(text, 'the|der')) h1, bool_or(end_ms > f and start_ms < f + 12000 and regexp_matches(text, '\\.$')) h2, bool_or(end_ms > f and start_ms < f + 12000 and contains(text, ',')) h3 from t1 t join cue_doc c on c.track = t.track and end_ms > f - 8000 and start_ms < f + 20000 group by all)
select track, g::bigint as \"group\", split, f start_ms, f + 12000 end_ms, concat_ws(',', case when h1 then 'the' end, case when h2 then 'stop' end, case when h3 then 'comma' end) hints from t2 where cn >= 4 and fn >= 2 and h1::int + h2::int + h3::int >= 2""".replace('\\"', '"')


def chosen(spark, d):
    """Windows chosen of turns: four in a row, with a gap, out of order, or unknown."""
    t = turns(spark, d).filter("pos between 1 and 4")
    ids = F.when((F.col("track") % 5 == 1) & (F.col("pos") == 4), F.col("pos") + 1).when((F.col("track") % 5 == 2) & (F.col("pos") == 2), F.lit(900)).otherwise(F.col("pos"))
    return t.select("track", ids.alias("id"), F.when(F.col("track") % 5 == 3, -F.col("pos")).otherwise(F.col("pos")).alias("n"))


def focussed(spark, d):
    return turns(spark, d).select("track", F.col("pos").alias("id"), "pos", F.col("pos").isin(2, 3).alias("focus"), (F.length("text") % 9 > 0).alias("eligible"))


CONTIGUOUS = f"""with {TURNS}, c as (select track, pos id, row_number() over (partition by track order by pos) place, pos in (2, 3) focus, length(text) % 9 > 0 eligible from turns),
h as (select track, case when track % 5 = 1 and pos = 4 then 5 when track % 5 = 2 and pos = 2 then 900 else pos end id, case when track % 5 = 3 then -pos else pos end n from turns where pos between 1 and 4), j as (select h.*, place, focus, eligible, place - lag(place) over (partition by h.track order by n) step from h left join c using (track, id)),
a as (select track, count(*) n, count(distinct id) u, bool_or(place is null) unk, coalesce(bool_or(step <> 1), false) apart, count(*) filter (focus) fo, coalesce(bool_and(eligible), false) el from j group by track), f as (select track, count(*) filter (focus) al, count(*) filter (focus and not eligible) odd from c group by track),
o as (select a.track, concat_ws(',', case when al = 0 or odd > 0 then 'uncertain focus' end, case when n < 3 or u < n then 'too few' end, case when unk then 'unknown' end, case when apart then 'apart' end, case when fo < al then 'focus left out' end, case when not el then 'uncertain context' end) failed from a join f using (track))
select track, failed = '' accepted, failed from o"""


def rewritten(spark, d):
    """TX-12, 15, 16, 19, 24, 26, 35 and others on every line: rewrites that SQL has no words for; compared with plain versions in the tests."""
    x = F.col("text")
    return cue_doc(spark, d).select("track", "pos", F.size(tx.sentences(x, 20, ".!?", ",")).alias("sentences"), F.size(tx.length_pieces(x)).alias("pieces"), tx.latin_safe(F.lit("x"), x).alias("safe"), tx.asr_clean(x).alias("clean"), tx.answer(F.concat(F.lit("<target>"), x, F.lit("</target>"))).alias("answer"))


SIMPLE = {"table": {"a": "4", "e": "3"}, "words": {"the": "ze", "then": "zen"}}


def converted(spark, d):
    """TX-05, 09, 12, 19, 22, 25, 26, 31, 32 and TX-03 on every line."""
    x, pos = F.col("text"), F.col("pos")
    wrapped = tx.wrap_at_blanks(x, 40)
    return cue_doc(spark, d).select(
        "track", "pos", tx.phrase_key(x).alias("key"), tx.contains_any(x, ["ing", "und"]).alias("listed"), tx.exceeds(F.when(pos % 3 > 0, pos / 10.0), 0.7).alias("exceeds"), tx.n_timed(x).alias("timed"),
        tx.overlong(wrapped, 60).alias("overlong"), tx.short_context(x, ["oui", "ja"]).alias("short"), tx.voiced(F.when(pos % 4 == 0, F.lit("あーっ、んふ")).when(pos % 4 == 1, F.lit("うん")).otherwise(x)).alias("voiced"), tx.converted(x, SIMPLE["table"], SIMPLE["words"]).alias("converted"),
        tx.alias_of(F.when(pos % 5 == 0, F.lit(" ")).when(pos % 5 == 1, F.lit(" JA ")).otherwise(F.lit("Xy")), {"ja": "Japanese"}, "none").alias("language"), tx.class_of(pos % 10 / 10.0, pos % 7 / 10.0, ("M", "F"), 0.5).alias("voice"),
    )


CONVERTED = rf"""with {DOC}, t as (select *, regexp_replace(text, '[\x20\x09-\x0D\x{{3000}}]+', '', 'g') c from cue_doc), m as (select *, regexp_extract_all(text, '(?s).') cs from t),
w as (select *, list_min(list_transform(list_filter(range(1, len(cs)), lambda i: cs[i] = ' '), lambda i: {{'o': i - 1 > 40 or len(cs) - i > 40, 'd': abs(2 * i - len(cs)), 'i': i}})) b from m),
v as (select *, case when length(text) <= 40 or b is null then text else substr(text, 1, b.i - 1) || chr(10) || substr(text, b.i + 1) end wr from w)
select track, pos, trim(c, '{tx.EDGE}') as \"key\", contains(text, 'ing') or contains(text, 'und') listed, coalesce(case when pos % 3 > 0 then pos / 10.0 end >= 0.7, false) exceeds, length(translate(text, '{tx.UNTIMED}', ''))::int timed,
  len(list_filter(string_split(wr, chr(10)), lambda l: length(l) > 60)) > 0 overlong, length(c) <= 2 or translate(c, '、。！？!?…ー〜・-.', '') = '' or c in ('oui', 'ja') short, case when pos % 4 = 0 then '啊…、嗯呼' end voiced,
  translate(replace(replace(text, 'then', 'zen'), 'the', 'ze'), 'ae', '43') converted, case pos % 5 when 0 then 'none' when 1 then 'Japanese' else 'Xy' end as \"language\", case when greatest(pos % 10 / 10.0, pos % 7 / 10.0) < 0.5 then null when pos % 10 >= pos % 7 then 'M' else 'F' end voice from v""".replace('\\"', '"')


def unblind(spark, d):
    """Labels as votes on documents, sides by id."""
    t = table(spark, d, "documents")
    left = F.col("doc_id") % 2 == 0
    mapping = t.select(F.col("doc_id").alias("item"), (F.col("doc_id") % 4).alias("video"), F.when(left, F.lit("new")).otherwise(F.lit("old")).alias("A"), F.when(left, F.lit("old")).otherwise(F.lit("new")).alias("B"))
    vote = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("A")).when(F.col("toxic") == 1, F.lit("B")).otherwise(F.lit("tie"))
    return tr.unblinded(mapping, table(spark, d, "labels").select(F.col("doc_id").alias("item"), vote.alias("vote")))


VOTES = """with v as (select doc_id item, case when quality = 1 and toxic = 0 then 'A' when toxic = 1 then 'B' else 'tie' end vote from labels), m as (select doc_id item, doc_id % 4 video, case when doc_id % 2 = 0 then 'new' else 'old' end a, case when doc_id % 2 = 0 then 'old' else 'new' end b from documents),
u as (select video, case vote when 'A' then a when 'B' then b when 'tie' then 'tie' end run from m left join v using (item)), t as (select video, count(*) filter (run = 'new') wins, count(*) filter (run = 'old') losses, count(*) filter (run = 'tie') ties, count(*) filter (run is null) unvoted from u group by rollup (video)),
p as (select *, wins + losses n, least(wins, losses) k from t)
select video, wins, losses, ties, unvoted, round(case when n = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) end, 6) p from p"""

def in_regions(spark, d):
    """Lines with the region of 30 s that holds their middle; every fifth such region is no speech, so its lines are orphans."""
    c = cue_doc(spark, d)
    r = iv.tiles(ends(spark, d), 30_000, 0).filter("tile % 5 <> 4").select("track", "start_ms", "end_ms")
    return c.join(rn.first_region(c, r), ["track", "pos"]).select(*c.columns, "region_ms")


def spells(spark, d):
    """Events by kind and spell of three hours as short tracks."""
    return cue_ev(spark, d).withColumn("track", F.concat("track", F.lit("/"), F.floor(F.col("start_ms") / 10_800_000).cast("string"))).withColumn("text", F.concat("text", F.repeat(F.col("text"), F.col("pos") % 3)))


def second(spark, d):
    """Another run of the spells: every third cue comes in two halves, every seventh is left out."""
    half = F.floor(F.length("text") / 2).cast("int")
    t = spells(spark, d).filter("pos % 7 <> 6").withColumn("_cut", F.when(F.col("pos") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))))
    t = t.select("*", F.explode("_cut").alias("k"), half.alias("h"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("m"))
    k = F.col("k")
    text = F.when(k == 0, F.substr("text", F.lit(1), F.col("h"))).when(k == 1, F.substr("text", F.col("h") + 1)).otherwise(F.col("text"))
    return t.select("track", (F.col("pos") * 2 + F.when(k == 1, 1).otherwise(0)).alias("pos"), F.when(k == 1, F.col("m")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(k == 0, F.col("m")).otherwise(F.col("end_ms")).alias("end_ms"), text.alias("text"))


QUERIES = {
    "tx_converted": (converted, CONVERTED),
    "tx_rewritten": (rewritten, None),
    "a14_tally": (lambda s, d: tr.tally(unblind(s, d), "video", "new", "old"), VOTES),
    "j17_id_mapping": (lambda s, d: ck.id_mapping(cue_doc(s, d).select("track", F.col("pos").alias("id"), "pos"), records(s, d)), MAPPING),
    "j18_checked_lines": (lambda s, d: ck.checked_lines(blocks(s, d), F.array(F.lit("ting"))).select("track", "block", "status", F.when(~F.startswith("status", F.lit("line-count")), F.size(F.array_compact("checked")).cast("long")).alias("kept")), CHECKED),
    "j20_differing_windows": (lambda s, d: pr.differing_windows(cue_doc(s, d), cue_alt(s, d), 20_000, 8, 0.97), None),
    "v01_json_summary": (lambda s, d: ck.json_records(outputs(s, d), sources(s, d))[0], SUMMARY),
    "v01_json_records": (lambda s, d: ck.json_records(outputs(s, d), sources(s, d))[1].withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")), f"with {REC} select track, number, array_to_string(ids, ',') ids, case when n % 4 <> 1 then 'a b' end as text, start_ms, end_ms from r where kind = 'ok'"),
    "v02_numbered_lines": (numbered, f"with {TURNS}, g as (select track, list(md5(text) order by pos) t from turns group by track) select track, case when track % 7 <> 5 and (track % 5 <> 3 or len(t) = 1) then array_to_string(t, ',') end texts from g"),
    "v03_reviewed": (lambda s, d: ck.reviewed(paired_turns(s, d)).select("track", "pos", "issues", "action", "output"), REVIEW),
    "w13_spread_words": (lambda s, d: sg.spread_words(collapsed_words(s, d), merged_regions(s, d)), SPREAD),
    "w13_spread_from_anchor": (lambda s, d: sg.spread_from_anchor(collapsed_words(s, d).drop("scene_ms"), words(s, d).groupBy("track", "chunk").agg(F.max("scene_ms").alias("scene_ms"))), ANCHOR),
    "w14_region_characters": (lambda s, d: sg.region_characters(words(s, d).groupBy("track", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("word").alias("w")))), lambda x: x["w"]), "").alias("text")), merged_regions(s, d)), CHARACTERS),
    "w15_frame_cues": (lambda s, d: sg.frame_cues(cue_doc(s, d)), None),
    "w16_item_characters": (lambda s, d: sg.item_characters(words(s, d), 200), ITEMS),
    "w18_speech_segments": (lambda s, d: sg.speech_segments(signal_ev(s, d), 0.5, 2, 2, 1), SEGMENTS),
    "w18_capped_segments": (lambda s, d: sg.capped_segments(signal_ev(s, d), 4, 0.4, 2, 2), CAPPED),
    "w17_source_times": (timed_sources, None),
    "w18_smoothed": (lambda s, d: sg.smoothed(signal_ev(s, d), "prob").select("track", "frame", F.round("smooth", 9).alias("smooth")), f"with {SIGNAL} select track, frame, round(case when count(*) over (partition by track) < 3 then prob else (prob + coalesce(lag(prob) over w, prob) + coalesce(lag(prob, 2) over w, lag(prob) over w, prob) + coalesce(lead(prob) over w, prob) + coalesce(lead(prob, 2) over w, lead(prob) over w, prob)) / 5 end, 9) smooth from signal window w as (partition by track order by frame)"),
    "w19_scenes": (lambda s, d: sg.scenes(frames(s, d), 3), SCENES),
    "w22_repeated_outputs": (lambda s, d: ck.repeated_outputs(turns(s, d).withColumns({"source_text": F.md5("text"), "text": F.substr(F.md5("text"), F.lit(1), F.lit(1))})).select("track", "pos", "text"), f"with {TURNS}, t as (select track, pos, substr(md5(text), 1, 1) t, md5(text) s from turns), u as (select *, lag(t) over w pt, lag(s) over w ps from t window w as (partition by track order by pos)) select track, pos, t as text from u where t = pt and s <> ps"),
    "tx35_requests": (lambda s, d: turns(s, d).groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("t")).select("track", ck.request(F.lit(""), F.concat_ws(", ", F.lit("a->b")), F.col("t")).alias("request")), f"with {TURNS}, n as (select *, row_number() over (partition by track order by pos) n from turns) select track, 'Terms:' || chr(10) || 'a->b' || chr(10) || chr(10) || 'Lines:' || chr(10) || string_agg('[' || lpad(n::varchar, 3, '0') || '] ' || replace(text, chr(10), ' '), chr(10) order by n) request from n group by track"),
    "s03_spaced_sample": (lambda s, d: sa.spaced_sample(candidates(s, d), 40, 11), None),
    "s05_jittered_anchors": (lambda s, d: sa.jittered_anchors(ends(s, d), (0.2, 0.5, 0.8), 3000, 5), f"with {DOC}, e as (select track, max(end_ms) dur from cue_doc group by track), a as (select track, dur, unnest([0, 1, 2])::int anchor, unnest([0.2::double, 0.5::double, 0.8::double]) sh from e) select track, anchor, greatest(0, least(dur, floor(dur * sh)::bigint + ('0x' || substr(md5('5:' || track || ':' || anchor), 1, 8))::bigint % 6001 - 3000))::bigint at_ms from a"),
    "s06_dialogue_windows": (windows, f"with {WINDOWS} select * from windows"),
    "s06_group_splits": (splits, f"with {SPLITS} select * from splits"),
    "s06_separated": (lambda s, d: sa.separated(windows(s, d).join(splits(s, d), ["track", "group"]), 10_000, 3, ("start_ms", "end_ms")), None),
    "s07_hinted_windows": (hinted, HINTED),
    "s08_contiguous_windows": (lambda s, d: sa.contiguous_windows(focussed(s, d), chosen(s, d)), CONTIGUOUS),
    "j05_merged_in_regions": (lambda s, d: fo.merge_close_in_regions(in_regions(s, d), 1500, 80, 12_000), None),
    "g14_cue_groups": (lambda s, d: pr.cue_groups(spells(s, d), second(s, d)), None),
    "a13_comparison": (lambda s, d: pr.comparison(spells(s, d), second(s, d)), None),
}
