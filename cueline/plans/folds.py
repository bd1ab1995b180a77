"""Queries on rules that go from cue to cue, with SQL that takes one cue of every track a step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normal as nm
from ..operators import folds as fo
from ..operators import intervals as iv
from ..operators import replay as rp
from .reports import DOUBTFUL, doubtful, union_sql
from .views import DOC, EV, cue_alt, cue_doc, cue_ev

B = r"[\x20\x09-\x0D\x{3000}]+"
C = f"regexp_replace(text, '{B}', '', 'g')"
SHORT, GAP, CHARS = 12, 400, 80


def steps(source: str, columns: dict[str, tuple[str, str]], join: str, by: str = "track") -> str:
    """A recursive table ``f``: state after each row. columns: name to (first value of n's row, value if ``join`` holds); if it
    doesn't, the first value. ``f.`` is the state before, ``n.`` the row."""
    first = ", ".join(f"{v} {k}" for k, (v, _) in columns.items())
    then = ", ".join(f"case when {join} then {w} else {v} end {k}" for k, (v, w) in columns.items())
    return f"""n as (select *, row_number() over (partition by {by} order by start_ms, end_ms, pos) rn from {source}),
f as (select {by}, rn, {first} from n where rn = 1 union all select n.{by.replace(', ', ', n.')}, n.rn, {then} from f join n on {' and '.join(f'n.{k} = f.{k}' for k in by.split(', '))} and n.rn = f.rn + 1)"""


LAST = "qualify row_number() over (partition by track, pos order by rn desc) = 1"
MERGE = f"""with recursive {DOC}, {DOUBTFUL}, """ + steps("(select *, length(" + C + ") k from doubtful)", {
    "pos": ("n.pos", "f.pos"), "start_ms": ("n.start_ms", "f.start_ms"), "end_ms": ("n.end_ms", "greatest(f.end_ms, n.end_ms)"), "text": ("n.text", "f.text || n.text"), "k": ("n.k", "f.k + n.k"),
    "no_speech_prob": ("n.no_speech_prob", "greatest(f.no_speech_prob, n.no_speech_prob)"), "avg_logprob": ("n.avg_logprob", "least(f.avg_logprob, n.avg_logprob)"),
}, f"(least(f.k, n.k) <= {SHORT} and n.start_ms - f.end_ms <= {GAP} and f.k + n.k <= {CHARS})") + f" select track, pos, start_ms, end_ms, text, no_speech_prob, avg_logprob from f {LAST}"


def piled(spark, d):
    """Cues whose starts are rounded down to ten minutes, so several begin together; some collapsed, some of one source."""
    start, pos = F.col("start_ms") - F.col("start_ms") % 600_000, F.col("pos")
    return cue_ev(spark, d).select("track", "pos", start.alias("start_ms"), "end_ms", "text", (pos % 3 == 0).alias("collapsed"), F.when(pos % 2 == 0, F.col("text")).alias("source_text"))


PILED = f"{EV}, piled as (select track, pos, start_ms - start_ms % 600000 start_ms, end_ms, text, pos % 3 = 0 collapsed, case when pos % 2 = 0 then text end source_text from cue_ev)"
_near, _same = "n.start_ms - f.start_ms <= 50", "(f.source_text is not null and f.source_text is not distinct from n.source_text)"
_take = f"(not {_same} and f.collapsed and not n.collapsed)"
_keep = lambda c, joined="": f"case when {_take} then n.{c} when {_same} then {joined or 'f.' + c} else f.{c} end"
PILES = f"with recursive {PILED}, " + steps("piled", {
    "g": ("n.rn", "f.g"), "pos": ("n.pos", _keep("pos")), "start_ms": ("n.start_ms", _keep("start_ms")), "end_ms": ("n.end_ms", _keep("end_ms", "greatest(f.end_ms, n.end_ms)")),
    "text": ("n.text", _keep("text", "f.text || n.text")), "collapsed": ("n.collapsed", _keep("collapsed", "f.collapsed and n.collapsed")), "source_text": ("n.source_text", _keep("source_text")),
}, _near) + " select track, pos, start_ms, end_ms, text, collapsed from f qualify row_number() over (partition by track, g order by rn desc) = 1"

DEDUP = f"with recursive {DOC}, " + steps(f"(select *, {C} c from cue_doc where {C} <> '')", {"until": ("n.end_ms", "f.until"), "pos": ("n.pos", "n.pos"), "kept": ("true", "false")}, "n.start_ms - f.until <= 60000", "track, c") + " select d.* from f join cue_doc d using (track, pos) where kept"


def segments(spark, d):
    return cue_ev(spark, d).withColumn("end_reason", F.when(F.col("pos") % 3 == 0, F.lit("forced_max_speech")).otherwise(F.lit("silence")))


_cut = "(n.start_ms - f.end_ms > 60000 or n.end_ms - f.group_ms > 3600000)"
GROUPS = f"with recursive {EV}, " + steps("(select *, case when pos % 3 = 0 then 'forced_max_speech' else 'silence' end end_reason from cue_ev)", {
    "pos": ("n.pos", "n.pos"), "start_ms": ("n.start_ms", "n.start_ms"), "end_ms": ("n.end_ms", "n.end_ms"), "end_reason": ("n.end_reason", "n.end_reason"), "group_ms": ("n.start_ms", f"case when {_cut} then n.start_ms else f.group_ms end"),
    "reason": ("null::varchar", f"case when n.start_ms - f.end_ms > 60000 then 'silence_gap' when {_cut} then case when f.end_reason = 'forced_max_speech' then f.end_reason else 'forced_max_group' end else f.reason end"),
}, "n.rn > 1") + " select track, pos, group_ms, reason from f"

PACKED = f"with recursive {EV}, {union_sql('merged', 'cue_ev')}, " + steps("(select *, 0 pos from merged)", {"g": ("n.rn", "f.g"), "start_ms": ("n.start_ms", "f.start_ms"), "end_ms": ("n.end_ms", "n.end_ms")}, "(n.start_ms - f.end_ms <= 600000 and n.end_ms - f.start_ms <= 3600000)") + " select track, start_ms, end_ms from f qualify row_number() over (partition by track, g order by rn desc) = 1"


def finished(spark, d):
    """A track put in order: runaway repeats folded, piles and overlaps resolved, squeezed duplicates, fillers and short cues settled."""
    t = piled(spark, d).withColumn("text", F.concat("text", F.repeat(F.lit("la "), (F.col("pos") % 6).cast("int"))))
    return rp.finished_track(t, 0.9, 60_000, 60_000, 60_000, 300_000)


def echoed(spark, d):
    """Whether a line repeats the two lines before it."""
    w = Window.partitionBy("track").orderBy("pos")
    t = cue_doc(spark, d).withColumn("context", F.concat_ws("", F.lag("text", 2).over(w), F.lag("text").over(w)))
    return t.select("track", "pos", nm.echoes(F.col("text"), F.col("context")).alias("echo"))


def alike(spark, d):
    """Similarity of each line to its other run; both whole."""
    other = cue_alt(spark, d).select("track", "pos", F.col("text").alias("other"))
    return cue_doc(spark, d).join(other, ["track", "pos"]).select("track", "pos", F.round(nm.similarity("text", "other"), 6).alias("ratio"))


QUERIES = {
    "g01_merge_short": (lambda s, d: fo.merge_short(doubtful(s, d), SHORT, GAP, CHARS), MERGE),
    "g02_merge_close": (lambda s, d: fo.merge_close(cue_doc(s, d), 1500, 80, 12_000), None),
    "g03_same_start": (lambda s, d: fo.same_start_piles(piled(s, d)).drop("source_text"), PILES),
    "g04_squeezed_duplicates": (lambda s, d: fo.squeezed_duplicates(cue_doc(s, d), 2000, 0.7, 4000), None),
    "g05_windowed_dedup": (lambda s, d: fo.windowed_dedup(cue_doc(s, d), 60_000), DEDUP),
    "g06_capped_groups": (lambda s, d: fo.capped_groups(segments(s, d), 60_000, 3_600_000).select("track", "pos", "group_ms", "reason"), GROUPS),
    "g07_packed_clusters": (lambda s, d: fo.packed_clusters(iv.merge_intervals(cue_ev(s, d).select("track", "start_ms", "end_ms")).withColumn("pos", F.lit(0)), 600_000, 3_600_000).drop("pos"), PACKED),
    "g15_finished_track": (finished, None),
    "tx02_plain_texts": (lambda s, d: cue_doc(s, d).select("track", "pos", nm.nfc_plain("text").alias("plain")), rf"with {DOC} select track, pos, regexp_replace(nfc_normalize(text), '[\p{{P}}\s\x0B\x1C-\x1F\x85\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g') plain from cue_doc"),
    "tx11_folded_repeats": (lambda s, d: cue_doc(s, d).select("track", "pos", nm.fold_repeats(F.regexp_replace("text", "a", "aaaaab")).alias("folded")), None),
    "tx13_cores": (lambda s, d: cue_doc(s, d).select("track", "pos", nm.filler_core("text").alias("core")), None),
    "tx30_echoes": (echoed, None),
    "u05_similarity": (alike, None),
}
