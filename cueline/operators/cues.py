"""Cues from texts and their aligned characters: a stream of timed characters, cut by pauses and budgets, without runs of fillers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fragments import WIDEST_MS, belongs, filler_runs, filler_signs
from ..functions.text import SENTENCE_ENDS, WHITE_SPACE
from .signals import item_characters, source_times
from .units import Made, Units, item_times, over_units, sums, table

KEYS = ("track", "chunk")
#: Marks after which a cue is cut best; the shortest pause to cut at and the one that makes an ellipsis an end, in milliseconds; the longest
#: span of a cue that has no time of its own.
BREAKS, PAUSE_MS, ELLIPSIS_MS, POINT_MS = "。、，,！？!?…．", 120, 400, 1
#: Characters that are looked at behind a pause.
AHEAD = 8


def character_stream(texts: DataFrame, items: DataFrame, most_ms: float, authoritative: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """The times of the characters of each chunk in order, as lists: those of its items (``item_times``), or, if the text is authoritative, ``starts, ends`` of
    every timed character of the text (``source_times``)."""
    if not authoritative:
        return item_times(items, most_ms, keys)
    if "choice" in items.columns:
        items = items.withColumn("_least", F.min("choice").over(Window.partitionBy(*keys))).filter("choice = _least")
    lists = item_characters(items, most_ms, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "k", "ch", "start_ms", "end_ms"))).alias("_a"))  # of one chunk
    times = texts.join(lists, list(keys), "left").select(*keys, source_times("text", F.transform("_a", lambda x: F.struct(x["ch"], x["start_ms"], x["end_ms"]))).alias("_t"))
    return times.select(*keys, *[F.transform("_t", lambda x: x[c]).alias(n) for c, n in (("start_ms", "starts"), ("end_ms", "ends"))])  # noqa: B023


def breaks(u: Units) -> np.ndarray:
    """Whether a cue may end behind a token, by its marks."""
    return u.count(BREAKS, u.place + 1, u.end) > 0


def _firsts(u: Units) -> np.ndarray:
    """Which tokens are the first of their unit."""
    out = np.zeros(len(u.i), bool)
    out[u.lo[u.hi > u.lo]] = True
    return out


def cut_at_pauses(u: Units, usual_ms: float, ellipses_end: bool) -> np.ndarray:
    """First tokens of the segments of units: cut at pauses longer than usual that are not inside a phrase (``belongs``) and, unless ellipses end sentences anyway, at shorter
    ones behind an ellipsis. Only pauses are looked at one by one."""
    new = _firsts(u)
    gap = np.append(-np.inf, u.starts[1:] - u.ends[:-1])[: len(new)]
    at = np.flatnonzero((gap > (usual_ms if ellipses_end else min(usual_ms, ELLIPSIS_MS))) & ~new)
    trails = np.zeros(len(at), bool) if ellipses_end else (u.count("…", u.begin[at - 1], u.end[at - 1]) > 0) & (gap[at] > ELLIPSIS_MS)
    own = np.searchsorted(u.lo, at, "right") - 1
    last = np.minimum(at + AHEAD, u.hi[own]) - 1
    lo = 0
    for k, first, pause, sure, begin, right in zip(at.tolist(), u.lo[own].tolist(), gap[at].tolist(), trails.tolist(), u.begin[at].tolist(), u.end[last].tolist()):
        lo = max(lo, first)
        if sure or (pause > usual_ms and not (pause <= WIDEST_MS and belongs(u.text[u.begin[lo] : begin], u.text[begin:right], pause, usual_ms))):
            new[k] = True
            lo = k
    return np.flatnonzero(new)


def free_of_fillers(u: Units, lo: np.ndarray) -> np.ndarray:
    """Lets the repeats of one filler (``filler_runs``) within segments, whose first tokens are given, go; their first tokens after that. Only segments that hold a filler's first sign are looked at."""
    hi = np.append(lo[1:], len(u.i))[: len(lo)]
    signs = table(filler_signs())
    signs[0xFFFF] = True  # what lies beyond the table is looked at too
    found = sums(signs[u.code16[u.begin]])
    stay = np.ones(len(u.i), bool)
    for k in np.flatnonzero(found[hi] > found[lo]).tolist():
        a, b = lo[k], hi[k]
        stay[a:b] = filler_runs([u.text[x:y] for x, y in zip(u.begin[a:b].tolist(), u.end[a:b].tolist())])
    return lo if stay.all() else u.keep(stay, lo, hi)[0]


def cut_to_budget(lo: np.ndarray, starts: np.ndarray, ends: np.ndarray, brk: np.ndarray, most: int, longest_ms: float, pause_ms: float = PAUSE_MS) -> np.ndarray:
    """First tokens of the pieces of segments, whose first tokens are given: pieces of at most ``most`` characters that don't go on past ``longest_ms``. A full piece is cut behind
    the last mark in it, else at its largest pause of ``pause_ms`` or more (the last of equals, the one behind it included), else where it is full. The next pieces of all segments are
    sought side by side."""
    n = len(starts)
    gap = np.append(-np.inf, starts[1:] - ends[:-1])[:n]
    last_break = np.maximum.accumulate(np.where(brk, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    at, to, out = lo, np.append(lo[1:], n)[: len(lo)], []
    while len(at):
        out.append(at)
        full = np.minimum(to, at + most)
        hi, open_ = full.copy(), np.arange(len(at))
        for k in range(1, most):
            open_ = open_[at[open_] + k < full[open_]]
            if not len(open_):
                break
            past = ends[at[open_] + k - 1] - starts[at[open_]] > longest_ms
            hi[open_[past]] = at[open_[past]] + k
            open_ = open_[~past]
        more = hi < to
        at, hi, to = at[more], hi[more], to[more]
        cut = last_break[hi - 1] + 1
        none = np.flatnonzero(cut <= at)
        cut[none] = hi[none]
        widest = np.full(len(none), -np.inf)
        for k in range(1, most + 1):
            inside = at[none] + k <= hi[none]
            none, widest = none[inside], widest[inside]
            if not len(none):
                break
            pause = gap[at[none] + k]
            wider = (pause >= pause_ms) & (pause >= widest)
            widest[wider] = pause[wider]
            cut[none[wider]] = at[none[wider]] + k
        at = cut
    return np.sort(np.concatenate(out)) if out else lo


def _rows(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and unit of each token."""
    size = u.hi - u.lo
    return np.repeat(u.of, size), np.repeat(u.number, size)


def _places(lo: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Numbers (from 0) of ranges, whose first tokens are given, within others."""
    own = np.searchsorted(within, lo, "right") - 1
    return np.arange(len(lo)) - np.searchsorted(own, own)


def timed_tokens(texts: DataFrame, stream: DataFrame, longest: int, ends: str = SENTENCE_ENDS, soft: str = "、", keys: Sequence[str] = KEYS) -> DataFrame:
    """The characters of each sentence unit with their times: ``unit, i, shown, start_ms, end_ms, brk`` (see ``Units``); ``brk``: a cue may end there.

    Units take characters of the stream (``i``) in turn. A unit without any has no rows. Null texts and chunks without a stream have none.
    """

    def fold(u: Units) -> Made:
        of, unit = _rows(u)
        return of, (unit, u.i, u.shown(np.arange(len(of))), u.starts, u.ends, breaks(u))

    return over_units(texts, stream, longest, fold, "unit int, i long, shown string, start_ms double, end_ms double, brk boolean", ends, soft, keys)


def budget_pieces(texts: DataFrame, stream: DataFrame, longest: int, most: int, longest_ms: float, pause_ms: float = PAUSE_MS, keys: Sequence[str] = KEYS) -> DataFrame:
    """``unit, piece`` (from 0), ``i``: the characters of ``timed_tokens`` with the piece that ``cut_to_budget`` puts them into, unit by unit."""

    def fold(u: Units) -> Made:
        first = np.flatnonzero(_firsts(u))
        lo = cut_to_budget(first, u.starts, u.ends, breaks(u), most, longest_ms, pause_ms)
        of, unit = _rows(u)
        return of, (unit, np.repeat(_places(lo, first), np.diff(np.append(lo, len(of)))), u.i)

    return over_units(texts, stream, longest, fold, "unit int, piece int, i long", keys=keys)


def without_filler_runs(texts: DataFrame, stream: DataFrame, longest: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``unit, i, shown``: the characters of ``timed_tokens`` without the repeats of one filler (``filler_runs``), unit by unit."""

    def fold(u: Units) -> Made:
        free_of_fillers(u, np.flatnonzero(_firsts(u)))
        of, unit = _rows(u)
        return of, (unit, u.i, u.shown(np.arange(len(of))))

    return over_units(texts, stream, longest, fold, "unit int, i long, shown string", keys=keys)


def token_pieces(texts: DataFrame, stream: DataFrame, most: int, longest_ms: float, usual_ms: float, by_pauses: bool = True, fillers: bool = True, ellipses_end: bool = True, keys: Sequence[str] = KEYS, columns: Sequence[str] = ()) -> DataFrame:
    """``unit, segment, piece, i`` (of the first character), ``start_ms, end_ms, shown``: units cut at pauses, freed of runs of fillers, cut to the budget."""

    def fold(u: Units) -> Made:
        segments = cut_at_pauses(u, usual_ms, ellipses_end) if by_pauses else np.flatnonzero(_firsts(u))
        if fillers:
            segments = free_of_fillers(u, segments)
        lo = cut_to_budget(segments, u.starts, u.ends, breaks(u), most, longest_ms)
        of, unit = (x[lo] for x in _rows(u))
        own = segments[np.searchsorted(segments, lo, "right") - 1]
        first = np.flatnonzero(_firsts(u))
        return of, (unit, _places(segments, first)[np.searchsorted(segments, own)], _places(lo, segments), u.i[lo], u.starts[lo], u.ends[np.append(lo[1:], len(u.i))[: len(lo)] - 1], u.shown(lo))

    return over_units(texts, stream, most, fold, "unit int, segment int, piece int, i long, start_ms double, end_ms double, shown string", soft="、" if ellipses_end else "、…", keys=keys, columns=columns)


def cues_of_pieces(pieces: DataFrame, least_ms: float, longest_ms: float, offset: Column | float = 0.0, keys: Sequence[str] = KEYS, columns: Sequence[str] = ()) -> DataFrame:
    """One cue for each of ``token_pieces``: ``i`` (of its first character), ``start_ms, end_ms, text, collapsed``, and ``columns``. A cue lasts ``least_ms`` at least and
    ``longest_ms`` at most; it is ``collapsed`` if its characters have no span. Cues without text go."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    a, b = offset + F.col("start_ms"), offset + F.col("end_ms")
    text = F.btrim("shown", F.lit(WHITE_SPACE))
    t = pieces.select(*keys, "i", a.alias("start_ms"), F.least(F.greatest(b, a + least_ms), a + longest_ms).alias("end_ms"), text.alias("text"), (b - a <= POINT_MS).alias("collapsed"), *columns)
    return t.filter("text <> ''")


def aligned_cues(texts: DataFrame, items: DataFrame, most: int = 30, longest_ms: float = 7000, least_ms: float = 500, usual_ms: float = 1500, most_ms: float = 500, fillers: bool = True, ellipses_end: bool = True, by_pauses: bool = True, keys: Sequence[str] = KEYS, columns: Sequence[str] = ()) -> DataFrame:
    """Cues of chunks (``text``, and ``offset_ms`` if there is one) from their aligned items (``pos, word, start_ms, end_ms``): ``i, start_ms, end_ms, text,
    collapsed``, and ``columns`` of the chunk.

    The text says what is shown, the items only when. Without ``by_pauses`` pauses cut nothing and the text is authoritative: characters that the items lack
    are timed by their neighbours. Null texts, texts without timed characters and (unless authoritative) chunks without items have no cues; null items
    are passed over.
    """
    offset = F.col("offset_ms") if "offset_ms" in texts.columns else F.lit(0.0)
    t = texts.filter("text is not null").select(*keys, "text", offset.cast("double").alias("_offset"), *columns)
    pieces = token_pieces(t, character_stream(t, items, most_ms, not by_pauses, keys), most, longest_ms, usual_ms, by_pauses, fillers, ellipses_end, keys, ["_offset", *columns])
    return cues_of_pieces(pieces, least_ms, longest_ms, F.col("_offset"), keys, columns)
