"""Rules that go from cue to cue and compare with what was kept: one pass over sorted rows, an open cue or two in memory.

Before a fold, tracks are cut where the rule cannot reach across: at silences longer than its largest gap. A piece
starts in a known state, so the pieces of one track are folded in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.normal import ratio
from ..functions.text import UNTIMED, compact
from .intervals import SLOT, islands, same_keys

KEYS, ORDER = ("track",), ("start_ms", "end_ms", "pos")
Rows = Iterable[dict]
BLANKS = " \t\n\x0b\x0c\r\u3000"
_DROP_BLANKS, _DROP_UNTIMED = str.maketrans("", "", BLANKS), str.maketrans("", "", UNTIMED)


def squeezed(text: str) -> str:
    return text.translate(_DROP_BLANKS)


def timed(text: str) -> str:
    return text.translate(_DROP_UNTIMED)


def texts(df: DataFrame) -> DataFrame:
    """Null texts count as empty."""
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def folded(df: DataFrame, fold: Callable[[Rows], Iterator[dict]], keys: Sequence[str] = KEYS, reach_ms: int | None = None, more: str = "", order: Sequence[str] = ORDER) -> DataFrame:
    """Runs ``fold`` over the rows of each group in order; it yields rows, with the columns of ``more`` if that is given.

    ``reach_ms``: no rule of the fold joins or compares cues further apart than this (from the largest end so far), so
    groups are cut there. Nulls and numbers go through Arrow unchanged.
    """
    schema = T.StructType([*df.schema.fields, *(T._parse_datatype_string(more).fields if more else [])])
    names, by = df.columns, list(keys)
    if reach_ms is not None:
        df = islands(df, keys, reach_ms).select(*names, "island_ms")
        by.append("island_ms")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        done = (r for _, group in groupby(rows, key=lambda r: [r[k] for k in by]) for r in fold(group))
        while part := list(islice(done, 4096)):
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in arrow.names} for r in part], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def reach(df: DataFrame, gap: int, keys: Sequence[str] = KEYS) -> int | None:
    """``gap``, or None if no track spans more than one slot of time (a look at starts, by a job of its own): the rows of a slot meet in one task to be cut, so there
    is nothing to gain, and the texts of all rows would be moved several times."""
    slot = F.floor(F.col("start_ms") / SLOT)
    return None if df.groupBy(*keys).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b")).filter("_a < _b").isEmpty() else gap


def worse(a: dict, b: dict) -> dict:
    """The worst confidence of two cues, where there is any."""
    pick = lambda f, k: f(x for x in (a.get(k), b.get(k)) if x is not None) if (a.get(k), b.get(k)) != (None, None) else None
    return {k: pick(f, k) for k, f in (("avg_logprob", min), ("no_speech_prob", max), ("compression_ratio", max)) if k in a}


def merge_short(df: DataFrame, short: int, max_gap: int, max_chars: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Append a cue to the one before if either has at most ``short`` characters (blanks aside), no more than ``max_gap``
    lies between them and both together have at most ``max_chars``; the worst confidence stays. Order: start, end, ``pos``; null texts are empty."""

    def fold(rows: Rows) -> Iterator[dict]:
        last = None
        for r in rows:
            if last:
                a, b = len(squeezed(last["text"])), len(squeezed(r["text"]))
                if min(a, b) <= short and r["start_ms"] - last["end_ms"] <= max_gap and a + b <= max_chars:
                    last |= {"end_ms": max(last["end_ms"], r["end_ms"]), "text": last["text"] + r["text"], **worse(last, r)}
                    continue
                yield last
            last = r
        if last:
            yield last

    return folded(texts(df), fold, keys, max_gap)


def near_duplicates(a: str, b: str) -> bool:
    lo, hi = sorted((len(a), len(b)))
    return bool(b) and lo >= 0.6 * hi and ratio(a, b, junk=True) >= 0.8


def _alike(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Which rows agree with the row before in some columns, nulls included; the first has none before it."""
    out = np.ones(batch.num_rows, bool)
    out[:1] = False
    for c in columns:
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] &= same.to_numpy(zero_copy_only=False)
    return out


def _close(df: DataFrame, max_gap: int, max_chars: int, max_ms: int, keys: Sequence[str], reach_ms: int | None, region: Sequence[str] = ()) -> DataFrame:
    """Neighbours of a group and a region joined (see ``merge_close``). Gaps and lengths are compared for whole batches, so that only cues that may be joined are looked at one by
    one: an open cue ends where the one before ended, joined or not. One open cue is held from batch to batch."""
    names, by, schema = df.columns, list(keys), df.schema
    arrow = to_arrow_schema(schema)
    if reach_ms is not None:
        df = islands(df, keys, reach_ms).select(*names, "island_ms")
        by.append("island_ms")

    def joined(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, int]:
        """The cues of a batch, and how many of them are done."""
        start, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start_ms", "end_ms"))
        gap, span = np.append(-1, start[1:] - end[:-1]), np.append(0, end[1:] - start[:-1])
        may = _alike(batch, [*by, *region]) & (gap >= 0) & (gap < max_gap) & (span <= max_ms)
        for c in region:
            may &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(may)
        near = np.union1d(at, at - 1)
        texts = dict(zip(near.tolist(), batch.column("text").take(pa.array(near)).to_pylist()))
        collapsed = batch.column("collapsed").to_pylist() if "collapsed" in names else None
        gone, new, head, before = [], {}, -1, -1
        for k, a, b in zip(at.tolist(), start[at - 1].tolist(), end[at].tolist()):
            if before != k - 1:  # the cue before is open as it is
                head, text, first = k - 1, texts[k - 1], a
                chars = timed(text)
            before, own = k, texts[k]
            more = timed(own)
            if len(chars) + len(more) <= max_chars and b - first <= max_ms and not near_duplicates(chars, more):
                text = text.rstrip() + own.lstrip()
                chars = timed(text)
                new[head] = text, k
                gone.append(k)
                if collapsed:
                    collapsed[head] = collapsed[head] and collapsed[k]
            else:
                head, text, chars, first = k, own, more, start[k].item()
        if new:
            changed, heads = np.zeros(batch.num_rows, bool), list(new)  # in order
            changed[heads] = True
            ends = end.copy()
            ends[heads] = end[[k for _, k in new.values()]]
            columns = {"end_ms": pa.array(ends, batch.column("end_ms").type, from_pandas=True), "text": pc.replace_with_mask(batch.column("text"), pa.array(changed), pa.array([x for x, _ in new.values()], batch.column("text").type))}
            if collapsed:
                columns["collapsed"] = pa.array(collapsed, batch.column("collapsed").type)
            batch = pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)
            stay = np.ones(batch.num_rows, bool)
            stay[gone] = False
            batch = batch.filter(pa.array(stay))
        return batch, batch.num_rows - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out = lambda b: pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in arrow], schema=arrow)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch.cast(held.schema)])
            batch, done = joined(batch)
            if done:
                yield out(batch.slice(0, done))
            held = batch.take(pa.array([done]))  # the open cue, copied
        if held is not None:
            yield out(held)

    return df.repartition(*by).sortWithinPartitions(*by, *ORDER).mapInArrow(run, schema)


def merge_close(df: DataFrame, max_gap: int, max_chars: int, max_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Join neighbours less than ``max_gap`` apart within bounds of timed characters and length, but not near duplicates. Null texts are empty."""
    return _close(texts(df), max_gap, max_chars, max_ms, keys, reach(df, max_gap, keys))


def merge_close_in_regions(df: DataFrame, max_gap: int, max_chars: int, max_ms: int, keys: Sequence[str] = KEYS, short: bool = False) -> DataFrame:
    """``merge_close`` within runs of cues of one region (column ``region_ms``); a cue without one stays alone and ends a run. ``short``: the tracks are known to be short,
    so they are not looked at beforehand and not cut."""
    return _close(texts(df), max_gap, max_chars, max_ms, keys, None if short else reach(df, max_gap, keys), ["region_ms"])


def same_start_piles(df: DataFrame, tolerance_ms: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of cues that start within the tolerance of the one kept, one stays: a genuinely timed one before a ``collapsed`` one,
    else the first. Cues of the same ``source_text`` are joined instead."""

    def fold(rows: Rows) -> Iterator[dict]:
        last = None
        for r in rows:
            if last and r["start_ms"] - last["start_ms"] <= tolerance_ms:
                if last.get("source_text") is not None and last["source_text"] == r["source_text"]:
                    last |= {"text": last["text"] + r["text"], "end_ms": max(last["end_ms"], r["end_ms"]), "collapsed": last["collapsed"] and r["collapsed"]}
                elif last.get("collapsed") and not r["collapsed"]:
                    last = r
                continue
            if last:
                yield last
            last = r
        if last:
            yield last

    return folded(texts(df), fold, keys, max(0, tolerance_ms))


def squeezed_duplicates(df: DataFrame, max_gap: int, least: float, squeeze_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of similar neighbours at most ``max_gap`` apart, one of them shorter than ``squeeze_ms``, the longer stays (the later of equals)."""

    def fold(rows: Rows) -> Iterator[dict]:
        last = None
        for r in rows:
            if last:
                a, b = last["end_ms"] - last["start_ms"], r["end_ms"] - r["start_ms"]
                if r["start_ms"] - last["end_ms"] <= max_gap and min(a, b) < squeeze_ms and ratio(squeezed(last["text"]), squeezed(r["text"]), junk=True) >= least:
                    last = last if b < a else r
                    continue
                yield last
            last = r
        if last:
            yield last

    return folded(texts(df), fold, keys, max_gap)


def windowed_dedup(df: DataFrame, window_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues that stay when those go that start at most ``window_ms`` after the end of a *surviving* cue of equal text (blanks
    aside); cues without text go. Rows are dealt by a digest of the text (SHA-256), so a long run of one text needs no memory."""
    names = df.columns
    t = df.withColumn("_text", compact(F.col("text"))).filter("_text <> ''").withColumn("_text", F.unhex(F.sha2("_text", 256)))

    def fold(rows: Rows) -> Iterator[dict]:
        until = None
        for r in rows:
            if until is None or r["start_ms"] - until > window_ms:
                until = r["end_ms"]
                yield r

    return folded(t, fold, [*keys, "_text"], reach(df, window_ms, keys)).select(*names)


#: Ends of segments that were cut while speech went on; they name a boundary before a group's cap does.
FORCED = ("forced_max_speech", "soft_max_valley", "hard_max_valley", "hard_max_speech")


def capped_groups(df: DataFrame, max_gap: int, max_span: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``group_ms`` (start of the group) and ``reason``, why it began (null: the track's first): a new group where the gap to
    the segment before is larger than ``max_gap`` or the span would pass ``max_span``."""

    def fold(rows: Rows) -> Iterator[dict]:
        start = before = reason = None
        for r in rows:
            if before is None:
                start = r["start_ms"]
            else:
                gap = r["start_ms"] - before["end_ms"]
                if gap > max_gap or r["end_ms"] - start > max_span:
                    reason = "silence_gap" if gap > max_gap else before["end_reason"] if before.get("end_reason") in FORCED else "forced_max_group"
                    start = r["start_ms"]
            before = r
            yield r | {"group_ms": start, "reason": reason}

    t = folded(df, fold, keys, max_gap, more="group_ms long, reason string")
    first = df.groupBy(*keys).agg(F.min("start_ms").alias("_first"))  # only the track's first group has no reason
    first = first.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    t = t.join(first, same_keys(t, first, keys, "_k_"))
    return t.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("group_ms") > F.col("_first")), F.lit("silence_gap")).otherwise(F.col("reason"))).select(*df.columns, "group_ms", "reason")


def packed_clusters(df: DataFrame, max_gap: int, max_span: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge neighbours at most ``max_gap`` apart while the span stays within ``max_span``; a gap of 0 or less merges nothing."""

    def fold(rows: Rows) -> Iterator[dict]:
        last = None
        for r in rows:
            if last and max_gap > 0 and r["start_ms"] - last["end_ms"] <= max_gap and r["end_ms"] - last["start_ms"] <= max_span:
                last["end_ms"] = r["end_ms"]
                continue
            if last:
                yield last
            last = r
        if last:
            yield last

    return folded(df, fold, keys, max(0, max_gap))


def settle_short(df: DataFrame, least_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues shorter than ``least_ms`` go; one that has a ``source_text`` is joined to the cue before of that source, else put
    before the next one of it, else it stays."""

    def fold(rows: Rows) -> Iterator[dict]:
        held, kept = None, None  # a short cue that waits for the next one; the last that was kept
        for r in rows:
            if held is not None:
                if held["source_text"] == r["source_text"]:
                    r |= {"text": held["text"] + r["text"], "start_ms": min(held["start_ms"], r["start_ms"])}
                else:
                    if kept:
                        yield kept
                    kept = held
                held = None
            if r["end_ms"] - r["start_ms"] < least_ms:
                if r["source_text"] is None:
                    continue
                if kept and kept["source_text"] == r["source_text"]:
                    kept |= {"text": kept["text"] + r["text"], "end_ms": max(kept["end_ms"], r["end_ms"])}
                else:
                    held = r
                continue
            if kept:
                yield kept
            kept = r
        yield from (r for r in (kept, held) if r)

    return folded(texts(df), fold, keys)
