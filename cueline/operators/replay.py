"""From recogniser dumps to finished cues: which times a chunk goes by, its cues, whose they are, and the finishing of a track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fragments import FILLERS, REPLIES
from ..functions.normal import echoes, filler_core, fold_repeats
from ..sources.folders import settled
from .cues import aligned_cues
from .folds import merge_close_in_regions, same_start_piles, settle_short, squeezed_duplicates
from .intervals import resolve_overlaps, same_keys
from .runs import filler_drop, first_region
from .signals import frame_cues, region_characters, unit_faults

KEYS = ("track", "chunk")
MODES = ("aligner_fallback", "aligner_only", "vad_only")


def _of(t: DataFrame, chunks: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of the chunks given, or of all others."""
    c = chunks.select(*[F.col(k).alias(f"_c_{k}") for k in keys]).distinct()
    return t.join(c, same_keys(t, c, keys, "_c_"), how)


def timing_items(chunks: DataFrame, items: DataFrame, raw_items: DataFrame, regions: DataFrame, mode: str = MODES[0], frame_native: bool = False, most_ms: float = 500, longest: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """The items (``pos, word, start_ms, end_ms``) that each chunk (``text``) is timed by; where there is a column ``choice``, those of the least one that the chunk has (``item_times``
    leaves the others out, so that no items are moved to find out).

    ``vad_only``: its characters spread over its speech regions. ``aligner_only``: the raw items where it has any, else the items. ``aligner_fallback``: the items
    where it has any, else the raw ones; if chunks are frames of their own (``frame_native``) and the raw items (or, without any, the items) have faults
    (``unit_faults``), the regions. A chunk without what its mode asks for has none.
    """
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {', '.join(MODES)}")
    columns = [*keys, "pos", "word", "start_ms", "end_ms"]
    ranked = lambda t, k: t.select(*columns, F.lit(k).alias("choice"))
    spread = lambda c: region_characters(c.select(*keys, "text"), regions, keys).select(*keys, F.col("k").alias("pos"), F.col("ch").alias("word"), "start_ms", "end_ms")
    if mode == "vad_only":
        return spread(chunks)
    first, second = (raw_items, items) if mode == "aligner_only" else (items, raw_items)
    chosen = lambda a, b: ranked(a, 0).unionByName(ranked(b, 1))
    picked = chosen(first, second)
    if mode == "aligner_only" or not frame_native:
        return picked
    bad = unit_faults(chunks.select(*keys, "text"), chosen(raw_items, items), most_ms, longest, soft="、…", keys=keys).select(*keys).distinct()
    return _of(picked, bad, keys, "left_anti").unionByName(ranked(spread(_of(chunks, bad, keys)), 0))


def replayed(chunks: DataFrame, items: DataFrame, raw_items: DataFrame, regions: DataFrame, regroup: DataFrame | None = None, mode: str = MODES[0], frame_native: bool = False, context: str = "", most: int = 30, longest_ms: float = 7000, least_ms: float = 500, usual_ms: float = 1500, most_ms: float = 500, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues of a track's chunks (``start_ms, end_ms, text, keep_lo, keep_hi, superseded``): ``pos, start_ms, end_ms, text, collapsed, source_text``.

    Superseded chunks are left out, a text that mostly repeats the ``context`` is empty. Cues are built with the times of ``timing_items`` (frames by mode ``vad_only``:
    ``frame_cues``), stay if their middle lies in the chunk's own window (null ends are open), and only then last ``least_ms`` at least. Unless frames stand for
    themselves, close neighbours of one region of ``regroup`` (all regions of time of the track; without any, of one chunk) become one. Times of items are counted from the chunk's start.
    """
    t = chunks.filter(~F.coalesce("superseded", F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    if context:
        t = t.withColumn("text", F.when(echoes(F.col("text"), F.lit(context)), F.lit("")).otherwise(F.col("text")))
    if frame_native and mode == "vad_only":
        source = ("_source", "source_start_ms", "source_end_ms")
        cues = frame_cues(t.select(*keys, F.lit(0).alias("pos"), "start_ms", "end_ms", "text", *[F.col(c).alias(n) for c, n in zip(("text", "start_ms", "end_ms"), source)]), keys, source)
        kept = cues.select(*keys, F.col("piece").cast("long").alias("i"), F.col("start_ms").cast("double"), F.col("end_ms").cast("double"), "text", F.lit(False).alias("collapsed"), *source)
    else:
        own = timing_items(t, items, raw_items, regions, mode, frame_native, most_ms, most, keys)
        source = {"_source": "text", "source_start_ms": "start_ms", "source_end_ms": "end_ms"} if frame_native else {}
        texts = t.select(*keys, "text", F.col("start_ms").alias("offset_ms"), "keep_lo", "keep_hi", *[F.col(c).alias(n) for n, c in source.items()])
        kept = aligned_cues(texts, own, most, longest_ms, 0.0, usual_ms, most_ms, True, not frame_native, not frame_native, keys, ["keep_lo", "keep_hi", *source])
        twice = F.col("start_ms") + F.col("end_ms")
        kept = kept.filter((twice >= F.coalesce(F.col("keep_lo") * 2, twice)) & (twice < F.coalesce(F.col("keep_hi") * 2, twice + 1)))
        kept = kept.withColumn("end_ms", F.least(F.greatest("end_ms", F.col("start_ms") + least_ms), F.col("start_ms") + longest_ms))
    kind = lambda c: {"source_text": "string"}.get(c) or t.schema[c.removeprefix("source_")].dataType
    of = [(F.col(c) if frame_native else F.lit(None).cast(kind(n))).alias(n) for c, n in (("_source", "source_text"), ("source_start_ms", "source_start_ms"), ("source_end_ms", "source_end_ms"))]
    kept = kept.select(*keys, F.col("i").alias("pos"), F.round("start_ms").cast("long").alias("start_ms"), F.round("end_ms").cast("long").alias("end_ms"), "text", "collapsed", *of)
    if frame_native:
        return kept
    if regroup is None:  # a group is a chunk, whose cues one task has made
        return merge_close_in_regions(kept.withColumn("region_ms", F.lit(0).cast("long")), usual_ms, most, longest_ms, keys, True).drop("region_ms")
    kept = settled(kept)
    inside = first_region(kept.select(*keys, "pos", "start_ms", "end_ms"), regroup, keys).select(*[F.col(k).alias(f"_f_{k}") for k in (*keys, "pos")], "region_ms")
    alone = _of(kept, regroup, keys, "left_anti").withColumn("region_ms", F.lit(0).cast("long"))
    grouped = _of(kept, regroup, keys)
    grouped = grouped.join(inside, same_keys(grouped, inside, [*keys, "pos"], "_f_")).select(*kept.columns, "region_ms")
    return merge_close_in_regions(alone.unionByName(grouped), usual_ms, most, longest_ms, keys).drop("region_ms")


def finished_track(cues: DataFrame, similar: float | None = None, max_gap: int = 2000, squeeze_ms: int = 700, silence_ms: int = 5000, least_ms: int = 300, keys: Sequence[str] = ("track",)) -> DataFrame:
    """A track put in order: runaway repeats folded, piles of one start and overlaps resolved, squeezed near duplicates dropped (only if ``similar`` is given), isolated and
    chained fillers dropped, what is then shorter than ``least_ms`` settled. ``collapsed`` and the columns of the source (``source_text, source_start_ms,
    source_end_ms``) count where they are there; null texts are empty. Tables in between are written to the shared folder."""
    t = cues.withColumn("text", fold_repeats(F.coalesce("text", F.lit(""))))
    for name, kind in (("collapsed", "boolean"), ("source_text", "string")):
        if name not in t.columns:
            t = t.withColumn(name, F.lit(None).cast(kind))
    t = same_start_piles(settled(t.withColumn("collapsed", F.coalesce("collapsed", F.lit(False)))), keys=keys)
    t = settled(resolve_overlaps(t, keys))
    if similar is not None:
        t = settled(squeezed_duplicates(t, max_gap, similar, squeeze_ms, keys))
    t = t.withColumns({"core": filler_core("text"), "source_core": F.when(F.col("source_text").isNotNull(), filler_core(F.coalesce("source_text", F.lit(""))))})
    t = filler_drop(t, FILLERS, REPLIES, silence_ms, keys=keys).drop("core", "source_core")
    return settle_short(t, least_ms, keys) if least_ms > 0 else t
