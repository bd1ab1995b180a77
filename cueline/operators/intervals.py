"""Interval algebra per track: unions, gaps, clusters, overlap joins. Times are BIGINT milliseconds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("track",)


#: Width of the slots of time that running values are dealt out by: a day.
SLOT = 86_400_000


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str = "") -> Column:
    """Null-safe equality of keys, in ``b`` with a prefix."""
    return reduce(lambda c, k: c & a[k].eqNullSafe(b[prefix + k]), keys, F.lit(True))


def running_max(df: DataFrame, value: Column, out: str, keys: Sequence[str] = KEYS, before: bool = True, width: int = SLOT) -> DataFrame:
    """Adds ``out``: the largest value of the rows before each row by start and end, or of those up to its start.

    A track is dealt out by slots of time: maxima of slots give what lies before a slot (one row a slot), and only rows
    of one slot are sorted together, so a track of any length is many tasks."""
    own = df.withColumns({"_slot": F.floor(F.col("start_ms") / width), "_v": value})
    tops = own.groupBy(*keys, "_slot").agg(F.max("_v").alias("_top"))
    by = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slot").alias("_of"), F.max("_top").over(by).alias("_earlier"))
    t = own.join(tops, same_keys(own, tops, keys, "_k_") & (F.col("_slot") == F.col("_of")))
    w = Window.partitionBy(*keys, "_slot")
    w = w.orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1) if before else w.orderBy("start_ms")
    return t.select(*df.columns, F.greatest(F.max("_v").over(w), "_earlier").alias(out))


def islands(df: DataFrame, keys: Sequence[str] = KEYS, gap: int = 0) -> DataFrame:
    """Adds ``reach``, the largest end before a row, and ``island_ms``, the start of the row's island: a new one begins
    where a start lies more than ``gap`` beyond the reach."""
    t = running_max(df, F.col("end_ms"), "reach", keys)
    new = F.when(F.col("reach").isNull() | (F.col("start_ms") > F.col("reach") + gap), F.col("start_ms"))
    return running_max(t, new, "island_ms", keys, before=False)


def merge_intervals(df: DataFrame, keys: Sequence[str] = KEYS, gap: int = 0) -> DataFrame:
    """Union of each track's intervals; touching ones merge, and ones up to ``gap`` apart."""
    return islands(df, keys, gap).groupBy(*keys, "island_ms").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island_ms")


def gaps(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Uncovered spans between the first start and the last end."""
    return running_max(df, F.col("end_ms"), "reach", keys).filter("start_ms > reach").select(*keys, F.col("reach").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def full_span_gaps(df: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Uncovered spans of [0, duration_ms]; ``tracks`` has a row for each track, covered or not."""
    t = df.join(tracks, list(keys)).select(*keys, F.greatest("start_ms", F.lit(0)).alias("start_ms"), F.least("end_ms", "duration_ms").alias("end_ms")).filter("end_ms > start_ms")
    edge = lambda c: tracks.select(*keys, c.cast("long").alias("start_ms"), c.cast("long").alias("end_ms"))
    return gaps(t.union(edge(F.lit(0))).union(edge(F.col("duration_ms"))), keys)


def clusters(df: DataFrame, max_gap: int, pad: int, duration: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Islands up to ``max_gap`` apart, padded, clamped to the recording and merged again."""
    t = merge_intervals(df, keys, max_gap)
    return merge_intervals(t.withColumns({"start_ms": F.greatest(F.col("start_ms") - pad, F.lit(0)), "end_ms": F.least(F.col("end_ms") + pad, F.lit(duration))}), keys)


def _spread(start: str, end: str, width: int) -> Column:
    """The buckets of time that an interval lies in; one without length lies in that of its start."""
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)))


def met(a: DataFrame, found: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``a`` joined with what was found for its intervals (keys, start_ms, end_ms; one row each): rows that repeat get it each, and no other column, null or
    not, plays a part."""
    names = {c: f"_f_{c}" for c in (*keys, "start_ms", "end_ms")}
    f = found.withColumnsRenamed(names)
    return a.join(f, same_keys(a, f, [*names], "_f_"), how).drop(*names.values())


def range_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, width: int = 600_000, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals (b's columns prefixed ``b_``): both sides are dealt into time buckets, so a long
    track is spread over many tasks; a pair counts in the first bucket that both have. Null keys are equal to null keys; an interval without a start or
    an end overlaps nothing. ``left_semi`` and ``left_anti`` keep rows of ``a`` as they are, repeated ones too."""
    if how in ("left_anti", "left_semi"):
        own = a.select(*keys, "start_ms", "end_ms").distinct()
        return met(a, range_join(own, b.select(*keys, "start_ms", "end_ms"), keys, width).select(own.columns).distinct(), keys, how)
    left = a.select("*", _spread("start_ms", "end_ms", width).alias("_bucket"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).select("*", _spread("b_start_ms", "b_end_ms", width).alias("_b_bucket"))
    on = (F.col("_bucket") == F.col("_b_bucket")) & same_keys(left, right, keys, "b_") & (F.col("start_ms") < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("end_ms"))
    once = F.col("_bucket") == F.floor(F.greatest(F.col("start_ms"), F.col("b_start_ms")) / width)
    return left.join(right, on & once).drop("_bucket", "_b_bucket", *[f"b_{k}" for k in keys])


def overlap_ms(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each interval of ``a`` with the length that the union of ``b`` covers of it; 0 for one without a start or an end."""
    own = a.select(*keys, "start_ms", "end_ms").distinct()
    pairs = range_join(own, merge_intervals(b.select(*keys, "start_ms", "end_ms"), keys), keys)
    sums = pairs.groupBy(*own.columns).agg(F.sum(F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")).alias("overlap_ms"))
    return met(a, sums, keys, "left").withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)))


def rebased(windows: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``b`` cut to each window and counted from its start; the whole window where nothing remains."""
    own = windows.select(*keys, "start_ms", "end_ms").distinct()
    hit = range_join(own, b.select(*keys, "start_ms", "end_ms"), keys).select(*own.columns, (F.greatest("start_ms", "b_start_ms") - F.col("start_ms")).alias("rel_start"), (F.least("end_ms", "b_end_ms") - F.col("start_ms")).alias("rel_end"))
    return met(windows, hit, keys, "left").withColumns({"rel_start": F.coalesce("rel_start", F.lit(0)), "rel_end": F.coalesce("rel_end", F.col("end_ms") - F.col("start_ms"))})


def outside(a: DataFrame, protected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Intervals of ``a`` that overlap no protected one; one without a start or an end overlaps none."""
    return range_join(a, protected, keys, how="left_anti")


def resolve_overlaps(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """End no later than the next start, where the next starts later; order by start, end, pos."""
    nxt = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "pos"))
    return df.withColumn("end_ms", F.when((nxt > F.col("start_ms")) & (F.col("end_ms") > nxt), nxt).otherwise(F.col("end_ms")))


def tiles(tracks: DataFrame, length: int, overlap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping tiles of [0, duration_ms] with the part that each owns; the last part is open (null)."""
    if not 0 <= overlap < length:
        raise ValueError("0 <= overlap < length")
    step = length - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("duration_ms") - length) / step)).cast("long")
    t = tracks.filter("duration_ms > 0").select(*keys, "duration_ms", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tile"))
    start = F.col("tile") * step
    return t.select(*keys, "tile", start.alias("start_ms"), F.least(start + length, F.col("duration_ms")).alias("end_ms"), start.alias("keep_lo"), F.when(F.col("tile") < F.col("last"), start + step).alias("keep_hi"))


def owned(cues: DataFrame, chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues of the tile whose own part holds their middle (twice the middle is compared, so nothing is rounded)."""
    twice = F.col("start_ms") + F.col("end_ms")
    points = cues.withColumns({"_s": F.floor(twice / 2), "_e": F.floor(twice / 2) + 1})
    parts = chunks.select(*keys, "tile", F.col("keep_lo").alias("start_ms"), F.coalesce("keep_hi", F.col("end_ms") + 1).alias("end_ms"))
    p = points.select(*[F.col(c).alias(f"cue_{c}" if c in ("start_ms", "end_ms") else c) for c in cues.columns], F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))
    return range_join(p, parts, keys).drop("start_ms", "end_ms", "b_start_ms", "b_end_ms").withColumnsRenamed({"cue_start_ms": "start_ms", "cue_end_ms": "end_ms", "b_tile": "tile"})
