"""Measures of tracks: summaries, speech coverage, distributions, repeats, alignment health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, phrase_key
from ..sources.folders import settled
from .intervals import full_span_gaps, gaps, merge_intervals, overlap_ms

KEYS = ("track",)


def span() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def track_summary(cues: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per track: cues, display time, union, overlap, coverage of its span, percentiles of durations and characters, cues of
    few characters, holes by length, and the health of its times."""
    spans = cues.select(*keys, "start_ms", "end_ms")
    union = merge_intervals(spans, keys).groupBy(*keys).agg(F.sum(span()).alias("union_ms"), F.count(F.lit(1)).alias("islands"))
    holes = gaps(spans, keys).groupBy(*keys).agg(*[F.count_if(span() > n * 1000).alias(f"gaps_{n}s") for n in (10, 30, 60)], F.max(span()).alias("gap_max"), F.round(F.percentile(span(), 0.95), 3).alias("gap_p95"))
    chars = F.length(compact(F.col("text")))
    health = cues.withColumn("_over", F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("pos")) > F.col("start_ms"))
    base = health.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(span()).alias("display_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"),
        *[F.round(F.percentile(span(), q / 100), 3).alias(f"dur_p{q}") for q in (50, 95)], *[F.round(F.percentile(chars, q / 100), 3).alias(f"chars_p{q}") for q in (50, 95)],
        *[F.count_if(chars <= n).alias(f"chars_to_{n}") for n in (1, 2, 3, 5)], F.count_if(span() < 400).alias("under_400"), F.count_if(span() > 8000).alias("over_8000"), F.count_if("_over").alias("n_overlaps"),
    )
    t = base.join(union, list(keys)).join(holes, list(keys), "left")
    return t.withColumns({"overlap_ms": F.col("display_ms") - F.col("union_ms"), "coverage": F.round(F.col("union_ms") / (F.col("last_ms") - F.col("first_ms")), 6), **{k: F.coalesce(k, F.lit(0)) for k in ("gaps_10s", "gaps_30s", "gaps_60s")}})


def suspicious_gaps(cues: DataFrame, speech: DataFrame, tracks: DataFrame, min_gap_ms: int, min_speech_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spans of [0, duration_ms] without a cue, at least ``min_gap_ms`` long, that hold at least ``min_speech_ms`` of speech."""
    holes = full_span_gaps(cues, tracks, keys).filter(span() >= min_gap_ms)
    return overlap_ms(holes, speech, keys).withColumnRenamed("overlap_ms", "speech_ms").filter(F.col("speech_ms") >= min_speech_ms)


def speech_coverage(cues: DataFrame, speech: DataFrame, tracks: DataFrame, pad_ms: int, min_gap_ms: int, min_speech_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per track: speech in all, how much of it the cues (widened by ``pad_ms``) cover, and its suspicious gaps; the
    coverage is null without speech."""
    parts = merge_intervals(speech.select(*keys, "start_ms", "end_ms"), keys)
    wide = cues.select(*keys, F.greatest(F.col("start_ms") - pad_ms, F.lit(0)).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))
    sums = overlap_ms(parts, wide, keys).groupBy(*keys).agg(F.sum(span()).alias("speech_ms"), F.sum("overlap_ms").alias("covered_ms"))
    odd = suspicious_gaps(cues, speech, tracks, min_gap_ms, min_speech_ms, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps_with_speech"))
    t = tracks.select(*keys).join(sums, list(keys), "left").join(odd, list(keys), "left").fillna(0, ["speech_ms", "covered_ms", "gaps_with_speech"])
    return t.withColumns({"uncovered_ms": F.col("speech_ms") - F.col("covered_ms"), "coverage": F.when(F.col("speech_ms") > 0, F.round(F.col("covered_ms") / F.col("speech_ms"), 3))})


def top_per_track(df: DataFrame, n: int, *order: Column | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first ``n`` rows of each track in the given order, with ``rank``. Spark drops the rest before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def distribution(df: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median and 95th percentile of absolute values; null values don't count."""
    a = F.abs(value)
    return df.groupBy(*keys).agg(F.count(a).alias("n"), F.round(F.avg(a), 6).alias("mean_abs"), F.round(F.percentile(a, 0.5), 6).alias("median_abs"), F.round(F.percentile(a, 0.95), 6).alias("p95_abs"))


def chunk_rollup(df: DataFrame, model_ms: Column, empty: Column, keys: Sequence[str]) -> DataFrame:
    """Chunks by key: unreadable measures are counted and left out of the sum."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(model_ms.isNull()).alias("unreadable"), F.sum(model_ms).alias("model_ms"), F.count_if(empty).alias("empty"))


def item_ranges(items: DataFrame, clips: DataFrame, tolerance_ms: int, keys: Sequence[str]) -> DataFrame:
    """Per clip (``clip_ms`` long): items, first start, last end (null if there are none), and whether all lie inside it."""
    t = clips.join(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")), list(keys), "left")
    return t.select(*keys, F.coalesce("items", F.lit(0)).cast("long").alias("items"), "start_ms", "end_ms", ((F.col("start_ms") >= -tolerance_ms) & (F.col("end_ms") <= F.col("clip_ms") + tolerance_ms)).alias("inside"))


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("frames"))


def slot_statistics(df: DataFrame, key: str, short: int) -> DataFrame:
    """Slots of translations by key: how many, how many a cache of distinct texts saves, and how many are short."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("slots"), (F.count(F.lit(1)) - F.count_distinct("text")).alias("hits"), F.count_if(F.length("text") < short).alias("short"))


def repeated_phrases(cues: DataFrame, least: int, no_speech: float, logprob: float, risky: Sequence[str], risky_most: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Phrases of a track (texts without blanks and edge marks) that look made up: ``track, phrase, times, reason``.

    ``risky``: all variants that contain a risky phrase, if together they reach ``risky_most``. ``repeated``: ``least``
    times or more, with a median ``no_speech_prob`` of at least ``no_speech`` or a median ``avg_logprob`` of at most
    ``logprob``. Cues without the measures count, their nulls don't enter the medians.
    """
    t = cues.withColumn("phrase", phrase_key(F.col("text"))).filter("phrase <> ''")
    groups = t.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("times"), F.median("no_speech_prob").alias("ns"), F.median("avg_logprob").alias("lp"))
    groups = groups.withColumn("cores", F.filter(F.array(*map(F.lit, risky)), lambda p: F.contains(F.col("phrase"), p)) if risky else F.array().cast("array<string>"))
    groups = settled(groups)  # what follows asks for them three times
    totals = groups.select(*keys, "times", F.explode("cores").alias("core")).groupBy(*keys, "core").agg(F.sum("times").alias("n")).filter(F.col("n") >= risky_most)
    hit = groups.select(*keys, "phrase", F.explode("cores").alias("core")).join(totals, [*keys, "core"], "left_semi").select(*keys, "phrase").distinct().withColumn("risky", F.lit(risky_most > 0))
    t = groups.join(hit, [*keys, "phrase"], "left")
    again = (F.col("times") >= least) & (F.coalesce(F.col("ns") >= no_speech, F.lit(False)) | F.coalesce(F.col("lp") <= logprob, F.lit(False)))
    reason = F.when(F.col("risky"), F.lit("risky")).when(again, F.lit("repeated"))
    return t.select(*keys, "phrase", "times", reason.alias("reason")).filter("reason is not null")


def without_phrases(cues: DataFrame, phrases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cues whose phrase isn't listed for their track."""
    t = cues.withColumn("_p", phrase_key(F.col("text")))
    p = phrases.select(*keys, F.col("phrase").alias("_p"))
    return t.join(p, [*keys, "_p"], "left_anti").drop("_p")


#: Alignments are odd below or above these: coverage, characters a second, span in ms, shares of words at zero and of points;
#: chunks of so few characters are not judged.
COVERAGE, CPS, LEAST_SPAN, AT_ZERO, POINTS, UNJUDGED = 0.05, 50.0, 500, 0.10, 0.40, 10


def alignment_health(words: DataFrame, scenes: DataFrame, keys: Sequence[str] = ("track", "chunk")) -> DataFrame:
    """Per chunk (``scene_ms`` long): whether its aligned words collapsed, and by which signs."""
    n = F.count(F.lit(1))
    t = words.groupBy(*keys).agg(n.alias("words"), F.sum(F.length("word")).alias("chars"), F.min_by("start_ms", "pos").alias("first"), F.max_by("end_ms", "pos").alias("last"), F.count_if((F.col("start_ms") == 0) & (F.col("end_ms") == 0)).alias("zeros"), F.count_if(F.col("start_ms") == F.col("end_ms")).alias("points"))
    t = scenes.join(t, list(keys), "left").fillna(0, ["words", "chars", "zeros", "points"])
    span = F.greatest(F.lit(0), F.col("last") - F.col("first"))
    t = t.withColumn("span_ms", F.coalesce(span, F.lit(0)))
    judged = (F.col("chars") > UNJUDGED) & (F.col("scene_ms") > 0)
    signs = {
        "coverage": F.col("span_ms") < COVERAGE * F.col("scene_ms"),
        "cps": (F.col("span_ms") == 0) | (F.col("chars") * 1000.0 > CPS * F.col("span_ms")),
        "span": F.col("span_ms") < LEAST_SPAN,
        "zero_position": F.col("zeros") > AT_ZERO * F.col("words"),
        "degenerate": F.col("points") > POINTS * F.col("words"),
    }
    found = F.array_join(F.array_compact(F.array(*[F.when(judged & c, F.lit(k)) for k, c in signs.items()])), ",")
    return t.select(*keys, "words", "chars", "span_ms", found.alias("triggers"), F.when(found == "", F.lit("OK")).otherwise(F.lit("COLLAPSED")).alias("status"))
