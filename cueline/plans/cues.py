"""Queries on cues from aligned characters. The rules go from character to character, so they have plain versions in tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fragments import kept_together
from ..operators import cues as cu
from ..operators import replay as rp
from ..operators import signals as sg
from .views import cue_doc


def spoken(spark, d):
    """Every line of the documents as the text of a chunk, its marks written as ideographic ones; some lines are said to be fillers only."""
    mumbled = F.when(F.col("pos") % 13 == 4, F.lit("うん、うん、うん、")).when(F.col("pos") % 17 == 5, F.lit("はい。はい。はい。")).otherwise(F.lit(""))
    text = F.concat(mumbled, F.translate("text", ".,", "。、"), F.when(F.col("pos") % 5 == 0, F.lit("…て、")).otherwise(F.lit("")))
    return cue_doc(spark, d).select("track", F.col("pos").alias("chunk"), text.alias("text"), F.col("start_ms").cast("double").alias("offset_ms"))


def aligned(spark, d):
    """The words of each chunk one after the other, 90 ms a character; some after a pause, some without a span, some far too long; a few are missing."""
    t = spoken(spark, d).select("track", "chunk", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    k = F.col("pos") + F.col("chunk") * 3 + F.col("track")
    t = t.withColumns({"_n": F.when(k % 19 == 7, 0).when(k % 29 == 3, 9000).otherwise(F.length("word") * 90), "_p": F.when(k % 11 == 6, 2600).when(k % 7 == 2, 150).otherwise(20)})
    upto = Window.partitionBy("track", "chunk").orderBy("pos")
    end = F.sum(F.col("_n") + F.col("_p")).over(upto)
    return t.withColumn("_e", end).filter(k % 31 != 9).select("track", "chunk", "pos", "word", (F.col("_e") - F.col("_n")).alias("start_ms"), F.col("_e").alias("end_ms"))


MOST, LONGEST_MS, LEAST_MS, USUAL_MS, CHARACTER_MS = 30, 6000, 400, 1200, 400


def streams(spark, d):
    t = spoken(spark, d)
    return t, cu.character_stream(t, aligned(spark, d), CHARACTER_MS)


def tokens(spark, d):
    return cu.timed_tokens(*streams(spark, d), MOST)


def aligned_cues(**options):
    return lambda s, d: cu.aligned_cues(spoken(s, d), aligned(s, d), MOST, LONGEST_MS, LEAST_MS, USUAL_MS, CHARACTER_MS, **options)


def together(spark, d):
    """Whether neighbouring lines would be one phrase across a pause that depends on their place."""
    w = Window.partitionBy("track").orderBy("chunk")
    t = spoken(spark, d).withColumns({"left": F.lag("text").over(w), "gap_ms": (F.col("chunk") % 9 * 900).cast("double")}).filter("left is not null")
    return t.select("track", "chunk", kept_together("left", "text", "gap_ms", F.lit(1000.0)).alias("kept"))


def chunk_table(spark, d):
    """Lines as chunks that own their middle; some superseded, some without an end of their window."""
    t = spoken(spark, d)
    end = F.col("offset_ms") + F.length("text") * 100 + 4000
    return t.select("track", "chunk", F.col("offset_ms").cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "text", F.col("offset_ms").cast("long").alias("keep_lo"), F.when(F.col("chunk") % 4 > 0, (end - 2000).cast("long")).alias("keep_hi"), (F.col("chunk") % 10 == 7).alias("superseded"))


def replay(mode, frame_native=False):
    """Cues of all chunks; every third has raw items only, speech lies in two stretches."""

    def run(spark, d):
        chunks, items = chunk_table(spark, d), aligned(spark, d)
        length = F.col("end_ms") - F.col("start_ms")
        halves = chunks.select("track", "chunk", F.explode(F.array(F.struct((length * 0).alias("start_ms"), F.floor(length / 3).alias("end_ms")), F.struct(F.floor(length / 2).alias("start_ms"), length.alias("end_ms")))).alias("r")).select("track", "chunk", "r.*")
        return rp.replayed(chunks, items.filter("chunk % 3 > 0"), items.filter("chunk % 6 < 4"), halves, mode=mode, frame_native=frame_native, most=MOST, longest_ms=LONGEST_MS, least_ms=LEAST_MS, usual_ms=USUAL_MS, most_ms=CHARACTER_MS)

    return run


QUERIES = {
    "tx14_kept_together": (together, None),
    "g09_budget_pieces": (lambda s, d: cu.budget_pieces(*streams(s, d), MOST, MOST, LONGEST_MS).select("track", "chunk", "unit", "i", "piece"), None),
    "g10_without_filler_runs": (lambda s, d: cu.without_filler_runs(*streams(s, d), MOST).select("track", "chunk", "unit", "i", "shown"), None),
    "g11_aligned_cues": (aligned_cues(), None),
    "u08_soft_cues": (aligned_cues(ellipses_end=False), None),
    "g16_replayed": (replay("aligner_fallback"), None),
    "g16_replayed_frames": (replay("vad_only", True), None),
    "a09_unit_faults": (lambda s, d: sg.unit_faults(spoken(s, d), aligned(s, d), CHARACTER_MS, MOST), None),
}
