"""Cue tables derived from the given tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import compact
from ..functions.times import display_duration
from ..operators.intervals import SLOT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(t: DataFrame, key: str, at: Column, *order: str, width: int = SLOT) -> DataFrame:
    """Adds ``pos``, the place of a row (from 1) among those of its key by ``order``. Rows are dealt out by slots of ``at``, milliseconds that rise with the order, and
    counted from the rows of earlier slots (one number a slot), so a key of any number of rows is many tasks."""
    t = t.withColumn("_slot", F.floor(at / width))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col(key).alias("_key"), F.col("_slot").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    t = t.join(F.broadcast(counts), t[key].eqNullSafe(counts["_key"]) & t["_slot"].eqNullSafe(counts["_of"]))
    place = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(*order)) + F.col("_before")
    return t.withColumn("pos", place.cast("int")).drop("_slot", "_key", "_of", "_before")


def cue_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000
    t = numbered(t, "event_type", start, "ts", "event_id")
    return t.select(F.col("event_type").alias("track"), "pos", start.alias("start_ms"), (start + F.round(F.col("value") * 20000).cast("long")).alias("end_ms"), F.col("props").alias("text"))


def cue_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    pos = F.col("p") + 1
    t = t.select("track", pos.alias("pos"), "text", display_duration(F.length(compact(F.col("text")))).cast("long").alias("dur"), F.when(pos % 7 == 0, 12000).when(pos % 3 == 0, 0).otherwise(400).alias("pause"))
    w = Window.partitionBy("track").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("pause")).over(w), F.lit(0)).cast("long")
    return t.select("track", "pos", start.alias("start_ms"), (start + F.col("dur")).alias("end_ms"), "text")


def cue_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cue_doc(spark, sf_dir).filter("pos % 11 <> 0")
    n = F.length("text")
    text = F.when(F.col("pos") % 5 == 0, F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int"))).otherwise(F.col("text"))
    return t.select("track", "pos", (F.col("start_ms") + 150).alias("start_ms"), (F.col("end_ms") + 150).alias("end_ms"), text.alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("pos"), "role", "text")


def signal_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.select(F.col("user_id").alias("track"), frame.alias("frame"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


TERMS = (("the", "DER", ("die",)), ("then", "DANN", ("da",)), ("and", "UND", ("oder",)), ("an", "EIN", ("eine",)), ("for", "FUER", ("vor",)), ("de la", "VON DER", ("of",)), ("la", "LA", ("lo",)))


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, list(c)) for a, b, c in TERMS], "source string, target string, forbidden array<string>")


EV = """
cue_ev as (select event_type track, row_number() over (partition by event_type order by ts, event_id)::int pos, epoch_us(ts) // 1000 - 1704067200000 start_ms,
  epoch_us(ts) // 1000 - 1704067200000 + round(value * 20000)::bigint end_ms, props text from events)"""
DOC = r"""
cue_l as (select doc_id track, unnest(l) text, unnest(range(1, len(l) + 1))::int pos from (select doc_id, string_split(text, chr(10)) l from documents)),
cue_m as (select *, greatest(800, least(length(regexp_replace(text, '[\x20\x09-\x0D\x{3000}]+', '', 'g')) * 280, 8000))::bigint dur,
  case when pos % 7 = 0 then 12000 when pos % 3 = 0 then 0 else 400 end pause from cue_l),
cue_n as (select track, pos, text, dur, coalesce(sum(dur + pause) over (partition by track order by pos rows between unbounded preceding and 1 preceding), 0)::bigint start_ms from cue_m),
cue_doc as (select track, pos, start_ms, start_ms + dur end_ms, text from cue_n)"""
ALT = DOC + """,
cue_alt as (select track, pos, start_ms + 150 start_ms, end_ms + 150 end_ms, case when pos % 5 = 0 then substr(text, 1, length(text) - length(text) // 3) else text end text
  from cue_doc where pos % 11 <> 0)"""
TURNS = "turns as (select conv_id track, turn pos, role, text from conversations)"
SIGNAL = "signal as (select user_id track, row_number() over (partition by user_id order by ts, event_id)::int - 1 frame, least(1.0, value / 100) prob from events)"
TERM_ROWS = "terms as (select * from (values " + ", ".join(f"('{a}', '{b}', [{', '.join(repr(x) for x in c)}])" for a, b, c in TERMS) + ") t(source, target, forbidden))"
