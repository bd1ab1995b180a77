"""Streams of events: gap sessions and outcomes per job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    t = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return t.withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(stream: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of each key that a pause of ``gap`` ends; late rows are dropped by the watermark."""
    t = stream.withWatermark("ts", late).groupBy(F.col(key).alias("track"), F.session_window("ts", gap).alias("w"))
    return t.agg(F.count(F.lit(1)).alias("events")).select("track", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "events")


def outcomes(stream: DataFrame, key: str) -> DataFrame:
    """Events by key and kind so far."""
    return stream.groupBy(F.col(key).alias("job"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def job_outcomes(stream: DataFrame, key: str, failed: str, late: str = "1 minute", window: str = "1 day") -> DataFrame:
    """Per day and job: events, failures, and whether the job has any; a day's row comes once its watermark has passed."""
    t = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col(key).alias("job"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == failed).alias("failures")).select(F.unix_millis("w.start").alias("day_ms"), "job", "n", "failures")


PROGRESS = re.compile(r"\[[\w-]+\]\s+(\d+)/(\d+)")
STAGE = "job long, stage string, status string, started_ms long, updated_ms long, took_ms long, done double"


def _latest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    started, updated, status, done = state.get if state.exists else (0, -1, "", -1.0)
    first = last = began = share = None  # rows by time, status and line; a group's rows may come in several parts, in any order
    for pdf in parts:
        for row in zip(pdf["at_ms"].tolist(), pdf["status"], pdf["line"].where(pdf["line"].notna(), "")):
            if row[0] < updated:
                continue
            first, last = min(first or row, row), max(last or row, row)
            if row[1] == "started":
                began = max(began or row, row)
            if PROGRESS.search(row[2]):
                share = max(share or row, row)
    if last:
        if began or not status:
            started, done = (began or first)[0], -1.0
        if share and (not began or share >= began):
            m = PROGRESS.search(share[2])
            done = int(m[1]) / max(1, int(m[2]))
        updated, status = last[0], last[1]
    state.update((started, updated, status, done))
    yield pd.DataFrame([(*key, status, started, updated, updated - started, done if done >= 0 else None)], columns=[c.split()[0] for c in STAGE.split(", ")])


def stage_status(stream: DataFrame) -> DataFrame:
    """Of each job and stage, after each batch, the last status, when the stage began, and the share done, from rows ``job, stage, at_ms, status, line``
    (lines like ``[name] 3/8``). Late rows don't undo a later status."""
    return stream.groupBy("job", "stage").applyInPandasWithState(_latest, STAGE, "started long, updated long, status string, done double", "update", GroupStateTimeout.NoTimeout)


def surviving_cues(stream: DataFrame, window_ms: int, track: str = "string", buckets: int = 16_384) -> DataFrame:
    """Cues (``track, text, pos, start_ms, end_ms``) that stay when repeats within a window of the last *surviving* cue of the text go; cues of one text have
    to come in order of time from batch to batch. State is one number a text and is kept; a stream without end should be cut into tracks that end.

    Each call of a Python function has its price, so texts share it: a group is a bucket of texts by hash, its state the texts seen with their numbers. A text has
    one bucket; ``buckets`` must not change while a stream goes on, and should grow with the texts that are kept."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(a, b): c for a, b, c in zip(*state.get)} if state.exists else {}
        rows: dict[tuple, list[tuple]] = {}
        for pdf in parts:
            for a, b, *cue in zip(*(pdf[c].tolist() for c in ("track", "text", "start_ms", "end_ms", "pos"))):
                rows.setdefault((a, b), []).append(tuple(cue))
        kept = []
        for of, cues in rows.items():
            until = known.get(of)
            for s, e, p in sorted(cues):
                if until is None or s - until > window_ms:
                    until = e
                    kept.append((of[0], p, s, e, of[1]))
            known[of] = until
        state.update(([a for a, _ in known], [b for _, b in known], list(known.values())))
        yield pd.DataFrame(kept, columns=["track", "pos", "start_ms", "end_ms", "text"])

    t = stream.select(F.col("track").cast("string").alias("track"), "text", "pos", "start_ms", "end_ms")  # as strings, so null is one track more
    t = t.withColumn("bucket", F.pmod(F.xxhash64("track", "text"), F.lit(buckets))).groupBy("bucket")
    t = t.applyInPandasWithState(run, "track string, pos int, start_ms long, end_ms long, text string", "tracks array<string>, texts array<string>, until array<long>", "append", GroupStateTimeout.NoTimeout)
    return t.withColumn("track", F.col("track").cast(track))


def drained(result: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and read its result back."""
    out, spark = f"{folder}/{uuid.uuid4().hex}", result.sparkSession
    put = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={k}")
    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows").select(result.columns)
