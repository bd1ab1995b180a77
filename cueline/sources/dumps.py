"""Scans of recogniser dumps and run metadata (JSON), file inventories and digests, and sinks of reviews and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals

ITEM = "array<struct<text:string,start:double,end:double>>"
CHUNK = f"start:double,end:double,keep_lo:double,keep_hi:double,text:string,clean_text:string,raw_text:string,language:string,segments:int,seconds:double,speech_regions:array<array<double>>,regroup_regions:array<array<double>>,items:{ITEM},raw_items:{ITEM},sentinel:struct<status:string>,recovery:struct<applied:boolean,strategy:string>,superseded_by_stepdown:boolean"
DUMP = f"struct<duration:double,chunk_seconds:double,chunk_overlap_seconds:double,text_backend:string,timestamp_mode:string,context:string,chunks:array<struct<{CHUNK}>>>"


def _ms(x: Column | str) -> Column:
    return F.bround((F.col(x) if isinstance(x, str) else x) * 1000).cast("long")


def dump_chunks(files: DataFrame) -> DataFrame:
    """One row a chunk of the dumps in ``text``: ``file, chunk, start_ms, end_ms, keep_lo, keep_hi, text, items, raw_items, regions, regroup, status``.

    Chunks that a later run replaced are left out. The window that a chunk keeps is open (null) at the end of a recording;
    where a dump lacks it, it is rebuilt from the step between chunks. Files that are no dumps have no rows.
    """
    d = files.select("file", F.from_json("text", DUMP).alias("d")).select("file", "d.*")
    t = d.select("file", "duration", (F.col("chunk_seconds") - F.coalesce("chunk_overlap_seconds", F.lit(0.0))).alias("step"), F.posexplode("chunks").alias("chunk", "c")).filter(~F.coalesce("c.superseded_by_stepdown", F.lit(False)))
    lo = F.coalesce("c.keep_lo", "c.start")
    hi = F.when(F.col("c.keep_lo").isNotNull(), F.col("c.keep_hi")).when(F.col("c.end") < F.col("duration") - 0.001, F.col("c.start") + F.col("step"))
    return t.select("file", "chunk", _ms("c.start").alias("start_ms"), _ms("c.end").alias("end_ms"), _ms(lo).alias("keep_lo"), _ms(hi).alias("keep_hi"), F.coalesce("c.clean_text", "c.text", "c.raw_text").alias("text"), F.coalesce("c.items", "c.raw_items").alias("items"), F.coalesce("c.raw_items", "c.items").alias("raw_items"), F.col("c.speech_regions").alias("regions"), F.col("c.regroup_regions").alias("regroup"), F.col("c.sentinel.status").alias("status"))


def dump_items(chunks: DataFrame, column: str = "items") -> DataFrame:
    """One row an aligned item, in milliseconds of its chunk; items without times are left out."""
    t = chunks.select("file", "chunk", F.posexplode(column).alias("pos", "i")).filter("i.start is not null and i.end is not null")
    return t.select("file", "chunk", "pos", F.col("i.text").alias("word"), _ms("i.start").alias("start_ms"), _ms("i.end").alias("end_ms"))


def speech_regions(files: DataFrame) -> DataFrame:
    """The union of the speech regions of each file's chunks, counted from the recording's start: ``file, start_ms, end_ms``.

    Whatever is malformed is left out: texts that are no objects, chunks without a list of regions, regions of fewer than two
    numbers or of no length; a chunk without a readable start begins at 0."""
    chunks = F.from_json("text", "struct<chunks:array<string>>").getField("chunks")
    t = files.select("file", F.explode(chunks).alias("c"))
    t = t.select("file", F.from_json("c", "struct<start:string,speech_regions:string>").alias("c"))
    regions = F.transform(F.from_json("c.speech_regions", "array<string>"), lambda r: F.from_json(r, "array<string>"))  # each is read once, and exploded before it is asked for its bounds
    t = t.select("file", F.coalesce(F.col("c.start").try_cast("double"), F.lit(0.0)).alias("base"), F.explode(regions).alias("r")).filter(F.size("r") >= 2)
    a, b = (F.col("base") + F.get("r", F.lit(k)).try_cast("double") for k in (0, 1))
    t = t.select("file", _ms(F.greatest(a, F.lit(0.0))).alias("start_ms"), _ms(b).alias("end_ms"), a.alias("s"))
    return merge_intervals(t.filter("s is not null and end_ms is not null and end_ms > s * 1000").drop("s"), ["file"])


def reconciled_chunks(raw: DataFrame, results: DataFrame, base: Sequence[str], evidence: Sequence[str], keys: Sequence[str] = ("file", "chunk")) -> DataFrame:
    """Chunks of a dump beside those of a run by place: the run's fields count where it has the chunk, the dump's evidence (regions and the
    like) where it is not null."""
    a = raw.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in (*base, *evidence)], F.lit(True).alias("_raw"))
    b = results.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in (*base, *evidence)], F.lit(True).alias("_run"))
    t = a.join(b, list(keys), "full")
    return t.select(*keys, *[F.when(F.col("_run"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in base], *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in evidence])


def inventory(spark: SparkSession, path: str, suffixes: Sequence[str], recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of the files under a folder with one of the suffixes, whatever their case; contents aren't read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*[x.lower() for x in suffixes])
    return t.select("path", "length", "modificationTime").filter(ends)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of each file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def folder_digest(files: DataFrame, folder: str, *columns: str) -> DataFrame:
    """The identity of each folder: a digest of its files' sorted listings. Each listing is digested first, so a folder of very
    many files is an array of short strings."""
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ","), 256).alias("digest"))


def paired_files(files: DataFrame, target: str, legacy: str, source: str) -> DataFrame:
    """Target and source file of each stem by suffix; where a target has only the older suffix, that one: ``stem, target, source, skipped``."""
    of = lambda suffix, name: files.filter(F.endswith("path", F.lit(suffix))).select(F.expr(f"left(path, length(path) - {len(suffix)})").alias("stem"), F.col("path").alias(name))
    t = of(target, "_new").join(of(legacy, "_old"), "stem", "full").join(of(source, "source"), "stem", "full")
    t = t.select("stem", F.coalesce("_new", "_old").alias("target"), "source")
    return t.withColumn("skipped", F.when(F.col("target").isNull(), F.lit("no target")).when(F.col("source").isNull(), F.lit("no source")))


def named_inputs(values: DataFrame) -> DataFrame:
    """``run, path`` of values ``name=path``; without a name the file's stem."""
    name, path = F.regexp_extract("value", r"^([^=]*)=", 1), F.regexp_replace("value", r"^[^=]*=", "")
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return values.select(F.when(F.trim(name) != "", F.trim(name)).otherwise(stem).alias("run"), path.alias("path"))


def selected_parts(parts: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples selected of several references (parts: reference, kind, id), and what is wrong: unknown ids, ids chosen twice, mixed kinds."""
    good = samples.join(parts.select("reference", "id").distinct(), ["reference", "id"], "left_semi")
    unknown = parts.join(samples, ["reference", "id"], "left_anti").select("id", F.lit("unknown").alias("kind"))
    twice = parts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("kind"))
    mixed = parts.agg(F.count_distinct("kind").alias("n")).filter("n > 1").select(F.lit(None).cast(parts.schema["id"].dataType).alias("id"), F.lit("mixed kinds").alias("kind"))
    return good, unknown.union(twice).union(mixed)


def review_rows(cues: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """A review file a track, as JSON: schema, number of flagged cues, the cues in order."""
    each = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in cues.columns if c not in (*keys, "pos")]))).alias("cues"))
    return each.select(*keys, F.to_json(F.struct(F.lit(1).alias("schema"), F.size("cues").alias("review_count"), "cues")).alias("value"))


def term_review(issues: DataFrame, keys: Sequence[str] = ("track", "pos")) -> DataFrame:
    """Per cue the expected pairs, and the forbidden words of all its terms, sorted and distinct."""
    pair = F.concat("source", F.lit("->"), "target")
    return issues.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(pair)), ", ").alias("expected"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("forbidden")))), ", ").alias("forbidden"))


def append_metrics(metrics: DataFrame, path: str, label: str, at: Column | None = None) -> None:
    """Add one record a row to a history of metrics, by label and with the time."""
    metrics.withColumns({"label": F.lit(label), "at": F.current_timestamp() if at is None else at}).write.mode("append").partitionBy("label").json(path)


def event_lines(events: DataFrame, name: Column, at: Column, *fields: str) -> DataFrame:
    """Events as JSON lines: schema version, UTC time, name and fields; nulls are left out."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return events.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), stamp.alias("timestamp"), name.alias("event"), *fields)).alias("value"))



def event_rows(lines: DataFrame) -> DataFrame:
    """Lines of an event log (``value``) read back: ``schema_version, at, event, fields`` (all others, as text) and ``fault``: ``invalid JSON``, ``no event`` (no name or no
    time that can be read) or ``schema`` (a version above 1); null lines are invalid. Faulty lines stay, with what could be read."""
    t = lines.withColumn("_m", F.from_json("value", "map<string,string>"))
    valid = F.try_parse_json("value").isNotNull() & F.col("_m").isNotNull()
    version, at = F.col("_m")["schema_version"].try_cast("int"), F.col("_m")["timestamp"].try_cast("timestamp")
    known = ("schema_version", "timestamp", "event")
    fault = F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid JSON")).when(F.col("_m")["event"].isNull() | at.isNull(), F.lit("no event")).when(F.coalesce(version, F.lit(0)) > 1, F.lit("schema"))
    return t.select(version.alias("schema_version"), at.alias("at"), F.col("_m")["event"].alias("event"), F.map_filter("_m", lambda k, v: ~k.isin(*known)).alias("fields"), fault.alias("fault"))
