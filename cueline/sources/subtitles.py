"""Subtitle files: strict and lenient scans of SRT text, and sinks of SRT and styled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ass_escape, stripped
from ..functions.times import ass_time, parse_srt_time, srt_time


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def srt_blocks(files: DataFrame, all_blocks: bool = False) -> DataFrame:
    """``file, block, id, head, start_ms, end_ms, settings, text, long`` of every block with an arrow in its second line (or of all blocks that
    aren't blank); ``long``: at least three lines. No checks."""
    body = F.regexp_replace(F.regexp_replace("text", "^\\x{FEFF}", ""), "\r\n?", "\n")
    b = files.select("file", F.posexplode(F.split(body, "\n[\\x20\t]*\n+")).alias("block", "b")).withColumn("b", F.regexp_replace("b", "^\n+|\n+$", "")).filter(stripped("b") != "")
    lines = F.split("b", "\n")
    t = b.select("file", "block", stripped(F.get(lines, F.lit(0))).alias("id"), F.get(lines, F.lit(1)).alias("head"), F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n").alias("text"), (F.size(lines) >= 3).alias("long"))
    head = r"^\s*(\S+)\s+-->\s+(\S+)\s*(.*)$"
    part = lambda i: F.regexp_extract("head", head, i)
    kept = F.lit(True) if all_blocks else F.contains(F.coalesce("head", F.lit("")), F.lit("-->"))
    t = t.filter(kept).withColumns({"_from": part(1), "_to": part(2)})
    return t.select("file", "block", "id", "head", parse_srt_time(F.col("_from")).alias("start_ms"), parse_srt_time(F.col("_to")).alias("end_ms"), part(3).alias("settings"), "text", "long")


def strict_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid cues, and a status of each file with its digest: ``not_provided`` (null path), ``missing`` (null text), ``empty``, ``invalid``,
    ``partial_invalid`` or ``valid``; ``rejected`` blocks; ``ordered``, whether starts never fall.

    Rejected: blocks of fewer than three lines, ids that aren't decimal, times that don't match, ends not after starts, empty texts,
    and ids that an earlier valid block of the file has. Cues out of order stay but make a file partly invalid.
    """
    t = srt_blocks(files, all_blocks=True)
    fine = F.col("id").rlike(r"^\d+$") & F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms")) & (stripped("text") != "")
    t = t.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # ``fine`` is no key of the window: a filter on a key is put before it, and the whole scan is then written out for each column that the filter names
    nth = F.sum(F.col("fine").cast("int")).over(Window.partitionBy("file", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("ok", F.col("fine") & (nth == 1))
    falls = F.coalesce(F.col("start_ms") < F.lag("start_ms").over(Window.partitionBy("file").orderBy("block")), F.lit(False))
    order = t.filter("ok").withColumn("_f", falls).groupBy("file").agg(F.count(F.lit(1)).alias("cues"), (~F.bool_or("_f")).alias("ordered"))
    counts = t.groupBy("file").agg(F.count_if(~F.col("ok")).alias("rejected"))
    status = files.select("file", F.sha2("text", 256).alias("sha256"), F.col("text").isNull().alias("_gone")).join(counts, "file", "left").join(order, "file", "left")
    status = status.fillna(0, ["cues", "rejected"]).fillna(True, ["ordered"])
    issues = (F.col("rejected") > 0) | ~F.col("ordered")
    name = F.when(F.col("file").isNull(), "not_provided").when(F.col("_gone"), "missing").when((F.col("cues") == 0) & (F.col("rejected") == 0), "empty").when(F.col("cues") == 0, "invalid").when(issues, "partial_invalid").otherwise("valid")
    return t.filter("ok").drop("fine", "ok"), status.withColumn("status", name).select("file", "status", "cues", "rejected", "ordered", "sha256")


def display_cues(files: DataFrame) -> DataFrame:
    """Cues for display: settings go, each line is trimmed, blank lines go, line breaks stay; no checks of ids or order."""
    lines = F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != "")
    return srt_blocks(files).filter("long").select("file", "block", "id", "start_ms", "end_ms", F.array_join(lines, "\n").alias("text"))


def legacy_cues(files: DataFrame) -> DataFrame:
    """Cues of the older benchmark files: hours of two digits, times anywhere in the second line, lines joined by a blank."""
    time = r"(\d\d:\d\d:\d\d,\d\d\d)"
    head = f"{time} --> {time}"
    t = srt_blocks(files).filter(F.col("long") & F.col("head").rlike(head))
    ms = lambda i: parse_srt_time(F.regexp_extract("head", head, i))
    return t.select("file", "block", ms(1).alias("start_ms"), ms(2).alias("end_ms"), F.translate("text", "\n", " ").alias("text"))


def ass_cues(files: DataFrame) -> DataFrame:
    """Dialogue lines of styled subtitles that have a source line: its text without overrides, line breaks as blanks."""
    t = files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line", "s")).filter(F.startswith("s", F.lit("Dialogue:")))
    f = F.split(F.regexp_replace("s", r"^Dialogue:\s*", ""), ",", 10)
    body, mark = F.get(f, F.lit(9)), r"\N{\r"
    low = F.substr("body", F.locate(mark, "body") + len(mark))
    ms = lambda x: F.round((F.split(x, ":")[0].cast("double") * 3600 + F.split(x, ":")[1].cast("double") * 60 + F.split(x, ":")[2].cast("double")) * 1000).cast("long")
    t = t.select("file", "line", ms(stripped(F.get(f, F.lit(1)))).alias("start_ms"), ms(stripped(F.get(f, F.lit(2)))).alias("end_ms"), body.alias("body")).filter(F.locate(mark, "body") > 0)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^[^}]*\}", ""), r"\{[^}]*\}", ""), r"\\[Nn]", " ")
    return t.select("file", "line", "start_ms", "end_ms", text.alias("text")).filter("text <> ''")


def cue_counts(files: DataFrame) -> DataFrame:
    """Lines with an arrow in each file; -1 where there is no text."""
    return files.select("file", F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.split("text", r"\r?\n"), lambda x: F.contains(x, F.lit("-->"))))).alias("cues"))


def complete_pairs(targets: DataFrame, sources: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Whether each target has as many cues as its source, and any at all."""
    t = targets.join(sources.withColumnRenamed("cues", "source_cues"), list(keys), "left")
    return t.withColumn("complete", F.coalesce((F.col("cues") > 0) & (F.col("cues") == F.col("source_cues")), F.lit(False)))


def _joined(rows: DataFrame, sep: str) -> DataFrame:
    return rows.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "out"))), lambda x: x["out"]), sep).alias("value"))


def srt_rows(cues: DataFrame) -> DataFrame:
    """``track, n, value``: the SRT block of each cue, ordered and numbered from 1; one row a cue, so a track has any length."""
    n = F.row_number().over(Window.partitionBy("track").orderBy("start_ms", "end_ms", "pos"))
    out = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.withColumn("n", n).select("track", "n", out.alias("value"))


def srt_text(cues: DataFrame) -> DataFrame:
    """``track, value``: the SRT text of each track in one value, for tracks that fit one; else ``srt_rows`` and ``write_rows``."""
    return _joined(srt_rows(cues).withColumnRenamed("value", "out"), "\n")


#: The header of a styled file, with the four styles of target lines (plain, two voices) and source lines.
STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
STYLE_TAIL = "&H00000000,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,20,20,20,1"
STYLES = (("TL", 60, "&H00FFFFFF"), ("TL_M", 60, "&H00FFE0A0"), ("TL_F", 60, "&H00C0B0FF"), ("SL", 40, "&H00D0D0D0"))


def ass_header(font: str = "Sans", width: int = 1920, height: int = 1080, styles: Sequence[tuple[str, int, str]] = STYLES) -> str:
    return "\n".join([
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "",
        "[V4+ Styles]", STYLE_FORMAT, *[f"Style: {name},{font},{size},{colour},{STYLE_TAIL}" for name, size, colour in styles], "",
        "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    ])


def style_of(voice: Column) -> Column:
    return F.when(voice == "M", F.lit("TL_M")).when(voice == "F", F.lit("TL_F")).otherwise(F.lit("TL"))


def ass_rows(pairs: DataFrame, voice: Column | None = None) -> DataFrame:
    """``track, n, value``: a dialogue line for each cue, the target text over the source text if there is one."""
    both = F.concat(ass_escape(F.col("text")), F.when(F.col("source_text") == "", F.lit("")).otherwise(F.concat(F.lit("\\N{\\rSL}"), ass_escape(F.col("source_text")))))
    style = F.lit("TL") if voice is None else style_of(voice)
    return pairs.select("track", F.col("pos").alias("n"), F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(","), style, F.lit(",,0,0,0,,"), both).alias("value"))


def ass_text(pairs: DataFrame, voice: Column | None = None, header: str | None = None) -> DataFrame:
    """``track, value``: header and dialogue lines of each track in one value."""
    t = _joined(ass_rows(pairs, voice).withColumnRenamed("value", "out"), "\n")
    return t.withColumn("value", F.concat(F.lit((header or ass_header()) + "\n"), "value", F.lit("\n")))


def write_rows(rows: DataFrame, path: str, files: int = 200) -> None:
    """Text files of rows (track, n, value) in order: one folder a track, long tracks in several files whose names sort."""
    rows.repartitionByRange(files, "track", "n").sortWithinPartitions("track", "n").select("track", "value").write.partitionBy("track").text(path)


def write_tracks(texts: DataFrame, path: str) -> None:
    """One folder a track."""
    texts.write.partitionBy("track").text(path)
