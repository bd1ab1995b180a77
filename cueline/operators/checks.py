"""Checks of structured outputs against their sources: ids, lines, records, and what is left to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KANA, degenerate, repeats, stripped, voiced

PLACEHOLDER = "[review]"


def id_mapping(sources: DataFrame, records: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Per key whether records (``number``, ``ids``, ``text``) map the source ids (``id``, ``pos``) without fault: ``issues``, and the ids that are
    missing, unknown, repeated, or deleted (null text).

    Ids of one record have to be neighbours in order, records may not reorder ids, ids may not repeat in the source, and a text
    is null or not blank. A record without ids is an issue of its own.
    """
    s = sources.select(*keys, "id", "pos").withColumns({"_at": F.row_number().over(Window.partitionBy(*keys).orderBy("pos")), "_times": F.count(F.lit(1)).over(Window.partitionBy(*keys, "id"))})
    first = s.groupBy(*keys, "id").agg(F.min("_at").alias("_at"), F.max("_times").alias("_times"))
    used = records.select(*keys, "number", F.col("text").isNull().alias("_gone"), F.posexplode("ids").alias("_k", "id")).join(first, [*keys, "id"], "left")
    by_id = used.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_gone").alias("_gone"))
    both = first.join(by_id, [*keys, "id"], "full")
    picked = lambda c, name: F.array_sort(F.collect_list(F.when(c, F.col("id")))).alias(name)
    ids = both.groupBy(*keys).agg(picked(F.col("_n").isNull(), "missing"), picked(F.col("_at").isNull(), "unknown"), picked(F.col("_n") > 1, "repeated"), picked(F.col("_gone"), "deleted"), F.coalesce(F.bool_or(F.col("_times") > 1), F.lit(False)).alias("_twice"))
    in_order = Window.partitionBy(*keys, "number").orderBy("_k")
    every = Window.partitionBy(*keys).orderBy("number", "_k")
    known = used.withColumns({"_all": F.bool_and(F.col("_at").isNotNull()).over(Window.partitionBy(*keys, "number")), "_step": F.col("_at") - F.lag("_at").over(in_order)})
    apart = known.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_all") & (F.col("_step") != 1)), F.lit(False)).alias("_apart"))
    falls = used.filter("_at is not null").withColumn("_d", F.col("_at") - F.lag("_at").over(every)).groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_d") < 0), F.lit(False)).alias("_falls"))
    bad = records.groupBy(*keys).agg(F.bool_or(F.coalesce(F.size("ids"), F.lit(0)) < 1).alias("_none"), F.bool_or(F.coalesce(stripped("text") == "", F.lit(False))).alias("_blank"))
    t = ids
    for part in (apart, falls, bad):
        t = t.join(part, list(keys), "full")
    kinds = {"source ids repeat": F.col("_twice"), "no ids": F.col("_none"), "blank text": F.col("_blank"), "merged ids apart": F.col("_apart"), "missing": F.size("missing") > 0, "unknown": F.size("unknown") > 0, "repeated": F.size("repeated") > 0, "reordered": F.col("_falls")}
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items()]))
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("missing", "unknown", "repeated", "deleted")]
    return t.select(*keys, F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("valid"), *[F.array_join(F.transform(x, lambda i: i.cast("string")), ",").alias(n) for x, n in zip(lists, ("missing", "unknown", "repeated", "deleted"))])


def checked_lines(blocks: DataFrame, forbidden: Column) -> DataFrame:
    """Blocks (``sources``, ``lines``: arrays) line by line: lines that leak kana, run away or use a forbidden rendering (an array of words for
    the block) become null; ``status`` says accepted, which reasons, or how many lines came for how many."""
    reason = lambda s, x: F.when(x.rlike(KANA), F.lit("kana-leak")).when((x != "") & degenerate(s, x), F.lit("degenerate")).when(F.exists(forbidden, lambda f: F.contains(x, f)), F.lit("glossary"))
    same = F.size("sources") == F.size("lines")
    t = blocks.withColumn("_r", F.when(same, F.zip_with("sources", "lines", reason)))
    found = F.array_sort(F.array_distinct(F.array_compact("_r")))
    status = F.when(~same, F.concat(F.lit("line-count:"), F.size("sources").cast("string"), F.lit("->"), F.size("lines").cast("string"))).when(F.size(found) == 0, F.lit("accepted")).otherwise(F.concat(F.lit("partial-"), F.array_join(found, "+")))
    kept = F.when(same, F.zip_with("lines", "_r", lambda x, r: F.when(r.isNull(), x)))
    return t.withColumns({"checked": kept, "status": status}).drop("_r")


def numbered_lines(raw: Column, count: Column) -> Column:
    """The texts of lines ``[n] text`` in order of n; null unless every line has that form and 1 to ``count`` come once each with a text."""
    lines = F.filter(F.transform(F.split(raw, r"\r?\n"), stripped), lambda x: x != "")
    form = r"^\[(\d{1,6})\]\s*(.*)$"
    parts = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, form, 1).try_cast("int").alias("n"), stripped(F.regexp_extract(x, form, 2)).alias("t")))
    numbers = F.array_sort(F.transform(parts, lambda p: p["n"]))
    fine = F.forall(lines, lambda x: x.rlike(form)) & F.forall(parts, lambda p: p["t"] != "") & (count > 0) & (numbers == F.sequence(F.lit(1), F.greatest(count, F.lit(1))))
    return F.when(fine, F.transform(F.array_sort(parts), lambda p: p["t"]))


def numbered_request(texts: Column) -> Column:
    """Lines ``[001] text`` to be answered one by one; line breaks inside a text become blanks."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), F.lpad((i + 1).cast("string"), 3, "0"), F.lit("] "), F.replace(x, F.lit("\n"), F.lit(" ")))), "\n")


def request(history: Column, terms: Column, texts: Column) -> Column:
    """A request from what came before, matched terms and numbered texts; parts without content are left out."""
    part = lambda title, x: F.when(x != "", F.concat(F.lit(title + "\n"), x))
    return F.concat_ws("\n\n", part("Before:", history), part("Terms:", terms), part("Lines:", numbered_request(texts)))


def json_records(outputs: DataFrame, sources: DataFrame, keys: Sequence[str] = ("track",)) -> tuple[DataFrame, DataFrame]:
    """Model outputs (``raw``: JSON arrays of {ids, text, start, end}) against source cues (``id``, ``start_ms``, ``end_ms``).

    First, per key: ``form`` (ok, invalid JSON, or no array), how many records have other keys, ids that are no list of whole numbers, or times that
    are no whole numbers, and how many claim other times than their sources have. Second, the records whose ids are all known: times
    come from the sources, never from the model; null texts are deletions. Booleans and quoted numbers are no whole numbers.
    """
    whole = r"-?\d+"
    array = F.from_json("raw", "array<string>", {"mode": "PERMISSIVE"})
    form = F.when(F.col("raw").isNull() | F.try_parse_json("raw").isNull(), F.lit("invalid JSON")).when(~stripped("raw").startswith("["), F.lit("no array")).otherwise(F.lit("ok"))
    t = outputs.withColumn("form", form)
    r = t.filter("form = 'ok'").select(*keys, F.posexplode(array).alias("n", "r"))
    names = F.array_sort(F.coalesce(F.json_object_keys("r"), F.array().cast("array<string>")))
    ids, number = F.get_json_object("r", "$.ids"), lambda k: F.col("r").rlike(rf'"{k}"\s*:\s*{whole}\s*[,}}]')
    kind = F.when(names != F.array(*map(F.lit, ("end", "ids", "start", "text"))), F.lit("keys")).when(~ids.rlike(rf"^\[\s*{whole}(\s*,\s*{whole})*\s*\]$"), F.lit("ids")).when(~(number("start") & number("end")), F.lit("times")).otherwise(F.lit("ok"))
    r = r.withColumn("kind", kind)
    good = r.filter("kind = 'ok'").select(*keys, (F.col("n") + 1).alias("number"), F.from_json(ids, "array<bigint>").alias("ids"), F.get_json_object("r", "$.text").alias("text"), F.get_json_object("r", "$.start").cast("long").alias("claimed_start"), F.get_json_object("r", "$.end").cast("long").alias("claimed_end"))
    s = sources.select(*keys, F.col("id").cast("long").alias("_id"), "start_ms", "end_ms")
    each = good.select("*", F.explode("ids").alias("_id")).join(s, [*keys, "_id"], "left")
    by = [*keys, "number", "ids", "text", "claimed_start", "claimed_end"]
    derived = each.groupBy(*by).agg(F.bool_and(F.col("start_ms").isNotNull()).alias("_known"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).filter("_known").drop("_known")
    wrong = derived.filter("claimed_start <> start_ms or claimed_end <> end_ms").groupBy(*keys).agg(F.count(F.lit(1)).alias("time_claims"))
    counts = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("kind") == k).alias(f"bad_{k}") for k in ("keys", "ids", "times")])
    summary = t.select(*keys, "form").join(counts, list(keys), "left").join(wrong, list(keys), "left").fillna(0, ["records", "bad_keys", "bad_ids", "bad_times", "time_claims"])
    return summary, derived.select(*keys, "number", "ids", "text", "start_ms", "end_ms")


def reviewed(df: DataFrame, source: str = "source_text", text: str = "text") -> DataFrame:
    """Adds ``issues`` (empty, kana_residue, degenerate), ``action`` and ``output`` of each translation; a doubtful cue never fails its track.

    Sounds are written out; else an empty or runaway text stays only if its source repeats itself too and it is not too long, and is
    replaced by a placeholder otherwise; else it stays for review."""
    s, t = F.col(source), F.coalesce(text, F.lit(""))
    empty, kana, runaway = stripped(t) == "", t.rlike(KANA), (t != "") & degenerate(s, t)
    issues = F.array_compact(F.array(F.when(empty, F.lit("empty")), F.when(kana, F.lit("kana_residue")), F.when(runaway, F.lit("degenerate"))))
    retained = ~empty & repeats(s, 5, 4) & (F.length(t) <= F.greatest(F.lit(20), F.length(s) * 3))
    action = F.when(F.size(issues) == 0, F.lit("accepted")).when(voiced(s).isNotNull(), F.lit("phonetic_fallback")).when(empty | runaway, F.when(retained, F.lit("retained_source_repetition")).otherwise(F.lit("review_placeholder"))).otherwise(F.lit("retained_for_review"))
    t2 = df.withColumns({"issues": F.array_join(issues, ","), "action": action})
    output = F.when(F.col("action") == "phonetic_fallback", voiced(s)).when(F.col("action") == "review_placeholder", F.lit(PLACEHOLDER)).otherwise(t)
    return t2.withColumn("output", output)


def repeated_outputs(df: DataFrame, keys: Sequence[str] = ("track",), source: str = "source_text", text: str = "text") -> DataFrame:
    """Cues whose output is that of the cue before though their sources differ: to be tried again."""
    w = Window.partitionBy(*keys).orderBy("pos")
    t = df.withColumns({"_t": F.lag(text).over(w), "_s": F.lag(source).over(w)})
    return t.filter((F.col(text) != "") & (F.col(text) == F.col("_t")) & (F.col(source) != F.col("_s"))).drop("_t", "_s")


def left_to_do(wanted: DataFrame, done: DataFrame, keys: Sequence[str], provenance: Sequence[str]) -> DataFrame:
    """Work without a finished record of the very same provenance (null equals null): ``reason`` new or changed."""
    d = done.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *provenance)]).distinct()
    same = lambda cs: [wanted[c].eqNullSafe(d[f"_{c}"]) for c in cs]
    todo = wanted.join(d, same([*keys, *provenance]), "left_anti")
    seen = done.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return todo.join(seen, list(keys), "left").withColumn("reason", F.when(F.col("_seen"), F.lit("changed")).otherwise(F.lit("new"))).drop("_seen")
