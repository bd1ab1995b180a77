"""Operators on ordered cues of a track: sessions, neighbours, repeats, two runs, glossaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import edits

ORDER = ("start_ms", "end_ms", "pos")


def _by(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def sessions(df: DataFrame, reset_ms: int, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Adds ``session``: a gap over ``reset_ms`` to the cue before starts a new one; a gap of exactly that doesn't."""
    w = _by(keys, "pos")
    return df.withColumn("_new", F.coalesce((F.col("start_ms") - F.lag("end_ms").over(w) > reset_ms).cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def blocks(df: DataFrame, most: int, reset_ms: int, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Sessions cut into blocks of at most ``most`` cues."""
    s = sessions(df, reset_ms, keys)
    return s.withColumn("block", F.floor((F.row_number().over(_by([*keys, "session"], "pos")) - 1) / most))


def rolling_context(df: DataFrame, n: int, reset_ms: int, keys: Sequence[str] = ("track",)) -> DataFrame:
    """The texts of up to ``n`` cues before, in the session."""
    s = sessions(df, reset_ms, keys)
    return s.withColumn("context", F.collect_list("text").over(_by([*keys, "session"], "pos").rowsBetween(-n, -1)))


def adjacent_duplicates(df: DataFrame, source: DataFrame, keys: Sequence[str] = ("track",), tolerance_ms: int = 250) -> DataFrame:
    """Neighbours whose texts are equal while their sources (same pos, start within the tolerance) differ."""
    s = source.select(*keys, "pos", F.col("text").alias("source_text"), F.col("start_ms").alias("source_start"))
    t = df.join(s, [*keys, "pos"], "left").withColumn("source_text", F.when(F.abs(F.col("start_ms") - F.col("source_start")) <= tolerance_ms, F.col("source_text")))
    w = _by(keys, "pos")
    t = t.withColumns({"_t": F.lag("text").over(w), "_s": F.lag("source_text").over(w)})
    return t.filter((F.col("text") != "") & (F.col("text") == F.col("_t")) & (F.col("source_text") != F.col("_s"))).select(*keys, "pos", "text")


def paired(target: DataFrame, source: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Target cues with the source text of the same pos (the last, if repeated); empty where there is none."""
    s = source.groupBy(*keys, "pos").agg(F.max_by("text", "start_ms").alias("source_text"))
    return target.join(s, [*keys, "pos"], "left").withColumn("source_text", F.coalesce("source_text", F.lit("")))


def mapping_check(target: DataFrame, source: DataFrame, keys: Sequence[str] = ("track",), tolerance_ms: int = 250) -> DataFrame:
    """Per track: cues, ids confirmed by start time, unresolved (repeated ids count as unresolved)."""
    s = source.select(*keys, "pos", F.col("start_ms").alias("s"))
    t = target.join(s, [*keys, "pos"], "left")
    ok = F.when(F.abs(F.col("start_ms") - F.col("s")) <= tolerance_ms, F.col("pos"))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("cues"), F.count_distinct(ok).alias("confirmed")).withColumn("unresolved", F.col("cues") - F.col("confirmed"))


def id_differences(expected: DataFrame, got: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ids that are missing and ids that are unknown."""
    e, g = expected.select(*columns).distinct(), got.select(*columns).distinct()
    return e.join(g, list(columns), "left_anti").withColumn("kind", F.lit("missing")).union(g.join(e, list(columns), "left_anti").withColumn("kind", F.lit("unknown")))


#: A glossary of at most so many bytes is broadcast.
SMALL_GLOSSARY = 1 << 20


def matched_terms(df: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Terms contained in a text, without those contained in a longer matched term.

    A glossary whose measured size is small is compared with every text by broadcast. A larger one is joined by its terms'
    first three characters (those of shorter terms: all) with the distinct runs of characters of each text, so any size
    of glossary works; runs go without their text, which meets only the terms that its runs begin.
    """
    size = terms.agg(F.sum(F.octet_length("source") + 64)).first()[0] or 0
    t = df.select(*keys, "text")
    if size <= SMALL_GLOSSARY:
        hit = t.join(F.broadcast(terms), F.contains(F.col("text"), F.col("source")))
    else:
        head = terms.withColumn("_gram", F.substring("source", 1, 3))
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substr("text", i, F.lit(n)))
        grams = t.select(*keys, F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in (1, 2, 3)])))).alias("_gram"))
        hit = t.join(grams.join(head, "_gram").drop("_gram").distinct(), list(keys)).filter(F.contains(F.col("text"), F.col("source")))
    hit = hit.drop("text")
    many = hit.groupBy(*keys).agg(F.collect_list("source").alias("all"))
    longer = F.exists("all", lambda o: (o != F.col("source")) & F.contains(o, F.col("source")))
    return hit.join(many, list(keys)).filter(~longer).drop("all")


def glossary_issues(df: DataFrame, translated: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched terms whose forbidden renderings occur in the translation."""
    t = matched_terms(df, terms, keys).join(translated.select(*keys, F.col("text").alias("translation")), list(keys))
    return t.filter(F.exists("forbidden", lambda f: F.contains(F.col("translation"), f))).select(*keys, "source", "target")


def edit_rate(reference: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("track",), cells: int = 4_000_000) -> DataFrame:
    """Per track: edits of cues paired by pos (substitutions, insertions, deletions) over the reference's characters; the
    rate is null for an empty reference.

    Where one text begins with the other the edits are what it lacks. Other pairs of up to ``cells`` characters by
    characters are split up by ``normal.edits``; beyond that only the distance is taken (``unsplit`` pairs).
    """
    c = candidate.select(*keys, "pos", F.col("text").alias("c"))
    t = reference.select(*keys, "pos", F.col("text").alias("r")).join(c, [*keys, "pos"], "full").fillna("", ["r", "c"])
    n = F.length("r") - F.length("c")
    easy = F.startswith("r", "c") | F.startswith("c", "r")
    lacks = t.filter(easy).select(*keys, F.length("r").alias("chars"), F.abs(n).alias("edits"), F.lit(0).alias("substitutions"), F.greatest(-n, F.lit(0)).alias("insertions"), F.greatest(n, F.lit(0)).alias("deletions"), F.lit(0).alias("unsplit"))
    hard = t.filter(~easy).select(*keys, F.length("r").alias("chars"), (F.length("r").cast("long") * F.length("c") > cells).alias("_far"), edits("r", "c").alias("e"))
    split = [F.when(~F.col("_far"), F.col(f"e.{c}")).alias(c) for c in ("substitutions", "insertions", "deletions")]
    hard = hard.select(*keys, "chars", (F.col("e.substitutions") + F.col("e.insertions") + F.col("e.deletions")).alias("edits"), *split, F.col("_far").cast("int").alias("unsplit"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("edits", "substitutions", "insertions", "deletions", "chars", "unsplit")]
    t = lacks.union(hard).groupBy(*keys).agg(*sums)
    return t.withColumn("rate", F.when(F.col("chars") > 0, F.round(F.col("edits") / F.col("chars"), 9)))


def unblinded(mapping: DataFrame, votes: DataFrame, key: str = "item") -> DataFrame:
    """Votes for a side (A, B, tie) as votes for a run: mapping has the run of each side (``A``, ``B``); items without a vote have none."""
    t = mapping.join(votes, key, "left")
    return t.withColumn("run", F.when(F.col("vote") == "A", F.col("A")).when(F.col("vote") == "B", F.col("B")).when(F.col("vote") == "tie", F.lit("tie")))


def tally(votes: DataFrame, group: str, candidate: str, baseline: str) -> DataFrame:
    """Wins and losses of the candidate, ties and unvoted by group and in total (null group), with the exact two-sided sign test."""
    n = lambda c, name: F.count_if(c).alias(name)
    t = votes.rollup(group).agg(n(F.col("run") == candidate, "wins"), n(F.col("run") == baseline, "losses"), n(F.col("run") == "tie", "ties"), n(F.col("run").isNull(), "unvoted"))
    return t.withColumn("p", F.round(sign_test(F.col("wins"), F.col("losses")), 6))


def sign_test(wins, losses):
    """Two-sided binomial test against one half: twice the lower tail, 1 at most. Each term comes from the one before, so a group takes as many steps as the lesser
    count; terms are added up over the largest, the last, so none is lost to underflow."""
    n, k = (wins + losses).cast("double"), F.least(wins, losses)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] + F.log((n - i + 1) / i)).alias("term"), (a["sum"] * i / (n - i + 1) + 1.0).alias("sum"))
    last = F.aggregate(F.sequence(F.least(F.lit(1).cast("long"), k), k), start, lambda a, i: F.when(i > 0, step(a, i)).otherwise(a))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last["term"]) * last["sum"] * 2))
