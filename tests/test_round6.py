"""Measures of lines that once went character by character: against plain loops, and without functions of single characters in the plan."""

import re

from pyspark.sql import functions as F

from cueline.functions import normal as nm
from cueline.functions import text as tx
from cueline.plans.queries import QUERIES
from cueline.sources import subtitles as sub

LINES = ["", "a", "ab cd", "x" * 41, "a " * 30, "y" * 39 + " " + "z" * 42, "y" * 40 + " " + "z" * 40 + " " + "x", "w" * 37 + " " + "v" * 5 + " " + "u" * 37, "é😀 " * 20, "one, two. " * 9, "。" + "b" * 50, "c" * 50 + "!", " " * 60, "a" * 8 + "bc", "a" * 7 + "bcd", "a" * 5 + "bc" * 6, "aabb" * 6, None]


def broken(t, most, marks, blanks):
    places = [i for i in range(1, len(t)) if t[i - 1] in marks]
    if len(t) <= most or not places:
        return t
    i = min(places, key=lambda i: (blanks and (i - 1 > most or len(t) - i > most), abs(2 * i - len(t)), i))
    return t[: i - 1] + "\n" + t[i:] if blanks else t[:i] + "\n" + t[i:].lstrip(tx.SPACES)


def test_lines_break_at_the_best_place(spark):
    t = spark.createDataFrame([(x,) for x in LINES], "text string")
    got = t.select("text", tx.wrap_at_marks(F.col("text"), 40).alias("marks"), tx.wrap_at_blanks(F.col("text"), 40).alias("blanks")).collect()
    for r in got:
        assert r.marks == (None if r.text is None else broken(r.text, 40, ".!?,;。！？、", False))
        assert r.blanks == (None if r.text is None else broken(r.text, 40, " ", True))


def test_a_share_of_more_than_half_is_seen(spark):
    t = spark.createDataFrame([(x,) for x in LINES], "text string")
    for r in t.select("text", tx.mostly_one(F.col("text"), 0.8).alias("most"), tx.dominant_share(F.col("text")).alias("share")).collect():
        assert r.most == (None if r.text is None else r.share >= 0.8)


def test_filters_ask_no_function_of_single_characters(spark):
    t, x = spark.range(1).select(F.col("id").cast("string").alias("text")), F.col("text")
    plan = t.select(tx.wrap_at_marks(x, 40), tx.wrap_at_blanks(x, 40), tx.noise(x), tx.looping(x))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_measures_of_characters_in_batches(spark):
    t = spark.createDataFrame([(x,) for x in LINES if x is not None] + [(" \t\u3000",), ("\U0001F600\U0001F601" * 3,)], "text string")
    x = F.col("text")
    for r in t.select("text", nm.pair_counts(x).alias("n"), F.size(tx.bigrams(x)).alias("pairs"), nm.dominant_share(x).alias("got"), tx.dominant_share(x).alias("share")).collect():
        assert (r.n, r.got) == (r.pairs, r.share)


def test_overlong_lines(spark):
    lines = [*LINES, "a" * 60, "a" * 61, "a" * 60 + "\n" + "b" * 60, "a\n" + "b" * 61 + "\n", "\U0001F600" * 60, "\U0001F600" * 61, "a" * 30 + "\r" + "b" * 31, "a" * 30 + "\u2028" + "b" * 30, "\n" * 70]
    t = spark.createDataFrame([(x,) for x in lines], "text string")
    for r in t.select("text", tx.overlong(F.col("text"), 60).alias("got")).collect():
        assert r.got == (None if r.text is None else any(len(x) > 60 for x in r.text.split("\n")))


def test_columns_and_converted_ask_no_pairs_by_lambda(spark):
    d = "/root/testdata/sf0.001"
    for name, gone in (("tx_columns", "array_intersect"), ("tx_converted", "exists(split")):
        assert gone not in QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_strict_scan_parses_each_block_once(spark):
    body = "1\n00:00:01,000 --> 00:00:02,000\na\n\n1\n00:00:03,000 --> 00:00:04,000\nb\n\nx\n00:00:05,000 --> 00:00:06,000\nc\n\n2\n00:00:09,000 --> 00:00:08,000\nd\n\n2\n00:00:09,000 --> 00:00:10,000\ne"
    cues, status = sub.strict_cues(spark.createDataFrame([("f", body), ("g", "")], "file string, text string"))
    assert sorted((r.file, r.block, r.id, r.text) for r in cues.collect()) == [("f", 0, "1", "a"), ("f", 4, "2", "e")]
    assert sorted((r.file, r.status, r.cues, r.rejected) for r in status.collect()) == [("f", "partial_invalid", 2, 3), ("g", "empty", 0, 0)]
    plan = cues._jdf.queryExecution().optimizedPlan().toString()
    assert not [node for node in re.split(r"\n *\+- ", plan) if node.startswith("Filter") and "RLIKE" in node]
