"""Quality rules: base rules and robust multivariate outliers (minimum covariance determinant) by language and source. Native."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, words, written

SYMBOLS = "#*$%&|<>"
#: Features are fixed-point numbers: sums over a group are then exact, whatever the order of its rows.
UNIT = 1000
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Standard deviations below which a feature isn't told apart (most texts have no symbol at all), as features.
FLOORS = (0.4, 0.5, 0.15, 0.15)
SHARE = 0.75
#: Searches for the least determinant: from medians, and from STARTS random subsets of about PICKED rows each. After TRIALS
#: steps the BEST of each group go on until no determinant falls, STEPS steps at most.
STARTS, PICKED, TRIALS, BEST, STEPS, SEED = 5, 10, 2, 2, 12, 23
LEAST_GROUP = 20
#: A row is judged in the first of these groups that has ``LEAST_GROUP`` rows; the last takes what is left, whatever its size.
LEVELS = (("lang", "source"), ("lang",), ())
#: Squared distance beyond which a vector is rejected; chi-square with four degrees passes it once in a million.
CUTOFF = 33.4


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: ``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``."""
    text = text_of(text_col)
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("_t"), words(text_col).alias("_w"))
    n = F.size("_w")
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    t = t.withColumn("_h", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = lambda x, k: (x["h"] == F.get("_h", k - 1)["h"]) | (x["h"] == F.get("_h", k + 1)["h"])
    t = t.withColumn("_p", F.sort_array(F.transform(F.filter("_h", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
    seen = F.aggregate("_p", F.struct(F.lit(-3).alias("at"), F.lit(0).alias("sum")), lambda s, i: F.struct(i.alias("at"), (s["sum"] + F.least(F.lit(3), i - s["at"])).alias("sum")), lambda s: s["sum"])
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaces = F.length("_t") - F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    return t.withColumn("_l", lines).select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), (F.length("_t") - spaces).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), seen.cast("long").alias("n_repeat_words"), F.size("_l").cast("long").alias("n_lines"),
    )


def features(stats: DataFrame) -> DataFrame:
    """Adds ``x0`` to ``x3``: mean word length, log of symbols per 1000 characters, duplicate-line and repetition shares."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (F.least(per("word_chars", "n_words"), F.lit(50.0)), F.log1p(per("n_symbols", "word_chars") * 1000), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"))
    return stats.withColumns({f"x{i}": F.round(v * UNIT).cast("long") for i, v in enumerate(values)})


def consistency(share: float = SHARE) -> float:
    """Factor that makes the covariance of the central ``share`` of a four-variate normal sample unbiased."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < share else (lo, mid)
    return share / (1 - math.exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))


def _same(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` with those of a table that calls them ``_lang`` and ``_source``; true for no keys."""
    return reduce(lambda a, k: a & rows[k].eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))


def _renamed(params: DataFrame, keys: Sequence[str]) -> DataFrame:
    return params.withColumnsRenamed({k: f"_{k}" for k in keys})


def _cov(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _factor(params: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """From ``m*`` and ``c*_*`` (means, covariances) the rows of the lower Cholesky factor ``l*_*`` and ``logdet``, the
    logarithm of the determinant."""
    for i, j in _cov(p):
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        params = params.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = sum((F.log(f"l{i}_{i}") for i in range(1, p)), F.log("l0_0")) * 2
    return params.select(*keys, "n", *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i, j in _cov(p)], F.round(logdet, 9).alias("logdet"))


def _distances(rows: DataFrame, params: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """Adds ``n`` and ``d2``: squared Mahalanobis distance to the group's centre, by forward substitution; and ``bad2``,
    the same of the vector whose features but the word length are moved to the centre where they are better than it."""
    t = rows.join(_renamed(params, keys), _same(rows, keys), "left").drop(*[f"_{k}" for k in keys])
    away = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(p)]

    def squared(v: Sequence[Column]) -> Column:
        y: list[Column] = []
        for i in range(p):
            rest = v[i]
            for j in range(i):
                rest = rest - F.col(f"l{i}_{j}") * y[j]
            y.append(rest / F.col(f"l{i}_{i}"))
        return sum((x * x for x in y[1:]), y[0] * y[0])

    worse = [away[0], *[F.when(F.col(f"m{i}").isNotNull(), F.greatest(away[i], F.lit(0.0))) for i in range(1, p)]]
    return t.withColumns({"d2": squared(away), "bad2": squared(worse)}).drop(*[c for c in params.columns if c not in (*keys, "n", "start")])


def _moments(p: int) -> list[Column]:
    return [F.count(F.lit(1)).alias("h"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _cov(p)]]


def _estimates(sums: DataFrame, p: int, keys: Sequence[str], widen: float) -> DataFrame:
    """Means and regularised covariances from sums: the floors are added to the diagonal."""
    mean = lambda i: F.col(f"s{i}") / F.col("h")
    cov = lambda i, j: (F.col(f"q{i}_{j}").cast("double") / F.col("h") - mean(i) * mean(j)) * widen + (_floor(i) if i == j else 0.0)
    return sums.filter("h > 0").select(*keys, "n", *[mean(i).alias(f"m{i}") for i in range(p)], *[cov(i, j).alias(f"c{i}_{j}") for i, j in _cov(p)])


def _floor(i: int) -> float:
    return (FLOORS[i] * UNIT) ** 2


def _starts(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Where the searches begin (``start`` from 0): medians with median deviations, and the moments of seeded random subsets."""
    centre = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.median(f"x{i}").alias(f"m{i}") for i in range(p)]).filter("n > 0"))
    near = rows.join(_renamed(centre, keys), _same(rows, keys)).drop(*[f"_{k}" for k in keys])
    spread = near.groupBy(*keys, "n", *[f"m{i}" for i in range(p)]).agg(*[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in range(p)])
    first = spread.select(*keys, F.lit(0).alias("start"), "n", *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(p)], *[(F.pow(F.col(f"d{i}") * 1.4826, F.lit(2)) + _floor(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _cov(p)])
    h = F.xxhash64(F.lit(SEED), "doc_id", *[f"x{i}" for i in range(p)])
    drawn = near.withColumn("_h", h).filter(F.pmod(F.shiftright("_h", 8), F.lit(1 << 40)) * F.col("n") < F.lit(STARTS * PICKED * (1 << 40)))
    drawn = drawn.withColumn("start", (F.pmod("_h", F.lit(STARTS)) + 1).cast("int"))
    return first.unionByName(_estimates(drawn.groupBy(*keys, "start", "n").agg(*_moments(p)), p, [*keys, "start"], 1.0))


def robust_parameters(rows: DataFrame, keys: Sequence[str] = LEVELS[0], share: float = SHARE) -> DataFrame:
    """Centre, factored scatter and ``logdet`` of each group by ``keys``: regularised minimum-covariance-determinant estimates.

    Several searches run side by side for each group. A concentration step keeps the ``share`` of the group with the
    least distances and takes their mean and covariance; the determinants of the searches are compared after TRIALS
    steps, the BEST go on until none falls any more, and the least one of a group counts. The floors on the diagonal
    keep scatters regular where most texts agree in a feature (no symbol at all, say).
    One step is one pass over the numbers: moments are summed by group, search and bin of distance (at most 1024 bins),
    and running sums over the bins give the nearest rows' moments without a sort; sums are exact integers. What goes from
    step to step is a table of one row a group and search, written to the shared folder: Spark knows its size and
    broadcasts it only if that is small.
    """
    p = len(FEATURES)
    by, widen = [*keys, "start"], consistency(share)
    now = best = written(_factor(written(_starts(rows, keys, p)), p, by))
    for step in range(STEPS):
        t = _distances(rows, now, p, keys).withColumn("bin", F.least(F.lit(1023), F.floor(F.log2(1 + F.col("d2") * 16) * 32)).cast("int"))
        bins = t.filter("start is not null").groupBy(*by, "n", "bin").agg(*_moments(p))
        upto = Window.partitionBy(*by).orderBy("bin")
        names = ["h", *[f"s{i}" for i in range(p)], *[f"q{i}_{j}" for i, j in _cov(p)]]
        sums = bins.select(*by, "n", "bin", *[F.sum(c).over(upto).alias(c) for c in names]).filter(F.col("h") >= F.ceil(F.col("n") * share))
        near = _estimates(sums, p, [*by, "bin"], widen)
        near = near.groupBy(*by, "n").agg(F.min_by(F.struct(*[c for c in near.columns if c not in (*by, "n", "bin")]), "bin").alias("u"))
        after = _factor(near.select(*by, "n", "u.*"), p, by)
        if step < TRIALS:
            now = best = written(after)
            if step == TRIALS - 1:
                rank = F.row_number().over(Window.partitionBy(*keys).orderBy("logdet", "start"))
                now = best = written(now.withColumn("_r", rank).filter(F.col("_r") <= BEST).drop("_r"))
            continue
        was = _renamed(now.select(*by, F.col("logdet").alias("_was")), by)
        now = written(after.join(was, _same(after, by)).filter("logdet < _was - 1e-6").select(*after.columns))
        if now.isEmpty():
            break
        best = best.unionByName(now)
    least = best.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in best.columns if c not in keys]), F.struct("logdet", "start")).alias("u"))
    return written(least.select(*keys, "u.*").drop("start"))


def quality(docs: DataFrame, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """Statistics, base rules and verdict of every row; see ``statistics``. Adds ``distance2, base_failed, kept``.

    Windows of words are compared by a hash of 64 bits.

    A vector is rejected if its robust squared distance within its group exceeds ``cutoff`` and it lies on the bad side:
    the distance still exceeds it when fewer symbols, duplicate lines or repetitions than the centre has count as the
    centre's; word lengths are odd either way. The group is the language and source, or, with fewer than ``LEAST_GROUP``
    rows that pass the base rules, the language, or all rows. Rows that fail the base rules don't shape the estimates. Null
    language or source is a group of its own; null or empty text fails the base rules. No rows in, no rows out.
    """
    rows = written(features(statistics(docs, **columns)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    fine, left, judged = rows.filter("not base_failed"), rows, []
    for keys in LEVELS:
        here = fine
        if judged and keys:  # only the wider groups that somebody needs
            here = fine.join(_renamed(left.select(*keys).distinct(), keys), _same(fine, keys), "left_semi")
        far = _distances(left, robust_parameters(here, keys), len(FEATURES), keys)
        enough = F.coalesce(F.col("n") >= LEAST_GROUP, F.lit(False)) if keys else F.lit(True)
        judged.append(far.filter(enough))
        left = written(far.filter(~enough).select(*rows.columns))
        if left.isEmpty():
            break
    odd = F.coalesce((F.col("d2") > cutoff) & (F.col("bad2") > cutoff), F.lit(False))
    far = reduce(DataFrame.unionByName, judged).withColumn("odd", odd).withColumnRenamed("d2", "distance2")
    return far.withColumn("kept", ~F.col("base_failed") & ~F.col("odd")).drop("odd", "bad2", "n", *[f"x{i}" for i in range(len(FEATURES))])


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The verdict goes by id, text (its 64-bit hash), language and source, so a row never stays or goes for another
    one that has its id, or none; rows equal in all four have one verdict. Null texts go."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    judged = quality(docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")))
    bad = written(judged.filter("not kept").select("doc_id.*").distinct()).select(*[F.col(c).alias(f"_bad_{c}") for c in ("id", "hash", "lang", "source")])
    own = (docs[id_col], F.xxhash64(text_of(docs[text_col])), docs[lang_col], docs[source_col])
    same = reduce(lambda x, y: x & y, (c.eqNullSafe(bad[f"_bad_{n}"]) for c, n in zip(own, ("id", "hash", "lang", "source"))))
    return docs.join(bad.hint("merge"), same, "left_anti")  # as it has to be for many rows: a copy at each task only while they are few


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))
