"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, discarded, documents, fresh, small_batches, text_of, written

LEAST, MEAN, MOST = 256, 1024, 8192
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text. A place is a candidate if a rolling hash of the 32 bytes before it is 0 modulo ``mean``."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for by in (1, 2, 4, 8, 16):  # after the last, h[i] covers bytes i-31 to i
        h[by:] += h[:-by] << np.uint32(by)
    at, ends = 0, []
    for c in (np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + 1).tolist():
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            ends.append(at := c)
    while n - at > most:
        at += most
        ends.append(at)
    return ends + [n] * (at < n)


def chunks_of(texts: pd.Series) -> pd.Series:
    def cut(text: str) -> list[bytes]:
        data = text.encode()
        ends = chunk_ends(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    return texts.map(cut)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are cut once at content-defined places and written with the digests of their chunks. Each distinct chunk moves
    once from a map task, to verify that its digest stands for one content; from then on only the ordered lists of chunk
    identifiers are compared and no text moves.
    Null text counts as empty (all empty texts are one group, with an empty list). Of rows equal in id and text one
    stays. Null ids stay only if the whole group has none. An empty table gives no rows.
    """
    return _groups(docs, id_col, text_col, verify)[0]


def _groups(docs: DataFrame, id_col: str, text_col: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """``exact_groups`` and the table of cut texts that it reads."""
    small_batches(docs.sparkSession)
    norm = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.pandas_udf(chunks_of, T.ArrayType(T.BinaryType()))("norm").alias("chunks"))
    cut = written(cut.select("doc_id", "text_sha256", "chunks", F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("recipe")))
    if verify:
        store = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).select(F.col("c.recipe").alias("chunk_id"), F.col("c.chunks").alias("chunk")).distinct()
        if not store.groupBy("chunk_id").count().filter("count > 1").isEmpty():
            raise ValueError("two chunks share one digest")
    recipes = cut.select("doc_id", "text_sha256", "recipe")
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id"))
    rows = recipes.withColumn("_nth", nth).join(groups.withColumn("_many", F.lit(True)), "recipe", "left")
    keep = F.when(F.col("_many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("_nth") == 1)).alias("kept"), "text_sha256"), cut


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names.

    The decision is made on ids and digests; texts move once, to be met with it. Only rows that repeat id and text
    (``exact_groups`` keeps one) are sorted out by an aggregation of their own.
    """
    found, cut = _groups(docs, id_col, text_col)
    groups = written(found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("again")))
    discarded(cut)
    sha = fresh(docs, "_sha")
    keyed = docs.withColumn(sha, F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256))
    met = lambda keep: keyed.join(keep, keyed[id_col].eqNullSafe(keep["doc_id"]) & (keyed[sha] == keep["text_sha256"]), "left_semi")
    once, again = groups.filter("kept and not again"), groups.filter("kept and again")
    if again.isEmpty():
        return met(once).drop(sha)
    return met(once).unionByName(met(again).dropDuplicates([id_col, sha])).drop(sha)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256)
"""
