"""Mix sources to target weights: capped water-filling, then whole and fractional repetitions. Native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, n_words, seeded, text_of, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def water_fill(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (columns ``src``, ``source_size``; one row a source).

    Sources in order of ``src`` take the weights in turn. Each asks for its share of all sizes; one that would pass
    ``max_epochs`` times its size stops there and the rest share what is over. In order of cap by weight the clamped
    sources are a prefix, so prefix sums give the fixed point of that redistribution without a loop. A source of
    size 0 gets 0. The windows see one row a source, never documents.
    """
    every = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights)
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "src")
    t = t.select(
        "*",
        F.row_number().over(by_level).alias("at"),
        (F.sum("source_size").over(every) - F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap")).alias("left"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
    )
    t = t.withColumn("clamped", F.col("w") * F.col("left") > F.col("cap") * F.col("open_w"))
    t = t.withColumn("level", F.min(F.when(~F.col("clamped"), F.struct("at", "left", "open_w"))).over(every))
    share = (F.col("w") * F.col("level.left")).cast("double") / F.col("level.open_w").cast("double")
    return t.select("src", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How many times the mix takes each document: ``doc_id, source, text_hash, size, source_size, target, reps, taken``.

    Every document is taken ``floor(target / source_size)`` times; in the seeded order of its source it is taken once
    more while its middle lies within the words still missing, so a source misses its target by half a document at
    most. Running sums go through buckets of the seeded order: a hot source is cut into 4096 parts and no task orders
    it alone. Texts don't move. Null source: a source of its own, last. Null or empty text: size 0, never a cause of division by zero.
    Rows that repeat an id are ordered by size and by the 64-bit hash of their text and count each. An empty table gives no rows.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_of(text_col)).alias("text_hash"), n_words(text_col).alias("size"), src.alias("src"), seeded(seed, id_col).alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    parts = rows.groupBy("src", "bucket").agg(F.sum("size").alias("part"))
    targets = water_fill(parts.groupBy("src").agg(F.sum("part").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("before", F.sum("part").over(earlier) - F.col("part")).join(targets, "src").drop("part")
    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.join(parts, ["src", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    more = F.col("start") + F.col("size") / 2.0 <= F.col("target") - F.col("whole") * F.col("source_size")
    t = t.withColumn("whole", whole).withColumn("reps", F.least(F.col("whole") + more.cast("long"), F.lit(max_epochs).cast("long")))
    return t.select("doc_id", "source", "text_hash", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; columns as in the input.

    The mix is drawn over ids, sizes and hashes and written; texts move once, to be met with it. Rows equal in id, text and source share what they are taken together, the
    first of them once more each. Null ids and sources are values like others; an empty table gives none.
    """
    drawn = mix(docs, id_col, text_col, source_col, **options).groupBy("doc_id", "source", "text_hash").agg(F.sum("reps").alias("_reps"), F.count(F.lit(1)).alias("_rows")).filter("_reps > 0")
    drawn = written(drawn.withColumnsRenamed({"doc_id": "_mix_id", "source": "_mix_source", "text_hash": "_mix_hash"}))
    own, nth = fresh(docs, "_own"), fresh(docs, "_nth")
    keyed = docs.withColumn(own, F.xxhash64(text_of(text_col)))

    def met(some: DataFrame) -> DataFrame:
        return keyed.join(some.hint("merge"), keyed[id_col].eqNullSafe(some["_mix_id"]) & keyed[source_col].eqNullSafe(some["_mix_source"]) & (keyed[own] == some["_mix_hash"]))

    times = lambda t, n: t.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(nth)).drop(nth)
    out, many = times(met(drawn.filter("_rows = 1")), F.col("_reps")), drawn.filter("_rows > 1")
    if many.isEmpty():
        return out
    copies = met(many).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, source_col, own).orderBy(own)))
    copies = copies.withColumn("_reps", F.floor(F.col("_reps") / F.col("_rows")) + (F.col(nth) <= F.col("_reps") % F.col("_rows")).cast("long"))
    return out.unionByName(times(copies.filter("_reps > 0").drop(nth), F.col("_reps")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end src, md5('{SEED}:' || doc_id) k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size
  from documents),
s as (select src, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by src) - 1) % 3 + 1)::int]::bigint w from d group by src),
a as (
  select *, 3 * source_size cap, row_number() over o rn,
         (sum(source_size) over () - sum(3 * source_size) over (o rows unbounded preceding) + 3 * source_size)::bigint rest,
         sum(w) over (o rows between current row and unbounded following)::bigint ow
  from s window o as (order by 3 * source_size / w, src)),
b as (select *, w * rest > cap * ow clamped from a),
l as (select rest, ow from b where not clamped order by rn limit 1),
t as (select src, source_size, case when clamped then cap::double else (w * (select rest from l))::double / (select ow from l)::double end target from b),
r as (
  select d.doc_id, size, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole,
         (sum(size) over (partition by d.src order by k, d.doc_id rows unbounded preceding) - size)::bigint start
  from d join t using (src))
select doc_id, size, source_size, target,
       size * least(3, whole + case when start + size / 2.0 <= target - whole * source_size then 1 else 0 end)::bigint taken
from r
"""
