"""Importance resampling towards a target: hashed word features, log ratios of two corpora, draws by Gumbel keys."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, ranked, small_batches, text_of, written

LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Lower-cases A to Z; every ASCII byte that is neither a letter nor a digit becomes a blank. Bytes of longer UTF-8 sequences stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCORES = "doc_id {id}, text_hash long, n_words long, n_features long, weight long, score long"


def features(text: bytes, longest: int = LONGEST) -> tuple[int, Counter]:
    """Number of words, and how often each CRC-32 of a run of 1 to ``longest`` words occurs; the CRC of a run seeds that of the next longer one."""
    words = text.translate(TABLE).split()
    seeds = [*map(zlib.crc32, words)]
    found = Counter(seeds)
    for k in range(1, longest):
        seeds = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(seeds, words[k:])]
        found.update(seeds)
    return len(words), found


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts by bucket. Each task adds up its own counter, of at most ``buckets`` entries."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                for crc, n in features(text, longest)[1].items():
                    total[crc % buckets] += n
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([*total.values()], pa.int64())], ["bucket", "n"])

    return texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A bucket's gain: floor of 1000 times the log ratio of its smoothed shares in the target and in the corpus. Both tables have at most ``buckets`` rows."""
    s, t = [0.0] * buckets, [0.0] * buckets
    for into, rows in ((s, counts), (t, target)):
        for r in rows.collect():
            into[r.bucket] = float(r.n)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)]


def gumbel(seed: int, doc_id: object) -> int:
    """The key of a document's draw, from the seed and its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    The highest scores (importance plus Gumbel key: drawing without replacement in proportion to the importance) of the documents of at least
    ``least_words`` words are drawn, ``percent`` of a hundred of them, ties to the smaller id and then to the smaller hash of the text. Counts, ranks and
    scores are over all rows; two numbers a bucket are all that comes to the driver. Null text: no words. Null ids are ranked after other ids of the same
    score. Rows that repeat an id have the same key and count each. An empty table gives no rows; an empty target makes every gain a matter of the corpus alone.
    """
    of_bucket = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, b.column("text").cast(pa.binary()).to_pylist()):
                n_words, found = features(text, longest)
                n = found.total()
                weight = sum(of_bucket[crc % buckets] * k for crc, k in found.items()) // n if n else 0
                rows.append((n_words, n, weight, weight + gumbel(seed, doc_id)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString().replace("void", "long")
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    scored = written(rows.mapInArrow(run, SCORES.format(id=kind))).withColumn("_short", F.col("n_words") < least_words)
    placed = written(ranked(scored, "_place", "_short", F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash"))
    drawn = placed.agg(F.count_if(~F.col("_short"))).first()[0] * percent // 100
    return placed.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", F.when(~F.col("_short") & (F.col("_place") <= drawn), F.col("_place")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn (``importance``), with their columns; of rows equal in id and text as many as are drawn."""
    drawn = importance(docs, target, id_col, text_col, **options).filter("rank is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    own, nth = fresh(docs, "_own"), fresh(docs, "_nth")
    keyed = docs.withColumn(own, F.xxhash64(text_of(text_col)))
    met = keyed.join(drawn, keyed[id_col].eqNullSafe(drawn["_id"]) & (keyed[own] == drawn["_hash"]))
    copies = Window.partitionBy(id_col, own).orderBy(own)
    return met.withColumn(nth, F.row_number().over(copies)).filter(F.col(nth) <= F.col("_n")).select(*[met[c] for c in docs.columns])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")
