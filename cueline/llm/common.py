"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import shared_dir

#: One word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    path = f"{shared_dir(df.sparkSession)}/cueline/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more. Only whole folders of ours, which no plan that is still to run refers to."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/cueline/" in folder:
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of at most 256 rows and 8 MB, whatever their lengths."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 257):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def long_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a 64-bit number; ids of another kind are refused rather than turned into nulls."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} has to be a whole number, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: str | Column) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def words(col: str | Column) -> Column:
    return F.regexp_extract_all(text_of(col), F.lit(WORD), F.lit(0))


def seeded(seed: int, *cols: str) -> Column:
    """A hexadecimal digest that depends on the seed and the columns alone, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def ranked(rows: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 1 in the order of ``order``, as column ``out``; no task sees them all.

    Rows are dealt out by ranges and sorted, written, and the ranges counted; a window adds the counts up, one row a range.
    """
    mark, before = fresh(rows, "_mark"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))  # range << 33 | row
    ranges = placed.groupBy(F.shiftright(mark, 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(ranges, F.shiftright(mark, 33) == F.col("_range")).select(*rows.columns, number.alias(out))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
