"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of

#: Rounds work modulo this prime, so every product fits a signed 64-bit number.
PRIME = 2147483647
ROUNDS = 6
SEED = 29


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 1000003 + (i + 1) * 7368787 + 97) % PRIME for i in range(rounds)]


def _encrypt(x: Column, high: Column, low: Column, seed: int) -> Column:
    """One pass of the network on pairs (x div low, x mod low) of Z_high x Z_low; an even number of rounds."""
    state = lambda a, b, ma, mb: F.struct(a.alias("a"), b.alias("b"), ma.alias("ma"), mb.alias("mb"))

    def step(s: Column, key: Column) -> Column:
        t = (s["b"] + key) % PRIME
        mixed = ((t * t + s["b"]) % PRIME * 48271 + key) % PRIME
        return state(s["b"], (s["a"] + mixed) % s["ma"], s["mb"], s["ma"])

    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    first = state(F.floor(x / low).cast("long"), x % low, high, low)
    return F.aggregate(keys, first, step, lambda s: s["a"] * low + s["b"])


def feistel_position(number: Column, rows: Column, seed: int = SEED, walks: int = 64) -> Column:
    """Where the shuffle puts row ``number`` of ``rows`` rows; anyone who knows the three numbers can compute it.

    The domain is high x low with high = ceil(sqrt(rows)) and low = ceil(rows / high): it exceeds ``rows`` by less
    than high, so few numbers leave the range and walk on along their cycle. A walk of more than ``walks`` steps would
    need as many rows outside one after the other (a row leaves the range with odds of about rows ** -0.5, so such a walk has
    odds below rows ** (-walks / 2)); it raises instead of guessing.
    """
    number, rows = number.cast("long"), rows.cast("long")
    high = F.ceil(F.sqrt(rows.cast("double"))).cast("long")
    low = F.ceil(rows / high).cast("long")
    enc = lambda x: _encrypt(x, high, low, seed)
    first = enc(number)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < rows, x).otherwise(enc(x)))
    found = F.when(first < rows, first).otherwise(walked)
    return F.when(found < rows, found).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def global_numbers(rows: DataFrame, id_col: str, out: str = "number") -> DataFrame:
    """Number all rows from 0 without one task that sees them all, and add their count as ``rows``.

    Order: first three digits of md5(id), then id, then the other columns. Buckets by those digits are counted first (4096
    counts at most), then each bucket is numbered on its own. Repeated rows get numbers next to each other.
    """
    keyed = rows.withColumn("_b", F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_b", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("rows"))
    others = [c for c in rows.columns if c != id_col]
    within = Window.partitionBy("_b").orderBy(id_col, *others)
    return keyed.join(counts, "_b").withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_b", "_before")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; law ``rows``.

    Position p of the shuffle goes to shard p mod shards, slot p div shards: counts differ by one at most and slots
    have no gaps. Null text: size 1, CRC of nothing (0). Null and repeated ids are rows like others. Only id, size and
    CRC are shuffled, never texts. An empty table gives no rows.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"), F.crc32(text_of(text_col).cast("binary")).cast("long").alias("text_crc32"))
    t = global_numbers(t, "doc_id").withColumn("_p", feistel_position(F.col("number"), F.col("rows"), seed))
    return t.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def _oracle() -> str:
    """The same law in SQL: a CRC by table over the bytes, the numbers by one sort, the network unrolled, the walk by recursion."""
    enc = "select *, x // low a, x % low b, high ma, low mb from walk where step = 0 or x >= n"
    for k in round_keys(SEED):
        enc = f"select * exclude (a, b, ma, mb, m), b a, (a + m) % ma b, mb ma, ma mb from (select *, ((((b + {k}) % {PRIME}) * ((b + {k}) % {PRIME}) + b) % {PRIME} * 48271 + {k}) % {PRIME} m from ({enc}))"
    return f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
bytes as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) b from documents),
d as (select doc_id, len(b)::bigint + 1 size, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)::bigint text_crc32 from bytes, crc),
numbered as (select *, row_number() over (order by substr(md5(doc_id::varchar), 1, 3), doc_id, size, text_crc32) - 1 x, count(*) over () n, ceil(sqrt(count(*) over ()))::bigint high from d),
walk as (
  select *, ceil(n / high)::bigint low, 0 step from numbered
  union all
  select doc_id, size, text_crc32, a * low + b x, n, high, low, step + 1 from ({enc}))
select doc_id, size, text_crc32, 'rows' law, (x % 8)::int shard, x // 8 slot, null::int grown_shard from walk where step > 0 and x < n
"""


SQL = _oracle()
