"""Variable-capacity best-fit packing of documents into sequences."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_words, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of length c: c, a fixed part for handling it, and c * c / ATTENTION for what grows with the square.
#: A full sequence costs 1.14, 1.09, 1.09 or 1.14 a unit at the four lengths, so how well it fills decides.
OVERHEAD, ATTENTION = 64, 32768
BLOCK_ROWS = 20_000


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return capacity + overhead + capacity * capacity / attention


class _Sizes:
    """The sizes still to come, as counts and a bit set of those that occur."""

    def __init__(self, sizes: Sequence[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.mask = sum(1 << s for s in self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.mask &= ~(1 << s)

    def filled(self, room: int) -> int:
        """How much of a room the largest sizes that fit, one after the other, would fill."""
        free, used = room, {}
        below = self.mask & ((1 << (room + 1)) - 1)
        while below:
            s = below.bit_length() - 1
            n = min(self.count[s] - used.get(s, 0), free // s)
            free -= n * s
            used[s] = n
            below &= (1 << min(s, free + 1)) - 1
        return room - free


def best_fit(sizes: Sequence[int], opening: Sequence[int], capacities: Sequence[int], price=cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each size (in the order given; best with the largest first), and of each bin its capacity in the
    end and when it was opened.

    A size goes to the open bin that it leaves fullest. If none has room, the bin sizes of ``opening`` that can hold it
    are weighed against each other: each is filled on trial from the sizes still to come, and the one with the least
    price for what it would hold is opened. In the end each bin shrinks to the least of ``capacities`` that holds its
    contents. Open bins are found in a bit set by the room they have.
    """
    room: dict[int, list[int]] = {}
    mask, bins, at, used, opened = 0, [], [], [], []
    rest = _Sizes(sizes)
    for s in sizes:
        rest.take(s)
        ahead = mask >> s
        if ahead:
            r = s + (ahead & -ahead).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            c = min((c for c in opening if c >= s), key=lambda c: (price(c) / (s + rest.filled(c - s)), c))
            b, r = len(used), c
            used.append(0), opened.append(c)
        bins.append(b), at.append(used[b])
        used[b] += s
        if r > s:
            room.setdefault(r - s, []).append(b)
            mask |= 1 << (r - s)
    return bins, at, [next(c for c in sorted(capacities) if c >= u) for u in used], opened


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, price=cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest ``best_fit`` over all choices of bin sizes to open; never dearer than one length alone.

    The choices are the subsets of the capacities that hold the largest size, so there are few permitted lengths.
    """
    caps = sorted(capacities)
    choices = [[c for k, c in enumerate(caps) if n >> k & 1] for n in range(1, 1 << len(caps))]
    tried = [best_fit(sizes, o, caps, price) for o in choices if not sizes or o[-1] >= max(sizes)]
    return min(tried, key=lambda t: sum(map(price, t[2])))


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, capacities: Sequence[int] = CAPACITIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, piece, size, block, bin, capacity, at`` : one row a piece, where it lies and how long its sequence is.

    Sizes are words plus one separator unless a column is given. What is longer than the largest capacity is cut into
    full pieces and a rest. Pieces are dealt into blocks of about ``block_rows`` by a hash of id, piece and the row's number
    in the table of sizes, so one id on many rows is no large block (the number of blocks grows with the table), and each
    block is packed on its own, largest first: a task holds one block of numbers, no texts. Texts are read once, for their
    sizes. Null or empty texts have size 1; null sizes count as 1. Null ids are
    ids like others, of any type; repeated ids are separate pieces. No rows, no bins.
    """
    size = n_words("text") + 1 if size is None else size
    most = max(capacities)
    t = written(docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row")))
    pieces = t.agg(F.sum(F.floor((F.col("_n") - 1) / most) + 1)).first()[0] or 0
    t = t.select("doc_id", "_n", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))).alias("piece"))
    t = t.select("doc_id", "piece", F.least(F.lit(most), F.col("_n") - F.col("piece") * most).cast("int").alias("size"), F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(max(1, -(-pieces // block_rows)))).alias("block"))

    def one(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        bins, at, caps, _ = pack(block["size"].to_pylist(), capacities)
        for name, values in (("bin", bins), ("capacity", [caps[b] for b in bins]), ("at", at)):
            block = block.append_column(name, pa.array(values, pa.int32()))
        return block

    kind = docs.schema[id_col].dataType.simpleString()
    return t.groupBy("block").applyInArrow(one, f"doc_id {kind}, piece long, size int, block long, bin int, capacity int, at int")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir))
