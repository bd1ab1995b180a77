"""Near-duplicate groups: b-bit MinHash signatures, band candidates, exact confirmation on full sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, long_id, small_batches, text_of, written
from .graph import components

SHINGLE, PERCENT = 5, 80
#: 128 minima; 25 bands of 5: texts at similarity 0.8 share a band but once in 20,000, at 0.85 once in 2 million.
MINIMA, ROWS, BITS = 128, 5, 4
#: Bits of the parity sketch, see ``parities``.
PARITY = 1024
#: What the estimate from the bits may miss the true similarity by: six standard deviations.
MARGIN = 0.21
STAR_ROUNDS = 2
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(11)
_A, _B = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1), _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sets of hashed word shingles; remembers hashes of words, up to a bound."""

    def __init__(self, size: int, remember: int = 500_000):
        self.size, self.most, self.known = size, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles as sorted 64-bit hashes; fewer words than a shingle count as one, no words as none."""
        found, known = _WORDS.findall((text or "").translate(_LOWER)), self.known
        if len(known) > self.most:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(h) == 0:
            return h
        k = min(self.size, len(h))
        mixed = np.full(len(h) - k + 1, len(h) if len(h) < self.size else self.size, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * _MUL[i % 5]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, as 64-bit numbers."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(shingles, len(shingles) // 20_000 + 1):
        best = np.minimum(best, ((part[None, :] * _A[:, None] + _B[:, None])).min(axis=1))
    return best


def packed(best: np.ndarray) -> bytes:
    """The low bits of the minima (after mixing: low bits of a product are weak), BITS each."""
    low = ((best * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of PARITY bins holds an odd number of the shingles. Sets whose sketches differ in k bits differ in k shingles at least."""
    bins = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(bins.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def _signatures(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bits", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            n, nodes, bits, parity, bands = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    nodes.append(None), bits.append(None), parity.append(None), bands.append(None)
                    continue
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                best = minima(s)
                bits.append(np.frombuffer(packed(best), np.int64))
                parity.append(parities(s))
                bands.append([xxhash.xxh3_64_intdigest(best[i : i + ROWS].tobytes(), seed=i) - 2**63 for i in range(0, MINIMA - ROWS + 1, ROWS)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("xh"), pa.array(n, pa.int64()), *[pa.array(v, t.type) for v, t in zip((nodes, bits, parity, bands), list(schema)[3:])]], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                found = [shingles(t) for t in b.column("text").slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(at, 64), pa.array([s.view(np.int64) for s in found], schema[1].type)], schema=schema)

    return run


def estimate(x: str, y: str):
    """Similarity from the number of equal b-bit minima, corrected for those that agree by chance."""
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(d)
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(MINIMA)) - chance) / (1 - chance)


def possible(percent: int):
    """Whether sketches ``x`` and ``y`` allow a link. Never false for sets that similar, as far as the parities tell; the bits leave MARGIN."""
    differ = F.aggregate(F.zip_with("x.parity", "y.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)  # unrolled, the method gets too long to be compiled
    # |X and Y| >= s |X or Y| is the same as (1 + s) |X xor Y| <= (1 - s) (|X| + |Y|)
    return ((100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n"))) & (estimate("x.bits", "y.bits") >= percent / 100 - MARGIN)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    full = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    both = F.size(F.array_intersect("x", "y"))
    return full.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; ids are whole numbers (others are refused).

    Texts with equal shingle sets are one class, and only classes are compared, so copies cost nothing. Candidates
    share a band. First each class meets the class of its buckets that has most neighbours, then the one that has most
    outside the first one's component: that joins large groups with a few pairs a text. Then, for what remains, pairs of
    *different components* that share a bucket are compared, each once, so no link between candidates is lost and no
    group is expanded into all its pairs. Packed bits and parities sort candidates out where they meet, before they make
    a row (parities only such as cannot be similar enough); the full sets confirm every link.

    Null, empty or blank texts have no shingles and link with nothing: ``component_id`` is their own id. Null ids belong
    to the component of their text; rows that repeat the kept id and its text are all kept. Other columns are ignored.
    """
    return _groups(docs, id_col, text_col, shingle, percent)[0].drop("xh")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """As ``near_groups``, with ``xh``, a hash of the text; and the tables that it reads. Those that nothing reads any more are deleted."""
    small_batches(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("xh"))
    table = written(rows.mapInArrow(_signatures(shingle), "doc_id long, xh long, n_shingles long, node binary, bits array<long>, parity array<long>, bands array<long>"))
    named = table.filter("node is not null")
    classes = written(named.groupBy("node").agg(F.min(F.struct("doc_id", "xh")).alias("one"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("n_shingles").alias("n"), "parity", "bits")).alias("sketch"), F.min("bands").alias("bands")))
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = written(bands.join(shared, "band"))
    mates = members.groupBy("node").agg(F.sum("k").alias("mates"), F.sort_array(F.collect_list("band")).alias("bands"))
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "one.*").withColumnRenamed("doc_id", "_id")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["xh"] == wanted["xh"])).select("node", "text")
    sets = written(texts.mapInArrow(_sets(shingle), "node binary, shingles array<long>").dropDuplicates(["node"]))

    nodes = written(mates)
    sketches = classes.select("node", "sketch")
    links, comp = None, nodes.select("node", F.col("node").alias("comp"))
    for k in range(STAR_ROUNDS + 1):
        placed = members.select("band", "node").join(nodes, "node").join(comp, "node")
        if k < STAR_ROUNDS:
            heads = placed.groupBy("band").agg(F.max(F.struct("mates", "node", "comp")).alias("h"))
            if k:
                heads = placed.join(heads, "band").filter("comp <> h.comp").groupBy("band").agg(F.max(F.struct("mates", "node", "comp")).alias("h"))
            pairs = placed.join(heads, "band").filter("comp <> h.comp").select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
            pairs = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "x"}), "a").join(sketches.withColumnsRenamed({"node": "b", "sketch": "y"}), "b").filter(possible(percent)).select("a", "b")
        else:
            parts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("most"))
            rest = placed.join(parts.filter("comps > 1"), "band").withColumn("minor", F.col("comp") != F.col("most.comp")).select("band", "node", "comp", "bands", "minor").join(sketches, "node")
            other = rest.withColumnsRenamed({"band": "band_b", "node": "b", "comp": "other", "bands": "theirs", "minor": "minor_b", "sketch": "y"})
            once = (F.col("comp") != F.col("other")) & (~F.col("minor_b") | (F.col("node") < F.col("b"))) & possible(percent) & (F.array_min(F.array_intersect("bands", "theirs")) == F.col("band"))
            pairs = rest.filter("minor").withColumnRenamed("sketch", "x").join(other, (F.col("band") == F.col("band_b")) & once).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        found = _confirmed(pairs, sets, percent)
        links = written(found if links is None else links.union(found))
        roots = components(links)
        comp = written(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp")))
    ids = classes.select("node", "least_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    ids = written(ids.join(least, "comp").select("node", "component_id"))
    discarded(classes, members, sets, nodes, comp)
    t = table.select("doc_id", "xh", "n_shingles", "node").join(ids, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return t.select("doc_id", "xh", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), [table, ids]


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns. Rows go by id and text: of several texts under
    one id only those that repeat an earlier document go; rows that repeat id and text stay or go together."""
    found, read = _groups(docs, id_col, text_col, shingle, percent)
    gone = written(found.filter("not kept").select("doc_id", "xh").distinct())
    discarded(*read)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]) & (F.xxhash64(text_of(docs[text_col])) == gone["xh"]), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=3, percent=85)
