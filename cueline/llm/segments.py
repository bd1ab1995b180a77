"""Runs of windows that share an anchor: how repeated substrings are brought together without sending every window.

Every window of ``size`` elements has an anchor, the gram in it with the least hash (leftmost of equals). Equal windows
have the same anchor at the same offset. A segment is a run of windows of one text with the same anchor; it is keyed by
the anchor's hash, so equal windows always meet under one key, and there are few segments (two for each ``size``
elements or so). Segments that are equal by a 64-bit digest of content and offset are one class; each class goes once, with
the number of its copies, to the index of its shard, and what the index finds holds for all its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_id, small_batches, text_of, written

#: Elements worked on at a time; a place in them has to fit 24 bits.
PART = 1 << 20
#: The classes of an anchor that has more than this are not indexed in one task: their windows are dealt out by content.
MOST = 4096
OCCURRENCES = "rid long, doc_id long, fp long, ctx long, lo long, d0 int, n int"


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each gram, by doubling; ``size`` is a power of two."""
    h = (x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    by = 1
    while by < size:
        h = (h[:-by] ^ (h[:-by] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[by:] * np.uint64(0x94D049BB133111EB)
        by *= 2
    return h ^ (h >> np.uint64(29))


def text_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts without nulls, end to end, and where each text begins (and the last ends); nothing is copied."""
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(h: np.ndarray, width: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each run, for windows of ``width`` grams with hashes ``h``; of each text the windows
    ``begins`` to ``ends`` - 1 count, and no run goes from one text to the next."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // width)
    key = np.concatenate([key, np.full(rows * width - len(h), np.iinfo(np.uint64).max, np.uint64)]).reshape(rows, width)
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(key, axis=1).ravel()
    anchor = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    some = begins < ends
    edge[begins[some]] += 1
    edge[ends[some]] -= 1
    counts = np.cumsum(edge[:-1]).astype(bool)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (edge[1:-1] != 0)])
    new[begins[some]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]]) - 1
    kept = counts[first]
    return anchor[first[kept]], first[kept], last[kept]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def powers_of(n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64; remembered."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate(_BASE):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS


def digests(h: np.ndarray, first: np.ndarray, end: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """64-bit digest of the grams ``first`` to ``end`` - 1 of each segment, of their number and of the anchor's place: a polynomial
    of the gram hashes from running sums, so all segments of a text at once."""
    powers, inverse = powers_of(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)])
    v = (sums[end] - sums[first]) * inverse[first]
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + (end - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + d0.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (v ^ (v >> np.uint64(32))).view(np.int64)


def text_segments(x: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> list[np.ndarray]:
    """``text, fp, ctx, lo, d0, n`` of all segments of texts that lie end to end; PART elements or so are worked on at a time, so memory beside the
    texts is bounded."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        for part in range(begin, max(begin + 1, end - size + 1), PART):  # more than one if a single text is that long
            piece = x[part : min(end, part + PART + size - 1)]
            h = gram_hashes(piece, gram) if len(piece) >= size else np.zeros(0, np.uint64)
            lows = np.maximum(offsets[at:to], part) - part
            highs = np.minimum(offsets[at + 1 : to + 1], part + len(piece)) - part - size + 1
            a, lo, hi = runs(h, size - gram + 1, lows, highs)
            of = np.searchsorted(offsets[at + 1 : to + 1] - part, lo, side="right") + at
            out.append((of, h[a].view(np.int64), digests(h, lo, hi + size - gram + 1, a - lo), part + lo - offsets[of], a - lo, hi - lo + 1))
        at = to
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _repeated(column: pa.Array, counts: Sequence[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


def occurrences(elements: Callable, size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, *columns = text_segments(*elements(b.column("text")), size, gram)
            if len(of):
                of = pa.array(of)
                columns = [pa.array(c, pa.int32() if i > 2 else pa.int64()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([b.column("rid").take(of), b.column("doc_id").take(of), *columns], ["rid", "doc_id", "fp", "ctx", "lo", "d0", "n"])

    return run


def extracted(elements: Callable, size: int):
    """Segments' elements as bytes, for a text and the list of the segments wanted of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, offsets = elements(b.column("text"))
            lists = b.column("wanted")
            counts = [len(w) for w in lists]
            wanted = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten()))
            begin = np.repeat(offsets[:-1], counts) + wanted["lo"].to_numpy()
            end = begin + wanted["n"].to_numpy() + size - 1
            segs = [x[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist())]
            names = ["fp", "lo", "d0", "n", "ctx", "copies", "big"]
            yield pa.RecordBatch.from_arrays([_repeated(b.column("doc_id"), counts), *[wanted[c] for c in names], pa.array(segs, pa.binary())], ["doc_id", *names, "seg"])

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, doc_id, text``: rid is the id itself if ids are unique, else a hash of id and text (repeated rows share it)."""
    small_batches(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), text_of(text_col).alias("text"))
    unique = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    return rows.select((F.col("doc_id") if unique else F.xxhash64("doc_id", "text")).alias("rid"), "doc_id", "text")


def repeated(rows: DataFrame, elements: Callable, size: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Segments whose anchor occurs twice or more: all occurrences (OCCURRENCES), and one row for each class.

    Classes: ``fp, ctx, copies, doc_id, lo, d0, n, seg, big``: how often the class occurs, its first place (id, then start),
    its elements, and whether more than MOST classes share the anchor.
    """
    occ = written(rows.mapInArrow(occurrences(elements, size, gram), OCCURRENCES))
    # A table of its own, so that the join below has two plain exchanges and Spark can split an anchor with very many rows.
    often = written(occ.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("fp"))
    occ = written(occ.join(often, "fp"))
    classes = written(occ.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "lo", "rid", "d0", "n")).alias("first")))
    many = written(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > MOST).select("fp", F.lit(True).alias("big")))
    wanted = classes.join(many, "fp", "left").select("first.rid", F.struct("fp", "ctx", "copies", "first.lo", "first.d0", "first.n", F.coalesce("big", F.lit(False)).alias("big")).alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    segs = rows.join(wanted, "rid").dropDuplicates(["rid"]).select("doc_id", "text", "wanted").mapInArrow(extracted(elements, size), "doc_id long, fp long, lo long, d0 int, n int, ctx long, copies long, big boolean, seg binary")
    return occ, written(segs)


def single_windows(segs: DataFrame, size: int, item: int) -> DataFrame:
    """``digest, fp, ctx, copies, doc_id, lo, i``: all windows of the given classes, for anchors with too many to index in one task."""
    t = segs.select("fp", "ctx", "copies", "doc_id", "lo", "seg", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    window = F.substring("seg", F.col("i") * item + 1, F.lit(size * item))
    return t.withColumn("digest", F.unhex(F.sha2(window, 256))).drop("seg")


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of flagged windows of a segment, as first and past-the-last window."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def in_shards(shard: Callable[[pa.Table], pa.RecordBatch], least: int = 4000):
    """Rows come sorted by anchor; ``shard`` gets whole anchors, about ``least`` classes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= least:
                t = pa.Table.from_batches(held)
                fp = t["fp"].to_numpy()
                done = int(np.flatnonzero(np.append(fp[0] - 1, fp[:-1]) != fp)[-1])  # where the last anchor begins
                if done:
                    yield shard(t.slice(0, done))
                    held, rows = t.slice(done).to_batches(), rows - done
        if rows:
            yield shard(pa.Table.from_batches(held))

    return run


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as numpy arrays; nulls as the least number."""
    return [t[c].combine_chunks().fill_null(np.iinfo(np.int64).min if c == "doc_id" else 0).to_numpy() for c in names]


def removed_flags(size: int, offsets: np.ndarray, spans_of: Sequence, length: int) -> np.ndarray:
    """Which elements of texts end to end are covered by the windows of the spans (a, b: windows a to b - 1) found in each text."""
    edge = np.zeros(size + 1, np.int32)
    for at, found in zip(offsets.tolist(), spans_of):
        for w in found or ():
            edge[at + w["a"]] += 1
            edge[at + w["b"] + length - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def apply_spans(rows: DataFrame, found: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Every text with the spans (rid, a, b: windows a to b-1) found in it, through ``work``."""
    per = found.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows.join(per, "rid", "left").select("doc_id", "text", "spans").mapInArrow(work, schema)
