"""Substring dedup: an FM-index per shard finds word windows that occur earlier."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .segments import apply_spans, in_shards, numbered, numbers, powers_of, removed_flags, repeated, single_windows, spans, text_data

LENGTH, GRAM = 20, 4


class Bits:
    """A packed bit array that counts the ones before a place: 64 bits a word, and a 32-bit count a word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[w].astype(np.int64) + np.bitwise_count(self.words[w] & low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Counts of a symbol before a place in a sequence; one packed bit array a level (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.height = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in reversed(range(self.height)):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

        self.start = self._down(np.zeros(sigma, np.int64), np.arange(sigma))  # of each symbol's places at the bottom

    def _down(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.height))):
            one, ones = (symbol >> level & 1).astype(bool), self.levels[k].ones(place)
            place = np.where(one, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place; all queries go down the levels together."""
        return self._down(place, symbol) - self.start[symbol]

    def symbol(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol = np.zeros_like(place)
        for k in range(self.height):
            one, ones = self.levels[k][place], self.levels[k].ones(place)
            place = np.where(one, self.zeros[k] + ones, place - ones)
            symbol = symbol << 1 | one
        return symbol, place - self.start[symbol]


class FMIndex:
    """Compressed index of several sequences of symbols from 1; no match crosses from one sequence to the next.

    Kept are the wavelet tree of the Burrows-Wheeler transform, the counts of smaller symbols, and of the suffix array
    the places at every SAMPLE-th symbol of a sequence from its first; neither text nor suffix array stay.
    """

    SAMPLE = 16

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) + 1 for s in sequences])
        ends = np.cumsum(sizes)
        text = np.zeros(int(ends[-1]), np.int64)
        for s, e in zip(sequences, ends):
            text[e - 1 - len(s) : e - 1] = s
        rank = text + len(sequences)
        rank[ends - 1] = np.arange(len(sequences))
        by, longest = 1, int(sizes.max())
        places = np.argsort(rank, kind="stable")
        while by <= longest:  # prefix doubling; separators are all different, so nothing is compared beyond them
            after = np.concatenate([rank[by:], np.full(min(by, len(rank)), -1)])[: len(rank)]
            places = np.lexsort((after, rank))
            a, b = rank[places], after[places]
            rank = np.empty_like(rank)
            rank[places] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            if rank[places[-1]] == len(rank) - 1:  # all different
                break
            by *= 2
        self.size, sigma = len(text), int(text.max()) + 1
        self.tree = WaveletTree(text[places - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        sampled = ((np.arange(len(text)) - np.repeat(ends - sizes, sizes)) % self.SAMPLE == 0)[places]
        self.marked, self.samples = Bits(sampled), places[sampled].astype(np.uint32)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one symbol more in front."""
        return self.before[symbol] + self.tree.rank(symbol, lo), self.before[symbol] + self.tree.rank(symbol, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows of the suffix array: back through the text to the sample before."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.samples[self.marked.ones(rows[hit])].astype(np.int64) + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol, n = self.tree.symbol(rows)
            rows, steps = self.before[symbol] + n, steps + 1
        return out

    def matching_statistics(self, stream: np.ndarray, least: int, occurrences: int = 2, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (place after a match; all, if none are given) in a stream of documents (0: a break) how many symbols
        up to it, ``least`` at most, occur ``occurrences`` times or more in the index, and the interval of that match."""
        ends = np.arange(1, len(stream) + 1) if ends is None else ends
        length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        open_ = np.arange(len(ends))
        for k in range(least):
            open_ = open_[ends[open_] - 1 - k >= 0]
            symbol = stream[ends[open_] - 1 - k]
            open_, symbol = open_[symbol > 0], symbol[symbol > 0]
            a, b = self.extend(symbol, lo[open_], hi[open_])
            more = b - a >= occurrences
            open_ = open_[more]
            lo[open_], hi[open_], length[open_] = a[more], b[more], k + 1
        return length, lo, hi


def earlier_windows(segs: list[np.ndarray], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (its id and start given) which of its windows also start earlier in another."""
    _, ids = np.unique(np.concatenate(segs), return_inverse=True)
    sizes = np.array([len(s) + 1 for s in segs])
    begins = np.cumsum(sizes) - sizes
    index = FMIndex(np.split(ids + 1, np.cumsum(sizes - 1)[:-1]))
    stream = np.zeros(int(sizes.sum()), np.int64)
    stream[np.arange(len(ids)) + np.repeat(np.arange(len(segs)), sizes - 1)] = ids + 1
    _, doc = np.unique(docs, return_inverse=True)

    def place(at: np.ndarray) -> np.ndarray:
        """Documents in order, then starts, as one number; a place that two segments share is one place."""
        k = np.searchsorted(begins, at, side="right") - 1
        return (doc[k] << 40) + starts[k] + at - begins[k]

    windows = np.maximum(0, sizes - length)
    first_end = np.repeat(begins + length - np.cumsum(windows) + windows, windows)
    ends = np.arange(len(first_end)) + first_end
    found, lo, hi = index.matching_statistics(stream, length, ends=ends)
    hits = np.flatnonzero(found >= length)
    flags = np.zeros(len(ends), bool)
    if len(hits):
        pairs, which = np.unique(lo[hits] << 32 | hi[hits], return_inverse=True)
        lo, n = pairs >> 32, (pairs & 0xFFFFFFFF) - (pairs >> 32)
        at = np.cumsum(n) - n
        every = place(index.locate(np.arange(int(n.sum())) + np.repeat(lo - at, n)))
        earliest = np.minimum.reduceat(every, at)
        flags[hits] = earliest[which] < place(ends[hits] - length)
    return np.split(flags, np.cumsum(windows)[:-1])


_rng = np.random.default_rng(19)
_BYTES, _SPACE = _rng.integers(1, 2**63, 256, dtype=np.uint64), np.isin(np.arange(256), (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts end to end begin and end, and where each text's words begin among them (and the last text's end)."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    seam = offsets[1:-1]
    starts[seam] |= inside[seam + 1]  # a text that begins with a word right after one that ends with a word
    ends[seam] |= inside[seam]
    first = np.flatnonzero(starts[:-1])
    return first, np.flatnonzero(ends), np.searchsorted(first, offsets)


def words(column: pa.Array, slice_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a column of texts, end to end, and where each text's begin: polynomials of their bytes from running sums,
    a slice of the bytes at a time."""
    data, offsets = text_data(column)
    first, end, counts = word_places(data, offsets)
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + slice_bytes)))
        low = int(first[at])
        piece = data[low : int(end[to - 1])]
        powers, inverse = powers_of(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[piece] * powers[: len(piece)], dtype=np.uint64)])
        a, b = first[at:to] - low, end[at:to] - low
        h = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[at:to] = h ^ (h >> np.uint64(29))
        at = to
    return out, counts


def _shards(length: int):
    schema = pa.schema([*[(c, pa.int64()) for c in ("fp", "ctx", "a", "b", "first_doc", "first_lo")], ("later", pa.bool_())])

    def shard(t: pa.Table) -> pa.RecordBatch:
        fp, ctx, doc, lo, n, copies = numbers(t, "fp", "ctx", "doc_id", "lo", "n", "copies")
        found = [spans(f) for f in earlier_windows([np.frombuffer(s, np.uint64) for s in t["seg"].to_pylist()], doc, lo, length)]
        of = np.repeat(np.arange(len(found)), [len(x) for x in found])
        a, b = np.array([x for f in found for x in f], np.int64).reshape(-1, 2).T
        many = np.flatnonzero(copies > 1)  # all that the first copy of a class has starts earlier there
        of, later = np.concatenate([of, many]), np.concatenate([np.zeros(len(of), bool), np.ones(len(many), bool)])
        a, b = np.concatenate([a, np.zeros(len(many), np.int64)]), np.concatenate([b, n[many]])
        first = t["doc_id"].combine_chunks().take(pa.array(of))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (fp[of], ctx[of], a, b)], first, pa.array(lo[of], pa.int64()), pa.array(later)], schema=schema)

    return in_shards(shard)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_data(b.column("text"))
            first, end, counts = word_places(data, offsets)
            gone = removed_flags(len(first), counts, b.column("spans").to_pylist(), length)
            n, lost = np.diff(counts), np.diff(np.concatenate([[0], np.cumsum(gone)])[counts])
            first, end = first[~gone], end[~gone]
            kept = np.concatenate([[0], np.cumsum(n - lost)])
            edge = np.zeros(len(data) + 2, np.int8)
            edge[first] += 1
            edge[end] -= 1
            take = np.cumsum(edge[: len(data)]).astype(bool)
            joined = np.delete(np.arange(len(end)), kept[1:][n > lost] - 1)  # all but a text's last kept word are followed by a space
            data = data.copy()
            take[end[joined]], data[end[joined]] = True, 0x20
            out = data[take].tobytes()
            at = np.concatenate([[0], np.cumsum(take)])[offsets].tolist()
            sha = [hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove words covered by a window of ``length`` words that also starts earlier: ``doc_id, n_words, n_removed, kept_sha256,
    has_repeats``.

    The classes of segments under one anchor are dealt out by it; each task builds an FM-index of its shard, streams the
    shard's segments against it and asks of every window whose matching statistic reaches ``length`` where the first of
    its occurrences lies. What is found of a class holds for its first copy; its other copies start later as a whole.
    Windows of an anchor with too many classes for a task meet by content. Null text has no words. Null ids come before
    all others; other ids are whole numbers; rows that repeat id and text share their places, so neither counts as the
    earlier one. Words are compared by a hash of 64 bits. No rows in, no rows out.
    """
    rows = numbered(docs, id_col, text_col)
    occ, segs = repeated(rows, words, length, gram)
    schema = "fp long, ctx long, a long, b long, first_doc long, first_lo long, later boolean"
    parts = segs.filter("not big").repartition("fp").sortWithinPartitions("fp", "doc_id", "lo").mapInArrow(_shards(length), schema)
    big = single_windows(segs.filter("big"), length, 8).withColumn("place", F.struct("doc_id", (F.col("lo") + F.col("i")).alias("start")))
    first = big.groupBy("digest").agg(F.min("place").alias("f"))
    one = lambda t, a, b, later: t.select("fp", "ctx", a.cast("long").alias("a"), b.cast("long").alias("b"), F.col("doc_id").alias("first_doc"), F.col("lo").alias("first_lo"), F.lit(later).alias("later"))
    ones = one(big.join(first, "digest").filter(~F.col("place").eqNullSafe(F.col("f"))), F.col("i"), F.col("i") + 1, False)
    found = written(parts.union(ones).union(one(segs.filter("big and copies > 1"), F.lit(0), F.col("n"), True)))
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("lo") == F.col("first_lo"))
    found = occ.join(found, ["fp", "ctx"]).filter(same != F.col("later")).select("rid", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    t = apply_spans(rows, found, _removed(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return t.withColumn("has_repeats", F.col("n_removed") > 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
