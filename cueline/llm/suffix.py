"""Suffix-array dedup: byte strings that occur twice, by deep-shallow sorting of the suffixes and prefixes at anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .segments import apply_spans, in_shards, numbered, numbers, removed_flags, repeated, single_windows, spans, text_data

LENGTH, GRAM = 400, 64
#: Bytes that multikey quicksort looks at; what agrees so far goes into a blind trie.
SHALLOW = 80


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind(strings: list[bytes], group: list[int]) -> list[int]:
    """Order a group with a long common prefix: a trie that knows only where strings branch and by which byte.

    An insertion follows the branching bytes blindly to some leaf, compares once with that leaf's string, and branches
    off where the two differ. Ends count as byte -1. Leaves hold lists of equal strings.
    """
    byte = lambda s, i: s[i] if i < len(s) else -1
    root: list | tuple = ([group[0]],)
    for k in group[1:]:
        s, node = strings[k], root
        while isinstance(node, list):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0][0]]
        at = common(s, other)
        if at == len(s) == len(other):
            node[0].append(k)
            continue
        node, parent, key = root, None, None
        while isinstance(node, list) and node[0] < at:
            parent, key = node, byte(s, node[0])
            node = node[1][key]
        if isinstance(node, list) and node[0] == at:
            node[1][byte(s, at)] = ([k],)
            continue
        fork = [at, {byte(s, at): ([k],), byte(other, at): node}]
        if parent is None:
            root = fork
        else:
            parent[1][key] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            out += node[0]
        else:
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of the strings: multikey quicksort by 8 bytes at a time to ``shallow`` bytes, then blind tries."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += _blind(strings, group)
        else:
            word = {k: (strings[k][depth : depth + 8].ljust(8, b"\0"), min(8, max(0, len(strings[k]) - depth))) for k in group}
            pivot = word[group[len(group) // 2]]
            same = [k for k in group if word[k] == pivot]
            if pivot[1] < 8:  # all of these end here
                done = [(same, shallow)]
            else:
                done = [(same, depth + 8)]
            less, more = [k for k in group if word[k] < pivot], [k for k in group if word[k] > pivot]
            todo += [x for x in ((more, depth), *done, (less, depth)) if x[0]]
    return out


def sorted_with_lcp(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the strings and how many bytes each shares with the one before it."""
    order = deep_shallow(strings)
    lcp = [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order), np.array(lcp)


def repeated_windows(segs: list[bytes], d0: np.ndarray, n: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (that stands for so many copies) which of its windows occur twice or more.

    A window that starts d bytes before the anchor equals another's iff they share d bytes to the left of the anchor and
    length - d to the right: classes of either order cut where the shared length falls below that.
    """
    flags = [np.zeros(k, bool) for k in n]
    right, rl = sorted_with_lcp([s[d:] for s, d in zip(segs, d0)])
    left, ll = sorted_with_lcp([s[:d][::-1] for s, d in zip(segs, d0)])
    r_class, l_class = np.empty(len(segs), np.int64), np.empty(len(segs), np.int64)
    low = d0 - n + 1
    for d in range(int(low.min()), int(d0.max()) + 1):
        valid = np.flatnonzero((low <= d) & (d <= d0))
        if not len(valid):
            continue
        r_class[right] = np.cumsum(rl < length - d)
        l_class[left] = np.cumsum(ll < d)
        pair = r_class[valid] * (len(segs) + 1) + l_class[valid]
        _, which = np.unique(pair, return_inverse=True)
        for k in valid[np.bincount(which, copies[valid])[which] > 1]:
            flags[k][d0[k] - d] = True
    return flags


def _shards(length: int):
    schema = pa.schema([(c, pa.int64()) for c in ("fp", "ctx", "a", "b")])

    def shard(t: pa.Table) -> pa.RecordBatch:
        d0, n, copies, fp, ctx = numbers(t, "d0", "n", "copies", "fp", "ctx")
        flags = repeated_windows(t["seg"].to_pylist(), d0, n, copies, length)
        found = [spans(f) for f in flags]
        of = np.repeat(np.arange(len(found)), [len(x) for x in found])
        a, b = np.array([x for f in found for x in f], np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (fp[of], ctx[of], a, b)], schema=schema)

    return in_shards(shard)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_data(b.column("text"))
            gone = removed_flags(len(data), offsets, b.column("spans").to_pylist(), length)
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            out = data[~gone].tobytes()
            at = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
            sha = [hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(at, at[1:])]
            numbers_ = [pa.array(v, pa.int64()) for v in (np.diff(offsets), count(gone), count(begins))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers_, pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove bytes covered by a ``length``-byte string that starts twice or more: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    has_repeats``.

    The classes of segments under one anchor are dealt out by it, and each task sorts the suffixes (and, reversed, the
    prefixes) at the anchors and reads off the windows that occur twice; a class of several copies counts as often. What
    is found of a class holds for its copies. Windows of an anchor with too many classes for a task meet by content.
    Null text is empty; texts shorter than ``length`` lose nothing; rows that repeat id and text count as two
    occurrences; ids are whole numbers. No rows in, no rows out.
    """
    rows = numbered(docs, id_col, text_col)
    occ, segs = repeated(rows, text_data, length, gram)
    parts = segs.filter("not big").repartition("fp").sortWithinPartitions("fp", "doc_id", "lo").mapInArrow(_shards(length), "fp long, ctx long, a long, b long")
    big = single_windows(segs.filter("big"), length, 1)
    twice = big.groupBy("digest").agg(F.sum("copies").alias("k")).filter("k > 1").select("digest")
    ones = big.join(twice, "digest").select("fp", "ctx", F.col("i").cast("long").alias("a"), (F.col("i") + 1).cast("long").alias("b"))
    found = written(parts.union(ones))
    found = occ.join(found, ["fp", "ctx"]).select("rid", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    t = apply_spans(rows, found, _removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return t.withColumn("has_repeats", F.col("n_removed") > 0)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
