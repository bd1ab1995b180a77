"""Token-id files: canonical length-limited Huffman codes, blocks with checkpoints, decoding by table."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, long_id, shared_dir, small_batches, text_of

END = 1
#: Longest code in bits, ids of a block, ids between two checkpoints.
LONGEST, BLOCK, STEP = 20, 1 << 16, 256
BLOCKS = "part int, block long, n int, doc_ids array<long>, ats array<long>, totals array<long>, checkpoints array<int>, crc long, payload binary"
PIECES = "doc_id long, part long, at long, total long, lo long, n long, ids_crc32 long"


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A mark behind an ASCII letter or digit.
_MARK = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z0-9].)", re.S)


class _Numbers(dict):
    """Numbers of words in the order in which they came up; ``new`` holds those that nobody has looked at yet."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        return self.setdefault(word, len(self))


class Encoder:
    """Ids of texts, by the tokenizers library. With ``apart`` each distinct word is encoded once and remembered, up to a bound.

    That is for tokenizers like ``word_bpe_49k`` only: it drops white space and cuts there, cuts between a letter or digit and a mark behind it, and lowers
    its letters. So the ids of a text are those of its words end to end, in lower case and with their marks apart. Added tokens are
    found before all that; a text that may hold one (``<|``) is cut at ASCII white space only, which none of them has.
    """

    def __init__(self, path: str, apart: bool, remember: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer, self.apart, self.remember = Tokenizer.from_file(path), apart, remember
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.begins, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.width)

    def learn(self, words: list[str]) -> None:
        """Encode words that are new. Those of letters alone are one pre-token each, whose last piece says so: they go through the library many at a time."""
        letters = [k for k, w in enumerate(words) if w.isalpha()]
        joined = [" ".join(words[k] for k in letters[i : i + 256]) for i in range(0, len(letters), 256)]
        flat = np.fromiter(chain.from_iterable(self._encode(joined)), self.width)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(letters):  # not such a tokenizer after all
            letters, flat, ends = [], flat[:0], ends[:0]
        sizes, begins = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[letters] = np.diff(ends, prepend=0)
        begins[letters] = ends - sizes[letters]
        rest = np.setdiff1d(np.arange(len(words)), letters)
        others = self._encode([words[k] for k in rest])
        sizes[rest] = [*map(len, others)]
        begins[rest] = len(flat) + np.cumsum(sizes[rest]) - sizes[rest]
        self.begins, self.sizes = np.concatenate([self.begins, len(self.flat) + begins]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat, np.fromiter(chain.from_iterable(others), self.width)])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each text and the end id, packed as little-endian numbers."""
        if not self.apart:
            return [np.array([*ids, end], self.width).tobytes() for ids in self._encode([t.decode() for t in texts])]
        if len(self.numbers) > self.remember:
            self.forget()
        words = [t.split() if b"<|" in t else _MARK.sub(rb" \g<0>", t.translate(_LOWER)).split() for t in texts]
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64)
        if new := self.numbers.new:
            self.learn([w.decode() for w in new])
            new.clear()
        first, n = self.begins[which], self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)]
        at, tail = ends[np.cumsum([0, *map(len, words)])].tolist(), np.array([end], self.width).tobytes()
        return [ids[i:j].tobytes() + tail for i, j in zip(at, at[1:])]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, apart: bool) -> Encoder:
    """One encoder a Python worker: it is used again by the worker's next tasks."""
    return _ENCODERS.setdefault((path, apart), _ENCODERS.get((path, apart)) or Encoder(path, apart))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", apart: bool = False, end: int = END) -> DataFrame:
    """``doc_id, text_hash, ids`` (packed numbers of two bytes, or four if the vocabulary needs them) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, apart)
        for b in batches:
            ids = [x for at in range(0, len(b), 32) for x in encoder(b.column("text").slice(at, 32).cast(pa.binary()).to_pylist(), end)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids, pa.binary())], ["doc_id", "text_hash", "ids"])

    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, ids binary")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code in the best prefix code of at most ``longest`` bits (package-merge); 0 for a symbol that doesn't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols have no codes of at most {longest} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that go with the lengths: shorter ones first, of one length in the order of the symbols."""
    codes, used = np.zeros(len(lengths), np.uint64), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    room = np.left_shift(np.ones(len(order), np.int64), top - lengths[order])
    codes[order] = ((np.cumsum(room) - room) >> (top - lengths[order])).astype(np.uint64)
    return codes


def packed(codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes end to end, most significant bit first, and the bit at which each begins."""
    ends = np.cumsum(bits)
    at = ends - bits
    out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
    word, over = at >> 6, (at & 63) + bits - 64
    here = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(here, first)
    cut = np.flatnonzero(over > 0)
    out[word[cut] + 1] |= codes[cut] << (64 - over[cut]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at


class Decoder:
    """Symbols by table: the next bits, as many as the longest code has, give the symbol and its length. All stretches between checkpoints go side by side."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max(initial=1)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        room = np.left_shift(np.ones(len(order), np.int64), self.top - lengths[order])
        self.symbols, self.bits = np.zeros(1 << self.top, np.uint32), np.zeros(1 << self.top, np.uint8)
        filled = int(room.sum())
        self.symbols[:filled], self.bits[:filled] = np.repeat(order, room), np.repeat(lengths[order], room)

    def __call__(self, payloads: list[bytes], starts: list[np.ndarray], counts: list[int], step: int = STEP) -> list[np.ndarray]:
        """Ids of each block, from its payload, its checkpoints and its number of ids."""
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8)
        base = 8 * np.concatenate([[0], np.cumsum([*map(len, payloads)])]).astype(np.int64)
        at = np.concatenate([np.asarray(s, np.int64) + b for s, b in zip(starts, base)] or [np.zeros(0, np.int64)])
        left = np.concatenate([np.minimum(step, n - step * np.arange(len(s))) for s, n in zip(starts, counts)] or [np.zeros(0, np.int64)])
        four = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
        order = np.argsort(-left, kind="stable")
        place, todo, out = at[order], left[order], np.zeros((step, len(at)), np.uint32)
        mask, shift = np.uint32((1 << self.top) - 1), 32 - self.top
        for k in range(step):
            live = int(np.searchsorted(-todo, -k, side="left"))
            if not live:
                break
            p = place[:live]
            window = (four[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[k, :live] = self.symbols[window]
            place[:live] += self.bits[window]
        rows = np.empty((len(at), step), np.uint32)
        rows[order] = out.T
        lanes = np.concatenate([[0], np.cumsum([*map(len, starts)])])
        return [rows[a:b].ravel()[:n] for a, b, n in zip(lanes, lanes[1:], counts)]


def _shifted(crc: int, n: int) -> int:
    """What a CRC-32 adds to that of the whole if n more bytes follow: times x ** (8 n) in the field of the polynomial."""

    def times(a: int, b: int) -> int:
        product = 0
        while a:
            if a & 0x80000000:
                product ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return product

    power, square = 0x80000000, 0x00800000  # 1 and x ** 8; the highest bit stands for x ** 0
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(crc, power)


def _write_blocks(lengths: np.ndarray, width: str):
    codes, schema = canonical(lengths), pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "ats", "totals")], ("checkpoints", pa.list_(pa.int32())), ("crc", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, index, position = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), [], 0

        def row(ids: np.ndarray) -> dict:
            payload, at = packed(codes[ids], lengths[ids])
            own = [x for x in index if x[1] < block * BLOCK + len(ids)]
            return {"part": part, "block": block, "n": len(ids), "doc_ids": [x[0] for x in own], "ats": [x[1] for x in own], "totals": [x[2] for x in own], "checkpoints": at[::STEP].astype(np.int32), "crc": zlib.crc32(payload), "payload": payload}

        for b in batches:
            ids = [np.frombuffer(x, width) for x in b.column("ids").to_pylist()]
            for doc_id, own in zip(b.column("doc_id").to_pylist(), ids):
                index.append((doc_id, position, len(own)))
                position += len(own)
            held, rows = np.concatenate([held, *ids]), []
            while len(held) >= BLOCK:
                rows.append(row(held[:BLOCK].astype(np.int64)))
                held, block = held[BLOCK:], block + 1
                index = [x for x in index if x[1] + x[2] > block * BLOCK]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if len(held):
            yield pa.RecordBatch.from_pylist([row(held.astype(np.int64))], schema)

    return run


def write_ids(ids: DataFrame, path: str, vocabulary: int, width: str = "<u2", longest: int = LONGEST) -> None:
    """Write packed ids (``doc_id, text_hash, ids``) as token-id files under ``path``, in ascending ``doc_id`` order.

    ``codes``: id, count and code length of every id that occurs (at most ``vocabulary`` rows; these alone come to the driver). ``blocks``: BLOCK ids
    each, one Huffman payload with a checkpoint (bit) every STEP ids, a CRC of the payload, and which documents lie in it, from where in the part and how
    long; a part is one range of ``doc_id`` and its blocks number from 0. ``parts``: the place of each part's first id. All are Parquet tables, so a lost
    executor's blocks are written again and a part appears once. Rows that repeat an id follow each other by the hash of their text; null ids come first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                n += np.bincount(np.frombuffer(x, width), minlength=vocabulary)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["id", "n"])

    spark, counts = ids.sparkSession, np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    lengths = code_lengths(counts, longest)
    spark.createDataFrame([(int(i), int(counts[i]), int(lengths[i])) for i in np.flatnonzero(counts)], "id long, n long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    keys = ["doc_id", "text_hash"]
    ids.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids").mapInArrow(_write_blocks(lengths, width), BLOCKS).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, never documents
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"), "n").write.parquet(f"{path}/parts")


def code_table(spark: SparkSession, path: str) -> np.ndarray:
    """Bits of every id's code; as long as the largest id that occurs."""
    rows = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        lengths[r.id] = r.bits
    return lengths


def read_pieces(spark: SparkSession, path: str, only: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """What each block holds of each document: ``doc_id, part, at, total, lo, n, ids_crc32`` and, if asked for, ``ids``.

    A piece covers ids ``lo`` to ``lo + n - 1`` of the document that starts at ``at`` of its part; its CRC is already moved to its place, so the xor over the
    pieces of a document is the CRC of all its ids. ``only`` (a column ``doc_id``) reads the blocks that hold such documents and decodes the checkpoints that
    these need. A payload that doesn't have its CRC is an error.
    """
    partly, lengths = only is not None, code_table(spark, path)
    schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "part", "at", "total", "lo", "n", "ids_crc32")], *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(lengths)
        for b in batches:
            blocks, rows = b.to_pylist(), []
            if any(zlib.crc32(x["payload"]) != x["crc"] for x in blocks):
                raise ValueError("a block of token ids is damaged")
            for x in blocks:
                first = x["block"] * BLOCK
                x["docs"] = [(d, a, t, max(a - first, 0), min(a + t - first, x["n"])) for d, a, t in zip(x["doc_ids"], x["ats"], x["totals"])]
                lo, hi = (x["docs"][0][3], x["docs"][-1][4]) if partly else (0, x["n"])
                x["skip"] = lo // STEP * STEP
                x["need"], x["n"] = x["checkpoints"][lo // STEP : -(-hi // STEP)], min(x["n"], -(-hi // STEP) * STEP) - x["skip"]
            for x, ids in zip(blocks, decode([x["payload"] for x in blocks], [x["need"] for x in blocks], [x["n"] for x in blocks])):
                little = ids.astype("<u4")
                for d, a, t, lo, hi in x["docs"]:
                    own = little[lo - x["skip"] : hi - x["skip"]]
                    done = x["block"] * BLOCK + hi - a
                    crc = zlib.crc32(own.tobytes())
                    rows.append((d, x["part"], a, t, done - len(own), len(own), _shifted(crc, 4 * (t - done)) if t > done else crc, *([own] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if partly:
        docs = blocks.select("part", "block", F.explode(F.arrays_zip("doc_ids", "ats", "totals")).alias("d")).select("part", "block", "d.*")
        wanted = docs.join(only.select(F.col("doc_id").alias("doc_ids")).distinct(), "doc_ids", "left_semi")
        wanted = wanted.groupBy("part", "block").agg(F.array_sort(F.collect_list(F.struct("ats", "doc_ids", "totals"))).alias("w"))  # of one block
        blocks = blocks.drop("doc_ids", "ats", "totals").join(wanted, ["part", "block"]).select("*", *[F.col(f"w.{c}").alias(c) for c in ("doc_ids", "ats", "totals")]).drop("w")
    return blocks.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    whole = read_pieces(spark, path).groupBy("part", "at", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("ids_crc32").alias("ids_crc32"))
    return whole.join(spark.read.parquet(f"{path}/parts").select("part", "first"), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, ids`` of every document, or of those in ``only``."""
    pieces = read_pieces(spark, path, only, with_ids=True).groupBy("part", "at", "doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "ids"))).alias("p"))  # of one document
    return pieces.join(spark.read.parquet(f"{path}/parts").select("part", "first"), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), F.flatten("p.ids").alias("ids"))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", apart: bool = False, end: int = END, longest: int = LONGEST) -> str:
    """Encode whole texts, append ``end`` to each and write them as token-id files (``write_ids``); the folder.

    ``tokenizer`` is a file that every executor has. Null text is empty: the end id alone. An empty table gives files without blocks. Texts are encoded once;
    ids, not texts, are put in order.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/cueline/{uuid.uuid4().hex}"
    encoder = Encoder(tokenizer, apart)
    encoded(docs, tokenizer, id_col, text_col, apart, end).write.option("compression", "zstd").parquet(f"{path}/encoded")
    ids = spark.read.schema("doc_id long, text_hash long, ids binary").parquet(f"{path}/encoded")
    write_ids(ids, path, max(encoder.tokenizer.get_vocab_size(), end + 1), encoder.width, longest)
    return path


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_bpe_49k`` cuts at white space, drops it and composes nothing across it, so its words are encoded apart."""
    import public_tokenizers

    return file_digests(spark, token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), apart=True))
