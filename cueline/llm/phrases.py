"""Phrase mining by relations: sorted occurrences, joined by piece and next position, counted by group, semi-joined with the frequent groups."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, documents, small_batches, text_of, written

LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: ASCII letters in lower case; ends of pieces become line feeds, blanks spaces.
TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
PARTS = 64
#: Words after which a block of the relation is closed.
BLOCK = 1 << 21
WORDS = "lang string, block long, words array<string>, n array<long>, codes binary, ends binary"


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _plain(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


class _Block:
    """Occurrences of one language: words in order (by piece, then position) as codes of the block's own list, and where pieces end."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        pieces = [p for p in map(bytes.split, text.translate(TABLE).split(b"\n")) if p]
        words = [*chain.from_iterable(pieces)]
        for w in dict.fromkeys(words):
            self.known.setdefault(w, len(self.known))
        self.codes.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.pieces.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
        self.size += len(words)

    def row(self, lang: str, block: int) -> dict:
        """Codes in order of frequency, so that they squeeze well."""
        codes = np.concatenate([np.zeros(0, np.int32), *self.codes])
        n = np.bincount(codes, minlength=len(self.known))
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        words = [*self.known]
        return {"lang": lang, "block": block, "words": [words[i].decode() for i in order], "n": n[order], "codes": _squeezed(place[codes]), "ends": _squeezed(np.concatenate([np.zeros(0, np.int32), *self.pieces]))}


def relation(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first relation: every word of every piece, in blocks of one language; a piece lies in one block."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("codes", pa.binary()), ("ends", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_blocks = TaskContext.get().partitionId() << 32, defaultdict(_Block)

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            row = open_blocks.pop(lang).row(lang, number)
            number += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                open_blocks[lang].add(text)
                if open_blocks[lang].size >= BLOCK:
                    yield closed(lang)
            if sum(x.size for x in open_blocks.values()) >= 2 * BLOCK:  # many languages: the largest goes
                yield closed(max(open_blocks, key=lambda k: open_blocks[k].size))
        for lang in [*open_blocks]:
            yield closed(lang)

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text")).mapInArrow(run, WORDS)


#: A relation of k words: codes of its groups (-1 where none) and their ids, the same of the words, and where pieces end. ``codes`` is null if k is 1.
RELATION = "block long, codes binary, ids binary, first binary, word_ids binary, ends binary"
_SCHEMA = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]]) for c in RELATION.split(", ")])


class _Occurrences:
    """A block of a relation of k words, unpacked."""

    def __init__(self, b: pa.RecordBatch, i: int):
        data = {c: b.column(c)[i].as_py() for c in _SCHEMA.names}
        self.block, self.first, self.word_ids, self.ends = data["block"], _plain(data["first"], np.int32), _plain(data["word_ids"], np.int64), _plain(data["ends"], np.int32)
        self.codes, self.ids = (self.first, self.word_ids) if data["codes"] is None else (_plain(data["codes"], np.int32), _plain(data["ids"], np.int64))

    def extended(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge-join of the relation of k words and that of one word, both in order, on the piece and the position k further: the places where both have
        a group and the piece goes on that far, and the pair of codes there as one number."""
        n = len(self.codes) - k
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.repeat(np.cumsum(self.ends), self.ends)[:n]  # of the piece of each place
        places = np.flatnonzero((self.codes[:n] >= 0) & (self.first[k:] >= 0) & (np.arange(n) + k < end))
        return places, self.codes[places].astype(np.int64) * len(self.word_ids) + self.first[places + k]


def _frequent(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups that occur ``least`` times, with an id ``id`` of the group and, in one row of each, its count ``f``. A group has one row a block, already added up there, so
    one shuffle both counts the groups and says in which blocks they lie."""
    group = Window.partitionBy(*keys)
    kept = counted.withColumn("f", F.sum("n").over(group)).filter(F.col("f") >= least)
    kept = kept.withColumn("_m", F.monotonically_increasing_id()).withColumn("id", F.min("_m").over(group))
    return written(kept.withColumn("f", F.when(F.col("id") == F.col("_m"), F.col("f"))).drop("_m", "n"), compression="zstd")


def _first_level(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The first relation semi-joined with the frequent words."""
    keep = words.groupBy("block").agg(*[F.collect_list(c).alias(f"keep_{c}") for c in ("code", "id")])  # of one block, row by row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                codes = _plain(b["codes"][i].as_py(), np.int32)
                old, ids = (b[f"keep_{c}"][i].values.to_numpy(zero_copy_only=False) for c in ("code", "id"))
                order = np.argsort(old)
                old, ids = old[order], ids[order]
                new = np.full(max(int(codes.max(initial=-1)), int(old.max(initial=-1))) + 1, -1, np.int32)
                new[old] = np.arange(len(old))
                yield pa.RecordBatch.from_pylist([{"block": b["block"][i].as_py(), "first": _squeezed(new[codes]), "word_ids": _squeezed(ids.astype(np.int64)), "ends": b["ends"][i].as_py()}], _SCHEMA)

    return written(blocks.select("block", "codes", "ends").join(keep, "block").mapInArrow(run, RELATION))


def _level(relation: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """The relation of k words: that of k - 1, extended by a word and semi-joined with the frequent groups, block by block."""
    keep = kept.groupBy("block").agg(*[F.collect_list(c).alias(f"keep_{c}") for c in ("g", "w", "id")])  # of one block, row by row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x = _Occurrences(b, i)
                g, w, ids = (b[f"keep_{c}"][i].values.to_numpy(zero_copy_only=False) for c in ("g", "w", "id"))
                by_g, by_w = np.argsort(x.ids), np.argsort(x.word_ids)
                key = by_g[np.searchsorted(x.ids, g, sorter=by_g)].astype(np.int64) * len(x.word_ids) + by_w[np.searchsorted(x.word_ids, w, sorter=by_w)]
                order = np.argsort(key)
                key, ids = key[order], ids[order]
                places, asked = x.extended(k - 1)
                hit = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                same = key[hit] == asked
                codes = np.full(len(x.codes), -1, np.int32)
                codes[places[same]] = hit[same]
                yield pa.RecordBatch.from_pylist([{"block": x.block, "codes": _squeezed(codes), "ids": _squeezed(ids.astype(np.int64)), **{c: b[c][i].as_py() for c in ("first", "word_ids", "ends")}}], _SCHEMA)

    return written(relation.join(keep, "block").mapInArrow(run, RELATION))


def _groups(relation: DataFrame, k: int) -> DataFrame:
    """``g, w, block, n``: groups of k words (a group of k - 1 and the next word) of each block, counted."""
    schema = pa.schema([(c, pa.int64()) for c in ("g", "w", "block", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x = _Occurrences(b, i)
                pairs, n = np.unique(x.extended(k - 1)[1], return_counts=True)
                for at in range(0, len(pairs), 1 << 16):
                    part = pairs[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.ids[part // len(x.word_ids)], x.word_ids[part % len(x.word_ids)], np.full(len(part), x.block), n[at : at + (1 << 16)])], schema=schema)

    return relation.mapInArrow(run, "g long, w long, block long, n long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, ids, phrase, f`` of the phrases of 1 to ``longest`` words that occur ``least`` times or more, and ``lang, n``: all words of each language.

    A group of k words is the group of its first k - 1 and a word; each level is a written table. What is shuffled is a row for each distinct group of a block.
    """
    blocks = written(relation(docs, text_col, lang_col))
    words = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "n")).alias("code", "x")).select("lang", "block", "code", F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    kept = _frequent(words, ["lang", "word"], least)
    singles = kept.filter("f is not null").select("id", "lang", F.array("id").alias("ids"), F.col("word").alias("phrase"), "f")
    found = [written(singles)]
    now = _first_level(blocks, kept)
    discarded(blocks, kept)
    for k in range(2, longest + 1):
        kept = _frequent(_groups(now, k), ["g", "w"], least)
        groups = kept.filter("f is not null").select("id", "g", "w", "f")
        left = found[-1].select(F.col("id").alias("g"), "lang", F.col("ids").alias("head"), F.col("phrase").alias("before"))
        right = found[0].select(F.col("id").alias("w"), F.col("phrase").alias("word"))
        found.append(written(groups.join(left, "g").join(right, "w").select("id", "lang", F.array_append("head", F.col("w")).alias("ids"), F.concat_ws(" ", "before", "word").alias("phrase"), "f")))
        before = now
        if k < longest:
            now = _level(now, kept, k)
        discarded(before, kept)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases.drop("id"), totals


def ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: as decimals of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)"), big(l) * big(r))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    Null text has no words, null language is ``und``; repeated rows count each; a language without a candidate has no rows. Ranks are given in two steps, so a
    task reads at most PARTS times ``top`` rows of a language.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, least)
    size = F.size("ids")
    candidates = phrases.filter(size > 1)
    cuts = candidates.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("cut"))).withColumn("right", F.slice("ids", F.col("cut") + 1, size - F.col("cut")))
    part = lambda name, out: phrases.select(F.col("ids").alias(name), F.col("f").alias(out))
    scored = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right").withColumn("score", ratio(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("ids").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    starts = F.sequence(F.lit(1), size - 1)
    within = candidates.filter(size > 2).select("f", size.alias("k"), "ids", F.explode(starts).alias("start")).select("f", "k", "ids", "start", F.explode(F.sequence(F.lit(2), F.col("k") - F.col("start") + 1)).alias("width")).filter("width < k")
    covered = within.groupBy(F.slice("ids", F.col("start"), F.col("width")).alias("ids")).agg(F.max("f").alias("longer"))
    kept = candidates.join(covered, "ids", "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("f"), F.lit(True))).join(best, "ids")
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("best.score"), F.desc("f"), "phrase"))
    parts = kept.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(PARTS)))  # the first of each part hold the first of all: no task sees a language whole
    first = parts.withColumn("rank", order("lang", "_part")).filter(F.col("rank") <= top).withColumn("rank", order("lang")).filter(F.col("rank") <= top).join(totals, "lang")
    return first.select("lang", F.col("rank").cast("long"), "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') lang, doc_id, generate_subscripts(p, 1) piece, unnest(p) t
  from (select lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') p from documents)),
words as (select lang, regexp_extract_all(t, '[^\x20\x09]+') w from pieces),
n as (select lang, sum(len(w))::bigint n from words group by lang),
runs as (
  select lang, w[i : i + k - 1] ids from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from words, (select unnest(range(1, {LONGEST + 1})) k))),
f as (select lang, ids, count(*) f from runs group by all having count(*) >= {LEAST}),
c as (select * from f where len(ids) > 1),
cuts as (
  select c.lang, c.ids, c.f a, k, l.f l, r.f r, ((1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f))::bigint score
  from (select *, unnest(range(1, len(ids))) k from c) c
  join f l on l.lang = c.lang and l.ids = c.ids[1 : k] join f r on r.lang = c.lang and r.ids = c.ids[k + 1 :]),
best as (select * from cuts qualify row_number() over (partition by lang, ids order by score, k) = 1),
longer as (
  select lang, ids[i : j] ids, max(f) longer from (select *, unnest(range(i + 1, len(ids) + 1)) j from (select *, unnest(range(1, len(ids))) i from c)) where j - i + 1 < len(ids) group by all),
kept as (select b.*, array_to_string(b.ids, ' ') phrase from best b left join longer x on x.lang = b.lang and x.ids = b.ids where x.longer is null or 100 * x.longer < {INSIDE} * a)
select lang, row_number() over o rank, phrase, a, l, r, n, score
from kept join n using (lang) window o as (partition by lang order by score desc, a desc, phrase) qualify row_number() over o <= {TOP}
"""
