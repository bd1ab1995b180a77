"""Edit-aware token counts: a segment tree of pre-token counts a document; edits re-encode their surroundings only."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, long_id, small_batches, text_of

TOKENIZER = os.environ.get("CUELINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokens of byte-level BPE. Where a match ends depends on no more than CONTEXT characters behind it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 4
#: Pre-tokens of a leaf of the trees.
SEGMENT = 32


class Counter:
    """Tokens of a pre-token; known ones are remembered, up to a bound."""

    def __init__(self, path: str = TOKENIZER, remember: int = 500_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.known, self.most = regex.compile(PATTERN), {}, remember

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > self.most:
                self.known.clear()
            n = self.known[piece] = len(self.encoding._encode_single_piece(piece))
        return n


class TokenTree:
    """Pre-tokens of one text in segments of SEGMENT, and two trees of sums over the segments: characters and tokens.

    The state is the text of each segment and the lengths and token counts of its pre-tokens, so trees can be stored
    (``flat``), and any number of edits can follow each other.
    """

    def __init__(self, text: str, counter: Counter, lengths: Sequence[int] | None = None, counts: Sequence[int] | None = None):
        self.counter = counter
        if lengths is None:
            pieces = counter.split.findall(text)
            lengths, counts = list(map(len, pieces)), list(map(counter, pieces))
        self._build(text, lengths, counts)

    def _build(self, text: str, lengths: Sequence[int], counts: Sequence[int]) -> None:
        self.lengths = [lengths[i : i + SEGMENT] for i in range(0, len(lengths), SEGMENT)] or [[]]
        self.counts = [counts[i : i + SEGMENT] for i in range(0, len(lengths), SEGMENT)] or [[]]
        self.texts, at = [], 0
        for own in self.lengths:
            self.texts.append(text[at : (at := at + sum(own))])
        self.chars, self.tokens = self._tree(self.texts, len), self._tree(self.counts, sum)

    @staticmethod
    def _tree(leaves: list, of) -> list[list[int]]:
        levels = [list(map(of, leaves))]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([a + b for a, b in zip_longest(below[::2], below[1::2], fillvalue=0)])
        return levels

    @property
    def total(self) -> int:
        return self.tokens[-1][0]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def flat(self) -> tuple[str, list[int], list[int]]:
        """The state: text, and length and token count of each pre-token."""
        return self.text, [n for own in self.lengths for n in own], [n for own in self.counts for n in own]

    def _find(self, place: int) -> tuple[int, int]:
        """The segment that holds a place (the last one for the end) and where it starts, down the tree of characters."""
        slot, start = 0, 0
        for level in reversed(self.chars[:-1]):
            slot *= 2
            if slot + 1 < len(level) and place >= start + level[slot]:
                start += level[slot]
                slot += 1
        return slot, start

    def _put(self, slot: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """A segment's new content; the sums above it change by the difference."""
        for levels, change in ((self.chars, len(text) - self.chars[0][slot]), (self.tokens, sum(counts) - self.tokens[0][slot])):
            k = slot
            for level in levels if change else ():
                level[k] += change
                k >>= 1
        self.texts[slot], self.lengths[slot], self.counts[slot] = text, lengths, counts

    def replace(self, a: int, b: int, new: str) -> int:
        """Put ``new`` in place of characters a to b - 1; the number of pre-tokens encoded again.

        From the last boundary that the edit can't reach, the text is split again until a split falls on an old boundary
        behind the edit; from there on nothing changes. Segments are read one by one until that happens.
        """
        first, start = self._find(max(0, a - CONTEXT))
        keep, place = 0, start
        for n in self.lengths[first]:
            if place + n > a - CONTEXT:
                break
            place += n
            keep += 1
        last, end = first, start + len(self.texts[first])
        while end < b and last + 1 < len(self.texts):
            last += 1
            end += len(self.texts[last])
        old = "".join(self.texts[first : last + 1])
        window, shift = old[place - start : a - start] + new + old[b - start :], len(new) - (b - a)
        bounds = {start}
        at = start
        for own in self.lengths[first : last + 1]:
            for n in own:
                at += n
                bounds.add(at)
        pieces, done = [], 0
        while True:
            behind = place + done - shift  # where we are in the old text
            if behind >= b and behind in bounds and done >= a - place + len(new):
                break
            m = self.counter.split.match(window, done) if done < len(window) else None
            if (m is None or m.end() + CONTEXT > len(window)) and last + 1 < len(self.texts):
                last += 1
                window += self.texts[last]
                for n in self.lengths[last]:
                    end += n
                    bounds.add(end)
                continue
            if m is None or m.end() == done:
                break
            pieces.append(m.group())
            done = m.end()
        behind = place + done - shift
        lengths, counts, at = self.lengths[first][:keep], self.counts[first][:keep], start
        lengths, counts = [*lengths, *map(len, pieces)], [*counts, *map(self.counter, pieces)]
        for slot in range(first, last + 1):
            for n, c in zip(self.lengths[slot], self.counts[slot]):
                if at >= behind:
                    lengths.append(n)
                    counts.append(c)
                at += n
        text = "".join([self.texts[first][: place - start], *pieces, window[done:]])
        share, done = -(-len(lengths) // (last - first + 1)), 0
        for k, slot in enumerate(range(first, last + 1)):
            own = lengths[k * share : (k + 1) * share]
            self._put(slot, text[done : (done := done + sum(own))], own, counts[k * share : (k + 1) * share])
        if share > 16 * SEGMENT:
            self._build(*self.flat())
        return len(pieces)

    def edit(self, edits: Sequence[tuple[int, int, str]]) -> int:
        """Apply edits (start, end, new text; sorted, apart, places of the text as it is); the number of pre-tokens encoded again."""
        return sum(self.replace(a, b, new) for a, b, new in reversed(edits))


_FIXES = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}\.[\w.-]{1,64}|\d{7,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query: repeated lines go, mail addresses and long numbers become marks."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            edits.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "<mail>" if "@" in m.group() else "<number>") for m in _FIXES.finditer(line)]
        at = end + 1
    return edits


def _counts(path: str):
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_after")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            given = b.column("edits").to_pylist() if "edits" in b.schema.names else [None] * b.num_rows
            for doc, text, edits in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), given):
                edits = cleaning_edits(text) if edits is None else [(e["start"], e["end"], e["text"]) for e in edits]
                tree = TokenTree(text, counter)
                before, pieces = tree.total, sum(map(len, tree.lengths))
                again = tree.edit(edits)
                for column, v in zip(out, (doc, before, pieces, len(edits), again, tree.total)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, schema)], schema=schema)

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_edits, n_reencoded, n_tokens_after`` of every row; ids are whole numbers.

    ``edits_col``: array of structs (start, end, text) in characters, sorted and apart; without it, or where it is null,
    ``cleaning_edits`` of the text. One pass, no shuffle; a task holds one batch. Null text counts as empty, 0 tokens;
    repeated rows are counted each; ``tokenizer`` is the file of ranks, on every executor.
    """
    small_batches(docs.sparkSession)
    more = [F.col(edits_col).alias("edits")] if edits_col else []
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), text_of(text_col).alias("text"), *more)
    return rows.mapInArrow(_counts(tokenizer), "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_reencoded long, n_tokens_after long")


TREES = "doc_id long, text string, lengths array<int>, counts array<int>, n_tokens long, n_reencoded long"


def _trees(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_reencoded", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for r in b.to_pylist():
                tree = TokenTree(r["text"], counter, r.get("lengths"), r.get("counts"))
                again = tree.edit([(e["start"], e["end"], e["text"]) for e in r.get("edits") or ()])
                for column, v in zip(out, (r["doc_id"], *tree.flat(), tree.total, again)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, schema)], schema=schema)

    return run


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Trees to keep: ``doc_id, text`` (null: empty)``, lengths, counts`` (of each pre-token)``, n_tokens, n_reencoded`` (0).

    One tree a row: null and repeated ids are rows like others, a text of any length is one tree. No rows in, no rows out."""
    small_batches(docs.sparkSession)
    return docs.select(long_id(docs, id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_trees(tokenizer), TREES)


def edited_trees(trees: DataFrame, edits_col: str = "edits", tokenizer: str = TOKENIZER) -> DataFrame:
    """Kept trees (a table as ``token_trees`` gives) with a batch of edits applied to each (as in ``count_tokens``; null: none).

    Only what the edits touch is encoded again (``n_reencoded`` pre-tokens); the result can be kept and edited in turn. Rows that repeat a tree are edited each.
    No rows in, no rows out.
    """
    small_batches(trees.sparkSession)
    return trees.select("doc_id", "text", "lengths", "counts", F.col(edits_col).alias("edits")).mapInArrow(_trees(tokenizer), TREES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
