"""Where a text may be torn: fragments that belong together across a pause, and runs of one filler."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normal import NO_CORE
from .text import SENTENCE_ENDS, UNTIMED

#: Fillers and the one reply that counts as such; how the second part of a torn phrase begins; how its first part ends; ends of words that
#: want a continuation; beginnings that follow half a word; endings that always belong to what stands before; marks that part fillers.
FILLERS = ("うん", "ううん", "ん", "んん", "ねえ", "ね", "あ", "ああ", "あん", "は", "はあ", "はん", "ふ", "ふう", "ふん", "え", "ええ", "お", "おお", "おう", "う", "うう", "ひ", "ひん", "へ", "ほ")
REPLIES = ("はい",)
TAILS = ("ん", "だ", "です", "でし", "ます", "ませ", "ました", "ない", "な", "て", "た", "ちゃ", "じゃ", "の", "か", "から", "けど", "という", "って", "に", "よ", "ね")
PARTICLES = ("の", "が", "を", "に", "へ", "と", "で", "から", "まで", "より", "も")
OPEN_ENDS = ("し", "っ", "い", "ん", "く", "ぐ", "す", "つ", "ぬ", "ぶ", "む", "る")
HALF_WORDS, ALWAYS = ("て", "た", "ちゃ", "という"), ("ん", "ませ")
PARTING = "。、，．,.！？!?…・"
#: Fixed values, in milliseconds and characters: the widest pause inside a fragment; longest particle phrase, tail and half word.
WIDEST_MS, SHORT_LEFT, SHORT_RIGHT, HALF_LEFT = 6500, 4, 5, 8
_ENDS = tuple(SENTENCE_ENDS)
_TIMELESS = str.maketrans("", "", UNTIMED)


def bare(text: str) -> str:
    """Compatibility form without marks and blanks."""
    return unicodedata.normalize("NFKC", text).strip().translate(_TIMELESS)


def belongs(left: str, right: str, gap_ms: float, usual_ms: float) -> bool:
    """Whether a pause between two texts is inside one phrase: no longer than usual, or, up to WIDEST_MS, between parts of which one can't stand alone and
    neither is a filler."""
    if gap_ms <= usual_ms:
        return True
    a, b = bare(left), bare(right)
    if gap_ms > WIDEST_MS or not a or not b or {a, b} & {*FILLERS, *REPLIES}:
        return False
    ended = left.rstrip().endswith(_ENDS)
    hangs = len(a) <= SHORT_LEFT and a.endswith(PARTICLES)  # waits for what it refers to
    torn = not ended and (hangs or a.endswith(OPEN_ENDS))
    tail = len(b) <= SHORT_RIGHT and b.startswith(TAILS) and (torn or b.startswith(ALWAYS))
    half = not ended and len(a) <= HALF_LEFT and b.startswith(HALF_WORDS)
    return tail or half or (hangs and not right.lstrip().startswith(_ENDS))


@F.pandas_udf(T.BooleanType())
def kept_together(left: pd.Series, right: pd.Series, gap_ms: pd.Series, usual_ms: pd.Series) -> pd.Series:
    """``belongs`` of each row; null where a text or a time is null."""
    rows = zip(left, right, gap_ms, usual_ms)
    return pd.Series([None if any(pd.isna(x) for x in r) else belongs(*r) for r in rows], dtype=object)


@cache
def _sign(c: str) -> str:
    return unicodedata.normalize("NFKC", c)


@cache
def filler_signs(cores: tuple[str, ...] = FILLERS + REPLIES) -> str:
    """The characters, of the first 65,536, that a filler may begin with, in any compatible form."""
    firsts = {k[0] for k in cores}
    return "".join(c for c in map(chr, range(0x10000)) if unicodedata.normalize("NFKC", c) in firsts)


@cache
def _patterns(cores: tuple[str, ...], least: int) -> dict[str, list[tuple[str, re.Pattern]]]:
    """By first sign: fillers, longest first, with the pattern of their runs as cells."""
    found: dict[str, list[tuple[str, re.Pattern]]] = {}
    for k in sorted(cores, key=len, reverse=True):
        found.setdefault(k[0], []).append((k, re.compile("(?:" + "[,;]".join(map(re.escape, k)) + "[,;]){%d,}" % least)))
    return found


def filler_runs(shown: Sequence[str], cores: Sequence[str] = FILLERS + REPLIES, whole: Sequence[str] = FILLERS, least: int = 3) -> list[bool]:
    """Which of a row of characters (each with the marks behind it) stay when runs of one filler, ``least`` times or more and each time parted by a mark, are
    left with one: the last of them before other characters, the first at the end. Small kana and lengtheners go with the character before.

    The row is written as cells of two signs, a character and whether a mark parts it from the next cell, so that a run is a match of a pattern.
    """
    firsts = {k[0] for k in cores}
    if {_sign(t[:1]) for t in shown}.isdisjoint(firsts):
        return [True] * len(shown)
    cells: list[list[int]] = []  # places of the characters of each cell; the first may hold only small ones
    signs = []
    for i, t in enumerate(shown):
        c = _sign(t[:1])
        if c in NO_CORE or not c:
            if not cells:
                cells.append([])
                signs.append("\0")
            cells[-1].append(i)
        else:
            cells.append([i])
            signs.append(c if len(c) == 1 else "\0")
    parted = ["," if any(c in PARTING for c in shown[own[-1]][1:]) else ";" for own in cells]
    row = "".join(c + p for c, p in zip(signs, parted))
    stay, at = [True] * len(shown), 0
    by_length = _patterns(tuple(cores), least)
    while at < len(cells):
        if signs[at] not in firsts:
            at += 1
            continue
        size = end = 0
        for k, pattern in by_length[signs[at]]:
            if m := pattern.match(row, 2 * at):
                n = (m.end() - m.start()) // (2 * len(k))
                marks = row[m.start() + 2 * len(k) - 1 : m.end() - 1 : 2 * len(k)]
                if "," * (n - 1) == marks[: n - 1] and k * n not in whole:
                    size, end = len(k), m.end() // 2
                    break
        if not size:
            at += 1
            continue
        if (at == 0 or parted[at - 1] == ",") and (end == len(cells) or parted[end - 1] == ","):
            kept = range(end - size, end) if end < len(cells) else range(at, at + size)
            for k in range(at, end):
                for i in cells[k] if k not in kept else ():
                    stay[i] = False
        at = end
    return stay
