"""Text expressions and predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D\x{3000}]+"
#: Marks at the edges of a phrase; pauses inside a loop; characters that take no time; ends of sentences.
EDGE = "。、．，！？!?…・ー～~ \u3000"
PAUSES = "。、．，！？!?…・ー～~"
UNTIMED = "。、，,！？!?…．・「」『』（）()【】〔〕〜~ー\u3000 \t\r\n"
SENTENCE_ENDS = "。？！?!"
DOTS, CLOSERS = "…‥", "。、!?…！？♪～"
#: White space that Java's patterns and Spark's trim don't take for such, beside the ASCII kinds.
WIDE_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = " \t\n\x0b\x0c\r" + WIDE_BLANKS
#: What Unicode calls white space: those without the separators of ASCII.
WHITE_SPACE = "".join(c for c in SPACES if not "\x1c" <= c <= "\x1f")
SOUNDS = "あぁアァうぅウゥんンはハぁー〜…・。、,.!?！？"
#: Sounds and how they are written out; longer or lexical replies are left alone.
VOICED = {"あぁアァ": "啊", "いぃイィ": "咿", "うぅウゥ": "呜", "えぇエェ": "诶", "おぉオォ": "哦", "んン": "嗯", "はハ": "哈", "ふフ": "呼", "っッ": "", "ー〜": "…"}
UNVOICED = r"(?U)[\s。、，,.!?！？…ー〜♥♡♪っッ]"
LEXICAL = "^(いい|はい|うん|ううん|ええ)+$"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, where f uses it many times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def compact(t: Column) -> Column:
    return F.regexp_replace(t, BLANK, "")


def phrase_key(t: Column, edge: str = EDGE) -> Column:
    """A text without blanks and edge marks, to count phrases by."""
    return F.btrim(compact(t), F.lit(edge))


def symbol_noise(t: Column) -> Column:
    """Symbols and controls: two and half the text, or one in a text of two characters."""
    c = compact(t)
    n, size = F.regexp_count(c, F.lit(r"[\p{S}\p{C}]")), F.length(c)
    return ((n >= 2) & (n * 2 >= size)) | ((n >= 1) & (size <= 2))


def contains_any(t: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))


def dominant_share(t: Column) -> Column:
    """Count of the commonest character over the length; 1 for nothing."""

    def share(c: Column) -> Column:
        counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
        return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(F.array_max(counts) / F.length(c))

    return let(compact(t), share)


def mostly_one(t: Column, least: float) -> Column:
    """Whether the commonest character has that share, of more than half; it then lies in the middle of the characters in order, so no other is counted."""
    c = compact(t)
    middle = F.get(F.sort_array(characters(c)), F.floor(F.length(c) / 2).cast("int"))
    return F.coalesce((F.length(c) - F.length(F.replace(c, middle, F.lit("")))) / F.nullif(F.length(c), F.lit(0)) >= least, c == "")


def _none_of(t: Column, marks: str) -> Column:
    return F.translate(t, marks, "")


def looping(t: Column) -> Column:
    """A unit of one to four characters five times or more, six characters at least, pauses aside."""
    return F.length(F.regexp_extract(_none_of(compact(t), PAUSES), r"(.)\1{4,}|(..)\2{4,}|(...)\3{4,}|(....)\4{4,}", 0)) >= 6


def noise(t: Column, least: int = 2) -> Column:
    """Nothing, too little, one short unit all along, mostly one character, a loop, or four or more sounds and marks only."""
    c = compact(t)
    whole = F.lit(False)
    for k in (1, 2, 3):
        unit = F.substring(c, 1, k)
        whole = whole | ((F.length(c) >= 3 * k) & (F.length(c) % k == 0) & (F.replace(c, unit, F.lit("")) == ""))
    sounds = (F.length(c) >= 4) & (_none_of(c, SOUNDS) == "")
    return (F.length(c) == 0) | (F.length(c) < least) | whole | ((F.length(c) >= 5) & mostly_one(t, 0.8)) | looping(t) | sounds


def exceeds(ratio: Column, most: float) -> Column:
    """Whether a measure is there and reaches a bound."""
    return F.coalesce(ratio >= most, F.lit(False))


def timed_characters(t: Column) -> Column:
    """The characters that take time: no marks, no blanks."""
    return characters(_none_of(t, UNTIMED))


def n_timed(t: Column) -> Column:
    """How many characters of a text take time."""
    return F.length(_none_of(t, UNTIMED))


def stripped(t: Column) -> Column:
    """Without white space at the ends, ideographic and other wide blanks included."""
    return F.btrim(t, F.lit(SPACES))


def asr_clean(t: Column) -> Column:
    """Trim, drop ellipses and blanks at the start, fold units repeated three times and runs of ellipses, end with a stop. Nothing is left of blanks, or of dots
    with other closing marks. Full stops at the start stay."""
    x = stripped(t)
    nothing = x.rlike(r"(?U)^[…‥\.．?!？！」』\)）\]\s]+$") & x.rlike(r"[…‥\.．]")
    y = F.ltrim(x, F.lit(DOTS + SPACES))
    y = F.regexp_replace(y, r"(.{2,20}?)\1{2,}", "$1")
    y = F.regexp_replace(y, f"[{DOTS}]{{2,}}", "…")
    return F.when((y == "") | nothing, F.lit("")).when(F.contains(F.lit(CLOSERS), F.right(y, F.lit(1))), y).otherwise(F.concat(y, F.lit("。")))


def characters(t: Column) -> Column:
    """A text as a list of its characters, without a pattern; an empty text has none."""
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def _best_place(t: Column, mark: str, rank) -> Column:
    """The place from 1 to length - 1 of least rank among those that hold the mark. ``rank`` grows with the distance from the middle on either side, so only
    the last place up to the middle and the first one after it are ranked; null if there is none."""
    n, half = F.length(t), F.floor(F.length(t) / 2).cast("int")
    left = F.substr(t, F.lit(1), half)
    before = half - F.length(F.substring_index(left, mark, -1))
    after = F.instr(F.substr(t, half + 1, F.greatest(n - 1 - half, F.lit(0))), mark)
    places = F.array(F.when(before > 0, rank(before, n)), F.when(after > 0, rank(half + after, n)))
    return F.array_min(places)["i"]


def wrap_at_marks(t: Column, most: int, marks: str = ".!?,;。！？、") -> Column:
    """Two lines, broken after the mark nearest the middle (the earlier of two); else unchanged."""
    best = _best_place(F.translate(t, marks, marks[0] * len(marks)), marks[0], lambda i, n: F.struct(F.abs(i * 2 - n).alias("d"), i.alias("i")))
    return F.when((F.length(t) <= most) | best.isNull(), t).otherwise(F.concat(F.substr(t, F.lit(1), best), F.lit("\n"), F.ltrim(F.substr(t, best + 1), F.lit(SPACES))))


def wrap_at_blanks(t: Column, most: int) -> Column:
    """Two lines, broken at the blank nearest the middle, better so that both fit."""
    best = _best_place(t, " ", lambda i, n: F.struct(((i - 1 > most) | (n - i > most)).alias("o"), F.abs(i * 2 - n).alias("d"), i.alias("i")))
    return F.when((F.length(t) <= most) | best.isNull(), t).otherwise(F.concat(F.substr(t, F.lit(1), best - 1), F.lit("\n"), F.substr(t, best + 1)))


def ass_escape(t: Column) -> Column:
    x = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.translate(x, "{}", "()"), F.lit("\n"), F.lit("\\N"))


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbouring characters, blanks aside. One pass over the characters: substrings by index would take the square of the length."""

    def pairs(chars: Column) -> Column:
        n = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda x, y: F.concat(x, y)))

    return let(characters(compact(t)), pairs)


def set_overlap(a: Column, b: Column) -> Column:
    return let(a, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, b)) / F.size(x)))


def short_context(t: Column, fillers: Sequence[str] = ()) -> Column:
    """Two characters or fewer, marks only, or a filler: too little to go by."""
    c = F.translate(compact(t), "？！", "?!")
    return (F.length(c) <= 2) | (_none_of(c, "、。！？!?…ー〜・-.") == "") | (c.isin(*fillers) if fillers else F.lit(False))


def repeats(t: Column, longest: int, times: int) -> Column:
    """Whether a unit of up to ``longest`` characters stands ``times`` times in a row."""
    return t.rlike(rf"(.{{1,{longest}}}?)\1{{{times - 1},}}")


def degenerate(source: Column, t: Column) -> Column:
    """Far longer than the source, or a unit of one to five characters six times or more."""
    return (F.length(t) > F.greatest(F.lit(40), F.length(source) * 3 + 10)) | repeats(t, 5, 6)


KANA, HAN = r"[\x{3041}-\x{3096}\x{30A1}-\x{30FA}]", r"[\x{4E00}-\x{9FFF}]"


def latin_safe(source: Column, t: Column) -> Column:
    """A usable translation into a Latin script: not empty, no kana or Han, no runaway length, no unit of up to twelve
    characters six times."""
    return (t != "") & ~t.rlike(f"{KANA}|{HAN}") & (F.length(t) <= F.greatest(F.lit(240), F.length(source) * 10 + 80)) & ~repeats(t, 12, 6)


def residue(t: Column, foreign: str = "") -> Column:
    """What is left of the source's script: kana, a character of ``foreign``, another Han character, or none."""
    other = F.translate(t, foreign, "") != t if foreign else F.lit(False)
    return F.when(t.rlike(r"[\x{3041}-\x{30FF}]"), F.lit("kana")).when(other, F.lit("foreign")).when(t.rlike(HAN), F.lit("han")).otherwise(F.lit("none"))


def voiced(t: Column) -> Column:
    """A text of sounds only, written out sound by sound; null for anything else, above all for short replies that mean something."""
    core = F.regexp_replace(t, UNVOICED, "")
    hira = F.translate(core, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))
    sounds = "".join(k for k, v in VOICED.items() if k not in ("っッ", "ー〜"))
    from_, to = "".join(k for k, v in VOICED.items() if v), "".join(v * len(k) for k, v in VOICED.items() if v)
    plain = (core != "") & (F.length(core) <= 12) & ~hira.rlike(LEXICAL) & (_none_of(core, sounds) == "")
    return F.when(plain, stripped(F.translate(t, from_ + "っッ", to)))


def converted(t: Column, characters_: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """A text in another script by a table of phrases, longest first, then of single characters."""
    for k in sorted(phrases or {}, key=lambda k: (-len(k), k)):
        t = F.replace(t, F.lit(k), F.lit(phrases[k]))
    return F.translate(t, "".join(characters_), "".join(characters_.values()))


#: Labels before an answer's body, words that begin an explanation, tags.
LABELS, EXPLAINS, TAGS = "翻译结果|译文", "解释|说明|翻译说明|Explanation|Translation notes", ("target", "current", "context")


def answer(t: Column, separator: str = "") -> Column:
    """The body of a model's answer: without fence, label and one ``target`` or ``current`` tag, lines joined. Empty where a
    tag is repeated or a line is numbered, explains, or holds another fence or tag."""
    tag = lambda x, n: F.regexp_extract_all(x, F.lit(f"(?s)<{n}>(.*?)</{n}>"), F.lit(1))
    x = F.regexp_replace(stripped(t), r"(?s)^```[^\n]*\n(.*?)\n```$", "$1")
    one = F.when(F.size(tag(x, "target")) > 0, tag(x, "target")).when(F.size(tag(x, "current")) > 0, tag(x, "current")).otherwise(F.array(x))
    body = F.regexp_replace(stripped(F.get(one, F.lit(0))), rf"^({LABELS})[:：]\s*", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), stripped), lambda y: y != "")
    odd = rf"(?i)^(\[\d+\]|\d+([.)]\s+|、)|({EXPLAINS})[:：]|```|</?({'|'.join(TAGS)})>)"
    return F.when((F.size(one) > 1) | F.exists(lines, lambda y: y.rlike(odd)), F.lit("")).otherwise(F.array_join(lines, separator))


def _class(marks: str, none: bool = False) -> str:
    """A class of characters as a pattern: the marks, or all others. Patterns ask for one mark after the other, so ASCII letters and digits, and for marks the
    blank, are told apart before many are asked for."""
    each = "".join("\\x{%x}" % ord(c) for c in marks)
    if len(marks) < 8 or any(c.isascii() and c.isalnum() for c in marks):
        return ("[^" if none else "[") + each + "]"
    if none:
        return f"[0-9A-Za-z[^{each}]]"
    return ("[\\x20" if " " in marks else "[") + f"[[^0-9A-Za-z]&&[{each}]]]"


def _timed(n: int, marks: str = UNTIMED) -> str:
    """``n`` timed characters with what marks stand before each."""
    return f"(?:{_class(marks)}*+{_class(UNTIMED, True)}){{{n}}}"


def sentences(t: Column, most: int, ends: str = SENTENCE_ENDS, soft: str = "、") -> Column:
    """Sentence units: cut after ends; a unit of more than ``most`` timed characters also after soft marks once it holds
    three fifths of that. What blanks alone are left over at the end goes."""
    units = F.filter(F.split(t, f"(?<={_class(ends)})"), lambda u: u.rlike(r"(?U)[^\s]"))
    part = f"(?s){_timed(max(1, -(-most * 6 // 10)))}{_class(soft, True)}*+{_class(soft)}|.+"
    return F.flatten(F.transform(units, lambda u: F.when(F.length(_none_of(u, UNTIMED)) <= most, F.array(u)).otherwise(F.regexp_extract_all(u, F.lit(part), F.lit(0)))))


def timed_pieces(t: Column, comma_from: int = 50, most: int = 80, commas: str = "、，,") -> Column:
    """``length_pieces`` as structs of ``text``, ``begin`` and ``upto``, the timed characters before it and up to its end. Lines are cut in batches: Java's patterns ask for one mark of a
    class after the other."""
    u, others, rest = re.escape(UNTIMED), re.escape("".join(c for c in UNTIMED if c not in commas)), most - comma_from
    one = f"[{others}]*+[^{u}]"
    long, untimed = re.compile(f"(?:[{u}]*+[^{u}]){{{comma_from + 1}}}"), re.compile(f"[{u}]+")
    part = re.compile(f"(?s)(?:[{u}]*+[^{u}]){{{comma_from}}}(?:(?:{one}){{{rest}}}|(?:{one}){{0,{max(0, rest - 1)}}}[{others}]*+[{re.escape(commas)}])|.+")

    def run(texts: pa.Array) -> pa.Array:
        ends, out, begins, uptos = [], [], [], []
        for text in texts.to_pylist():
            ends.append(None if text is None else len(out))
            upto = 0
            for p in () if text is None else part.findall(text) if long.match(text) else (text,):
                if n := len(untimed.sub("", p)):
                    out.append(p)
                    begins.append(upto)
                    uptos.append(upto := upto + n)
        rows = pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(begins, pa.int32()), pa.array(uptos, pa.int32())], ["text", "begin", "upto"])
        return pa.ListArray.from_arrays(pa.array([*ends, len(out)], pa.int32()), rows)

    return F.arrow_udf(run, "array<struct<text:string,begin:int,upto:int>>")(t)


def length_pieces(t: Column, comma_from: int = 50, most: int = 80, commas: str = "、，,") -> Column:
    """A text of more than ``comma_from`` timed characters cut after commas beyond that many and hard at ``most``; pieces
    without timed characters go."""
    return timed_pieces(t, comma_from, most, commas)["text"]


def shown_characters(t: Column) -> Column:
    """The timed characters of a text, each with the marks behind it, the first also with those before it."""
    return F.regexp_extract_all(t, F.lit(f"(?s)^{_class(UNTIMED)}*{_class(UNTIMED, True)}{_class(UNTIMED)}*|{_class(UNTIMED, True)}{_class(UNTIMED)}*"), F.lit(0))


def overlong(t: Column, most: int) -> Column:
    """Whether any line is longer than ``most``."""
    return t.rlike(rf"(?dm)^[^\n]{{{most + 1}}}")


def alias_of(t: Column, aliases: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.when(stripped(t) == "", F.lit(default)).otherwise(F.coalesce(F.create_map(*pairs)[F.lower(stripped(t))], t))


def class_of(a: Column, b: Column, names: tuple[str, str], least: float) -> Column:
    return F.when(F.greatest(a, b) < least, F.lit(None).cast("string")).when(a >= b, F.lit(names[0])).otherwise(F.lit(names[1]))
