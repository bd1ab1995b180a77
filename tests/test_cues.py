"""Cues from aligned characters against plain loops over lists, on odd chunks and on every line of the small table."""

import difflib
import random
import unicodedata

import pytest
from cueline.functions import fragments as fr
from cueline.functions import text as tx
from cueline.operators import cues as cu
from cueline.operators import signals as sg
from cueline.plans import cues as plan
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
MARKS = set("。、，,！？!?…．・「」『』（）()【】〔〕〜~ー　 \t\r\n")
BREAKS = set("。、，,！？!?…．")
ITEM = "track string, chunk int, pos int, word string, start_ms long, end_ms long"


def timed(text):
    return [c for c in text if c not in MARKS]


def units_of(text, most, soft="、", ends="。？！?!"):
    out, held = [], ""
    for c in text:
        held += c
        if c in ends:
            out, held = [*out, held], ""
    if held.strip():
        out.append(held)
    cut = []
    for u in out:
        held = "" if len(timed(u)) > most else u
        for c in u if not held else "":
            held += c
            if c in soft and 10 * len(timed(held)) >= 6 * most:
                cut, held = [*cut, held], ""
        cut += [held] if held else []
    return cut


def stream_of(items, most_ms):
    out = []
    for _, word, a, b in sorted(x for x in items if None not in x[2:]):
        chars = timed(word or "")
        step = 0 if b <= a else (b - a) / max(1, len(chars))
        a, step = (b - len(chars) * most_ms, most_ms) if step > most_ms else (a, step)
        out += [(c, round(a + k * step, 3), round(a + (k + 1) * step, 3)) for k, c in enumerate(chars)]
    return out


def mapped(source, stream):
    """Every character of the source with a time; what is between known ones shares the room between them."""
    if not stream:
        return [(c, 0.0, 0.0) for c in source]
    at = [None] * len(source)
    for kind, a, b, c, d in difflib.SequenceMatcher(None, source, [x[0] for x in stream], autojunk=False).get_opcodes():
        for k in range(a, b):
            if kind == "equal":
                at[k] = stream[c + k - a][1:]
            elif kind == "replace":
                wide = max(0.0, stream[d - 1][2] - stream[c][1]) / (b - a)
                at[k] = (stream[c][1] + (k - a) * wide, stream[c][1] + (k - a + 1) * wide)
    k = 0
    while k < len(at):
        if at[k] is None:
            e = next((j for j in range(k, len(at)) if at[j]), len(at))
            right = at[e][0] if e < len(at) else None
            left = at[k - 1][1] if k else right if right is not None else stream[0][1]
            wide = max(0.0, (left if right is None else right) - left) / (e - k)
            at[k:e] = [(left + j * wide, left + (j + 1) * wide) for j in range(e - k)]
            k = e
        k += 1
    return [(c, *t) for c, t in zip(source, at)]


def no_runs(tokens):
    """Repeats of a filler, by positions of the characters that count."""
    small = set("。、，．・！？!?…．.,「」『』（）()【】〔〕〜~ーｰっッぁぃぅぇぉ　 \t\r\n\"'")
    sign = ["" if (c := unicodedata.normalize("NFKC", t[0][:1])) in small else c for t in tokens]
    behind = [any(c in "。、，．,.！？!?…・" for c in t[0][1:]) for t in tokens]

    def end_of(core, at):
        for c in core:
            while at < len(sign) and not sign[at]:
                at += 1
            if at == len(sign) or sign[at] != c:
                return None
            at += 1
        while at < len(sign) and not sign[at]:
            at += 1
        return at

    gone, i = set(), 0
    while i < len(sign):
        found = None
        for core in sorted(fr.FILLERS + fr.REPLIES, key=len, reverse=True) if sign[i] else ():
            edges = [i]
            while (e := end_of(core, edges[-1])) is not None:
                edges.append(e)
            if len(edges) > 3 and all(behind[e - 1] for e in edges[1:-1]) and core * (len(edges) - 1) not in fr.FILLERS:
                found = edges
                break
        if not found:
            i += 1
            continue
        if (i == 0 or behind[i - 1]) and (found[-1] == len(sign) or behind[found[-1] - 1]):
            a, b = found[-2:] if found[-1] < len(sign) else found[:2]
            gone |= set(range(i, found[-1])) - set(range(a, b))
        i = found[-1]
    return [t for k, t in enumerate(tokens) if k not in gone]


def pieces_of(tokens, most, longest):
    out, i = [], 0
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and j - i < most and tokens[j - 1][2] - tokens[i][1] <= longest:
            j += 1
        cut = j
        if j < len(tokens):
            marks = [k for k in range(i + 1, j + 1) if tokens[k - 1][3]]
            gaps = [(tokens[k][1] - tokens[k - 1][2], k) for k in range(i + 1, j + 1)]
            gaps = [g for g in gaps if g[0] >= 120]
            cut = marks[-1] if marks else max(gaps)[1] if gaps else j
        out.append(tokens[i:cut])
        i = cut
    return out


def tokens_of(text, stream, most, soft):
    pos = 0
    for u in units_of(text, most, soft):
        n, tokens, front, k = len(timed(u)), [], "", 0
        span = stream[pos : pos + n]
        pos += n
        for c in u if span else "":
            if c in MARKS and not tokens:
                front += c
            elif c in MARKS or k == len(span):
                tokens[-1] = (tokens[-1][0] + c, *tokens[-1][1:3], tokens[-1][3] or c in BREAKS)
            else:
                tokens.append((front + c, *span[k][1:], False))
                front, k = "", k + 1
        if tokens:
            yield tokens


def cues_of(text, items, offset, most, longest, least, usual, most_ms, fillers, ellipses_end, by_pauses):
    stream = stream_of(items, most_ms)
    stream, out = stream if by_pauses else mapped(timed(text), stream), []
    for tokens in tokens_of(text, stream, most, "、" if ellipses_end else "、…"):
        segments = [[tokens[0]]]
        for k, t in enumerate(tokens[1:], 1):
            own = segments[-1]
            gap = t[1] - own[-1][2]
            torn = gap > usual and not fr.belongs("".join(x[0] for x in own), "".join(x[0] for x in tokens[k : k + 8]), gap, usual)
            trails = not ellipses_end and "…" in own[-1][0] and gap > 400
            if by_pauses and (trails or torn):
                segments.append([t])
            else:
                own.append(t)
        for s in segments:
            for p in pieces_of(no_runs(s) if fillers else s, most, longest):
                a, b = offset + p[0][1], offset + p[-1][2]
                shown = "".join(x[0] for x in p).strip()
                out += [(round(a, 3), round(min(max(b, a + least), a + longest), 3), shown, b - a <= 1)] if shown else []
    return out


def chunks_of(seed, n=120):
    rnd, texts, items = random.Random(seed), [], []
    for k in range(n):
        text = "".join(rnd.choice("うんうんはいあのてをしX、、。…ー「」っ　, ") for _ in range(rnd.randrange(90)))
        if k % 3 == 0:
            text = rnd.choice(("うん、うん、うん、", "あ、あー、あっ。", "はいはいはい", "うんうん、うん、")) * rnd.randrange(1, 4) + text
        texts.append(("t", k, None if k % 17 == 5 else text, float(rnd.randrange(10_000))))
        at = 0
        for p, word in enumerate(text[i : i + 3] for i in range(0, len(text), 3)):
            at += rnd.choice((0, 0, 50, 130, 130, 450, 1300, 3000, 8000))
            to = at + rnd.choice((0, 100, 300, 900, 5000))
            if k % 11 != 3 and rnd.random() > 0.04:
                items.append(("t", k, p, word if rnd.random() > 0.05 else "Y", None if rnd.random() < 0.02 else at, to))
            at = to
    return texts, items


OPTIONS = [{}, {"fillers": False}, {"ellipses_end": False}, {"by_pauses": False}, {"by_pauses": False, "ellipses_end": False, "fillers": False}]


@pytest.mark.parametrize("options", OPTIONS)
def test_aligned_cues(spark, options):
    texts, items = chunks_of(len(str(options)))
    got = cu.aligned_cues(spark.createDataFrame(texts, "track string, chunk int, text string, offset_ms double"), spark.createDataFrame(items, ITEM), 12, 4000, 300, 700, 250, **options)
    found = sorted((r.chunk, r.i, round(r.start_ms, 3), round(r.end_ms, 3), r.text, r.collapsed) for r in got.collect())
    want = []
    for _, k, text, offset in texts:
        if text is not None:
            own = cues_of(text, [x[2:] for x in items if x[1] == k], offset, 12, 4000, 300, 700, 250, **({"fillers": True, "ellipses_end": True, "by_pauses": True} | options))
            want += [(k, *x) for x in own]
    assert [(f[0], *f[2:]) for f in found] == want and len(want) > 200


def test_cues_of_every_line(spark):
    """The registered query on the whole small table."""
    items, want = {}, []
    for r in plan.aligned(spark, SMALL).collect():
        items.setdefault((r.track, r.chunk), []).append((r.pos, r.word, r.start_ms, r.end_ms))
    for r in plan.spoken(spark, SMALL).orderBy("track", "chunk").collect():
        own = cues_of(r.text, items.get((r.track, r.chunk), []), r.offset_ms, plan.MOST, plan.LONGEST_MS, plan.LEAST_MS, plan.USUAL_MS, plan.CHARACTER_MS, True, True, True)
        want += [(r.track, r.chunk, *x) for x in own]
    got = plan.QUERIES["g11_aligned_cues"][0](spark, SMALL).orderBy("track", "chunk", "i").collect()
    assert [(r.track, r.chunk, round(r.start_ms, 3), round(r.end_ms, 3), r.text, r.collapsed) for r in got] == want
    assert sum(x[-1] for x in want) and len({x[:2] for x in want}) > 1000


def test_budget_on_every_line(spark):
    t = plan.tokens(spark, SMALL).collect()
    groups = {}
    for r in sorted(t, key=lambda r: (r.track, r.chunk, r.unit, r.i)):
        groups.setdefault((r.track, r.chunk, r.unit), []).append((r.i, r.start_ms, r.end_ms, r.brk))
    want = {(*k, x[0]): n for k, own in groups.items() for n, p in enumerate(pieces_of(own, plan.MOST, plan.LONGEST_MS)) for x in p}
    got = {(r.track, r.chunk, r.unit, r.i): r.piece for r in plan.QUERIES["g09_budget_pieces"][0](spark, SMALL).collect()}
    assert got == want and max(want.values()) > 2


def test_runs_of_fillers():
    def one(*shown):
        return "".join(t for t, s in zip(shown, fr.filler_runs(shown)) if s)

    shown = ["う", "ん、", "う", "ん、", "う", "ん、", "一", "人。"]
    assert [t for t, s in zip(shown, fr.filler_runs(shown)) if s] == ["う", "ん、", "一", "人。"]
    assert one("は、", "は、", "は、") == "は、" and one("ふ", "ふ", "ふ") == "ふふふ"
    assert fr.filler_runs(["あ、", "あ、"]) == [True, True] and fr.filler_runs([]) == []
    rnd = random.Random(7)
    for _ in range(4000):
        shown = [rnd.choice("うんはいあっーえX") + rnd.choice(("", "、", "、", "。")) for _ in range(rnd.randrange(14))]
        assert [t for t, s in zip(shown, fr.filler_runs(shown)) if s] == [t[0] for t in no_runs([(x,) for x in shown])], shown


@pytest.mark.parametrize("left, right, gap, kept", [("使っ", "て", 3000, True), ("何欲しいん", "だ。", 6000, True), ("何欲しいん", "だ。", 6600, False), ("うん", "て", 2000, False), ("そうです。", "だから行く", 2000, False), ("私の", "本があるから", 2000, True), ("行きます", "ません", 2000, True), ("", "て", 2000, False), ("長い長い長い文です。", "次の文", 900, True), ("見る", "「た", 2000, True), ("私の", "!", 1001, False)])
def test_phrases_across_a_pause(spark, left, right, gap, kept):
    assert fr.belongs(left, right, gap, 1000) is kept


def test_kept_together_of_columns(spark):
    df = spark.createDataFrame([("使っ", "て", 3000.0), (None, "て", 1.0), ("a", "b", None)], "a string, b string, g double")
    assert [r[0] for r in df.select(fr.kept_together("a", "b", "g", F.lit(1000.0))).collect()] == [True, None, None]


def test_units_and_pieces(spark):
    """Cuts of texts by patterns against one pass over the characters, also on long texts."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc。、、，！ 　…\n") for _ in range(rnd.randrange(200))) for _ in range(300)] + ["ab、" * 20_000, "x" * 30_000, "", "　 ", "、" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    for most in (1, 7, 30):
        got = {r.n: r.u for r in df.select("n", tx.sentences(F.col("t"), most).alias("u")).collect()}
        assert got == {i: units_of(t, most) for i, t in enumerate(texts)}
    for r in df.select("t", tx.length_pieces(F.col("t")).alias("u")).collect():
        want, held = [], ""
        for c in r.t if len(timed(r.t)) > 50 else "":
            held += c
            n = len(timed(held)) if len(held) < 400 or c in "、，," else 0
            if (c in "、，," and n >= 50) or n >= 80:
                want, held = [*want, held], ""
        want = [x for x in ([*want, held] if len(timed(r.t)) > 50 else [r.t]) if timed(x)]
        assert r.u == want


def test_unit_faults_with_ellipses(spark):
    """Ellipses end no unit; in soft mode an overlong unit may be cut at them."""
    texts = spark.createDataFrame([("t", 1, "ああ…いい…うう…ええ"), ("t", 2, None)], "track string, chunk int, text string")
    items = spark.createDataFrame([("t", 1, k, c, k * 100, k * 100) for k, c in enumerate("ああいいうう")], ITEM)
    found = lambda soft: sorted((r.unit, r.reasons) for r in sg.unit_faults(texts, items, 500, 3, soft=soft).collect())
    assert found("、") == [(0, "missing_chars")]
    assert found("、…") == [(3, "missing_chars")]
