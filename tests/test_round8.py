"""Findings on larger tables: steps that worked on one character at a time, or moved more than they need."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
from cueline.functions.fragments import belongs, filler_runs
from cueline.functions.text import SENTENCE_ENDS, UNTIMED, WHITE_SPACE
from cueline.operators import cues as cu
from cueline.operators import folds as fo
from cueline.operators import runs as rn
from cueline.operators import signals as sg
from cueline.operators import units as un
from cueline.plans.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
U = re.escape(UNTIMED)


def by_sql(query, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, con.execute(ORACLES[query]).fetchall()), key=str)


def rounded(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def plain_units(text, most, soft):
    """Number, characters as shown."""
    part = re.compile(f"(?s)(?:[{U}]*+[^{U}]){{{max(1, -(-most * 6 // 10))}}}[^{soft}]*+[{soft}]|.+")
    found = [u for u in re.split(f"(?<=[{SENTENCE_ENDS}])", text) if u.strip(WHITE_SPACE)]
    found = [p for u in found for p in ([u] if len(re.sub(f"[{U}]", "", u)) <= most else part.findall(u))]
    return [(k, re.findall(f"^[{U}]*[^{U}][{U}]*|[^{U}][{U}]*", u)) for k, u in enumerate(found)]


def plain_tokens(text, times, most, soft):
    """Unit and its tokens (place, shown, start, end), one character after the other."""
    at = 0
    for unit, shown in plain_units(text, most, soft):
        own = times[at : at + len(shown)]
        if own:
            yield unit, [(at + k + 1, s if k + 1 < len(own) else "".join(shown[k:]), *x) for k, (s, x) in enumerate(zip(shown, own))]
        at += len(shown)


def plain_pieces(text, times, most, longest, usual, ellipses_end):
    for unit, t in plain_tokens(text, times, most, "、" if ellipses_end else "、…"):
        segments, lo = [], 0
        for k in range(1, len(t)):
            gap = t[k][2] - t[k - 1][3]
            if (not ellipses_end and "…" in t[k - 1][1] and gap > 400) or (gap > usual and not belongs("".join(x[1] for x in t[lo:k]), "".join(x[1] for x in t[k : k + 8]), gap, usual)):
                segments.append(t[lo:k])
                lo = k
        for number, s in enumerate([*segments, t[lo:]]):
            s = [x for x, stay in zip(s, filler_runs([x[1] for x in s])) if stay]
            piece, at = 0, 0
            while at < len(s):
                hi = at + 1
                while hi < min(len(s), at + most) and not s[hi - 1][3] - s[at][2] > longest:
                    hi += 1
                if hi < len(s):
                    full, pauses = hi, [(g, k) for k in range(at + 1, hi + 1) if (g := s[k][2] - s[k - 1][3]) >= 120]
                    hi = next((k for k in range(full, at, -1) if re.search(f"[^{U}][{U}]*[{re.escape(cu.BREAKS)}]", s[k - 1][1])), 0) or (max(pauses)[1] if pauses else full)
                yield unit, number, piece, s[at][0], s[at][2], s[hi - 1][3], "".join(x[1] for x in s[at:hi])
                piece, at = piece + 1, hi


@pytest.fixture(scope="module")
def chunks(spark):
    """Random chunks: odd blanks and marks, fillers, wide characters, streams too short or too long, long lines; some with no text, some with no items."""
    rnd, rows, items = random.Random(5), [], []
    for k in range(400):
        bits = rnd.choices(["一", "二三", "うん、うん、うん、", "あ、", "ｱ、", "はい。", "。", "、", "…", "？！", " ", " ", "　", "\x1c", "ー", "\U0001f600", "é", "⁇", "abc ", "のが", "た", "\n", "は", "。  "], k=rnd.choice((0, 1, 5, 20, 60, 400 if k % 40 == 0 else 30)))
        text = None if k % 50 == 49 else "".join(bits)
        rows.append((k, text))
        at, need = 0.0, len(re.sub(f"[{U}]", "", text or "一二"))
        need += rnd.choice((0, 0, 0, 2, -1, -need // 2))
        pos = 0
        while need > 0 and k % 37 != 5:
            n = min(need, rnd.choice((1, 1, 2, 3, 7)))
            at += rnd.choice((0, 0, 20, 150, 450, 1300, 3000, 7000))
            wide = rnd.choice((0, 0, n * 90, n * 90, 100, 1000.5, 5000, -40))
            items.append((k, pos, "字" * n + rnd.choice(("", "。", " ")), at, at + wide))
            items += [(k, pos, "、", at, at + 9)] * (pos % 9 == 4) + [(k, pos, "字", None, at)] * (pos % 11 == 6)
            at, pos, need = at + max(wide, 0), pos + 1, need - n
    return spark.createDataFrame(rows, "chunk int, text string"), spark.createDataFrame(items, "chunk int, pos int, word string, start_ms double, end_ms double"), rows, items


def plain_times(items, most_ms):
    out = {}
    for chunk, _, word, a, b in sorted((x for x in items if None not in x), key=lambda x: x[:2]):
        if n := len(re.sub(f"[{U}]", "", word)):
            per = (b - a) / n
            base, step = (b - n * most_ms if per > most_ms else a), 0.0 if b <= a else min(per, most_ms)
            at = [rounded(base + k * step) for k in range(n + 1)]
            out.setdefault(chunk, []).extend(zip(at, at[1:]))
    return out


@pytest.mark.parametrize("ellipses_end", [True, False])
@pytest.mark.parametrize("most", [7, 30])
def test_pieces_of_units_side_by_side(chunks, ellipses_end, most):
    texts, items, rows, raw = chunks
    times = plain_times(raw, 400)
    got = cu.token_pieces(texts, cu.character_stream(texts, items, 400, keys=["chunk"]), most, 2000, 1200, ellipses_end=ellipses_end, keys=["chunk"]).collect()
    want = [(k, *p) for k, text in rows if text is not None and k in times for p in plain_pieces(text, times[k], most, 2000, 1200, ellipses_end)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


def test_tokens_faults_and_fillers_of_units(chunks):
    texts, items, rows, raw = chunks
    times, stream = plain_times(raw, 400), cu.character_stream(texts, items, 400, keys=["chunk"])
    units = [(k, unit, t) for k, text in rows if text is not None and k in times for unit, t in plain_tokens(text, times[k], 30, "、")]
    got = sorted((r.chunk, r.unit, r.i, r.shown, r.start_ms, r.end_ms) for r in cu.timed_tokens(texts, stream, 30, keys=["chunk"]).collect())
    assert got == sorted((k, unit, *x) for k, unit, t in units for x in t)
    got = sorted((r.chunk, r.unit, r.i, r.shown) for r in cu.without_filler_runs(texts, stream, 30, ["chunk"]).collect())
    want = sorted((k, unit, x[0], x[1]) for k, unit, t in units for x, stay in zip(t, filler_runs([y[1] for y in t])) if stay)
    assert got == want and len(want) < sum(len(t) for _, _, t in units)
    want, own = [], {}
    for k, unit, t in units:
        own[k, unit] = t
    for k, text in rows:
        before = None
        for unit, shown in plain_units(text, 30, "、") if text is not None else ():
            t = own.get((k, unit), [])
            if shown:
                a, b = min((x[2] for x in t), default=None), max((x[3] for x in t), default=None)
                why = ["missing_chars"] * (len(t) < len(shown)) + ["zero_span"] * (bool(t) and b - a <= 1) + ["same_start"] * (bool(t) and before is not None and abs(a - before) <= 50)
                want += [(k, unit, ",".join(why))] * bool(why)
                before = before if a is None else a
    assert sorted(map(tuple, sg.unit_faults(texts, items, 400, 30, keys=["chunk"]).collect())) == sorted(want)


def test_times_are_rounded_as_in_spark(spark):
    rnd = random.Random(3)
    x = [k / 2000 for k in range(-50, 50)] + [rnd.uniform(-1e6, 1e6) for _ in range(2000)] + [rnd.randrange(-(10**9), 10**9) / 10_000 for _ in range(2000)] + [1e15 + 0.5, 2.0**52 + 1, 1e-9, -0.0004, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 3)).collect()]
    assert un.thousandths(np.array(x)).tolist() == want


def test_characters_are_not_moved(spark):
    """What is moved of the times grows with the items, not with their characters, and texts are cut where they are worked on."""
    for name in ("g09_budget_pieces", "g10_without_filler_runs", "g11_aligned_cues", "u08_soft_cues", "a09_unit_faults"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "regexp_extract_all" not in plan and "arrays_zip" not in plan, name


def test_items_of_the_least_choice(spark):
    """A chunk with items of the first choice has no others, not even where those have no times."""
    rows = [(1, 0, 0, "一", 0, 100), (1, 1, 0, "二三", 0, 900), (2, 1, 1, "二", 50, 90), (2, 1, 0, "三", 0, 40), (3, 0, 0, "一", None, 5), (3, 1, 0, "二", 5, 9), (4, 0, 0, "、", 0, 5)]
    items = spark.createDataFrame(rows, "chunk int, choice int, pos int, word string, start_ms long, end_ms long")
    got = {r.chunk: (r.ns, r.bases, r.steps) for r in un.item_times(items, 500, ["chunk"]).collect()}
    assert got[1] == ([1], [0.0], [100.0]) and got[2] == ([1, 1], [0.0, 50.0], [40.0, 40.0]) and got[3][0] == got[4][0] == [0]
    texts = spark.createDataFrame([(k, "一。二") for k in (1, 2, 3, 4)], "chunk int, text string")
    for authoritative, want in ((False, [(1, "一。"), (2, "一。"), (2, "二")]), (True, [(1, "一。"), (1, "二"), (2, "一。"), (2, "二")])):
        tokens = cu.timed_tokens(texts, cu.character_stream(texts, items, 500, authoritative, ["chunk"]), 30, keys=["chunk"])
        assert sorted((r.chunk, r.shown) for r in tokens.filter("chunk < 3").collect()) == want
        assert authoritative or not tokens.filter("chunk > 2").count()


def test_replayed_moves_each_table_once(spark):
    """No table is written or looked at on the way, and no join finds out which items count or whose a cue is (before: two jobs, a table of cues, three more joins)."""
    plan = QUERIES["g16_replayed"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" not in plan and "cueline/" not in plan


@pytest.mark.parametrize("size", ["3", "10000"])
def test_close_cues_batch_by_batch(spark, size):
    """Joined cues, held from one batch to the next, against a plain loop."""
    rnd, rows = random.Random(8), []
    for track in (None, "a", "b", "c"):
        at = 0
        for k in range(120):
            at += rnd.choice((0, 40, 60, 60, 100, 300))
            rows.append((track, k, at, at + rnd.choice((30, 50, 400)), rnd.choice(("一", "二三 ", " 四", "五六七。", "", None, "\xa0", "abcd")), rnd.random() < 0.5, rnd.choice((0, 0, 0, 1, None))))
    names = ["track", "pos", "start_ms", "end_ms", "text", "collapsed", "region_ms"]
    want, last = [], None
    for row in sorted(rows, key=lambda r: (r[0] or "", r[2], r[3], r[1])):
        r = dict(zip(names, row)) | {"text": row[4] or ""}
        if last and last["track"] == r["track"] and last["region_ms"] == r["region_ms"] is not None and 0 <= r["start_ms"] - last["end_ms"] < 200 and r["end_ms"] - last["start_ms"] <= 1500:
            a, b = fo.timed(last["text"]), fo.timed(r["text"])
            if len(a) + len(b) <= 30 and not fo.near_duplicates(a, b):
                last |= {"text": last["text"].rstrip() + r["text"].lstrip(), "end_ms": r["end_ms"], "collapsed": last["collapsed"] and r["collapsed"]}
                continue
        want.append(r)
        last = r
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = fo.merge_close_in_regions(spark.createDataFrame(rows, "track string, pos int, start_ms long, end_ms long, text string, collapsed boolean, region_ms long"), 200, 30, 1500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, (r.asDict() for r in got))) == sorted(map(str, want)) and 100 < len(want) < 400


def test_lines_as_words_move_once(spark, tmp_path):
    """Chunks' bounds are found where a track's lines are (before: lines met them by a join); a document without an id counts as in the SQL."""
    plan = QUERIES["w16_item_characters"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    rows = [(k if k < 8 else None, "\n".join(f"a{k} {j}。b" * (j % 3) for j in range(k + 4)), "en", "s", 1) for k in range(1, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["w16_item_characters"](spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql("w16_item_characters", tmp_path, "documents") and any(r[0] is None for r in got)


def bigrams(text):
    c = re.sub("[\x20\x09-\x0d　]+", "", text)
    return {c[k : k + 2] for k in range(len(c) - 1)}


def test_hits_are_settled_in_their_bucket(spark):
    """Segments within a bucket of time, across buckets, with the same number, without cues, without a track or a time, against plain loops."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abc　 d") for _ in range(rnd.choice((1, 4, 9, 30))))
    when = lambda: (lambda a: (a, a + rnd.choice((0, 500, 8000, 700_000))))(rnd.choice((0, 599_000, 1_199_900, rnd.randrange(2_000_000))))
    segments = [(rnd.choice((1, 2, 3, None)), rnd.choice((k, k, k // 2)), *when(), word()) for k in range(150)] + [(1, 900, None, None, "abcd"), (9, 1, 0, 10, "abcd")]
    segments += segments[:3]
    runs = [(rnd.choice(("x", "y", None)), rnd.choice((1, 2, None)), k, *when(), rnd.choice((word(), word(), None))) for k in range(200)] + [("y", 3, 1, 0, 10, "ab"), ("z", 3, 1, 9_000_000, 9_000_010, "ab")]
    s = spark.createDataFrame(segments, "track int, pos int, start_ms long, end_ms long, text string")
    r = spark.createDataFrame(runs, "run string, track int, pos int, start_ms long, end_ms long, text string")
    enough = [x for x in segments if len(re.sub("[\x20\x09-\x0d　]+", "", x[4])) >= 4]

    def share(run, seg):
        near = [(c[3], c[2], c[5]) for x in enough if x[:2] == seg[:2] and x[2] is not None for c in runs if None not in (run, seg[0]) and c[:2] == (run, seg[0]) and c[4] >= x[2] - 500 and c[3] <= x[3] + 500]
        text = " ".join(t for *_, t in sorted(near, key=lambda c: (c[0], c[1], c[2] or "")) if t is not None)
        own = bigrams(seg[4])
        return len(own & bigrams(text)) / len(own)

    want = sorted(((run, *seg[:2], share(run, seg) >= 0.5) for seg in enough for run in {c[0] for c in runs if c[1] == seg[0] and seg[0] is not None}), key=str)
    got = sorted(map(tuple, rn.run_hits(s, r, 500, 0.5, 4).collect()), key=str)
    assert got == want and 20 < sum(x[3] for x in got) < len(got) - 20
    one = [c for c in runs if c[0] == "x"]
    runs = one
    tracks = {}
    for seg in enough:
        tracks.setdefault(seg[0], []).append((seg[1], share("x", seg) >= 0.5))
    want = [(k, len(v), sum(h for _, h in v), min((p for p, h in v if not h), default=None)) for k, v in tracks.items()]
    assert sorted(map(tuple, rn.recall(s, r.filter("run = 'x'"), 500, 0.5, 4).collect()), key=str) == sorted(want, key=str)


def test_hits_meet_texts_once(spark):
    """Segments and cues meet in one join, and no list of cues is moved with a text that is settled (before: a join to find cues, texts moved by number, and a join back)."""
    for name, joins in (("j08_consensus", 2), ("j07_recall", 1)):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"\bJoin ", plan)) <= joins, name
