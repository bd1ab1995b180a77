from cueline.functions import text as tx
from cueline.operators import checks as ck
from cueline.operators import signals as sg
from cueline.operators import tracks as tr
from cueline.sources import dumps as du
from cueline.sources import subtitles as sub
from pyspark.sql import functions as F


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_predicates_on_marks_and_sounds(spark):
    assert one(spark, ["はい、はい、はい、はい、はい、はい", "はい・はい～はいーはい、はい", "はいはい", "aaaaa"], tx.looping) == [True, True, False, False]
    assert one(spark, ["ああん…", "あー、ん", "これは普通", "", "abab", "ababab"], tx.noise) == [True, True, False, True, False, True]
    assert one(spark, ["「ありがとう。」", "・ありがとう～ー！", "　。"], tx.phrase_key) == ["「ありがとう。」", "ありがとう", ""]
    assert one(spark, ["あああ", "いい", "はい", "あーっ、ん…", "うちへ"], tx.voiced) == ["啊啊啊", None, None, "啊…、嗯…", None]


def test_cleaning(spark):
    assert one(spark, ["…… 行こう行こう行こう", "……", "そう……だね"], tx.asr_clean) == ["行こう。", "", "そう…だね。"]
    given = ["```text\n译文：你好\n```", "<target>a\n b </target>", "<target>a</target><target>b</target>", "1. one", "[2] x", "说明：y", "plain"]
    assert one(spark, given, tx.answer) == ["你好", "ab", "", "", "", "", "plain"]
    assert one(spark, ["Hello.", "カナ", "ha" * 7, "", "x" * 400], lambda x: tx.latin_safe(F.lit("src"), x)) == [True, False, False, False, False]


def test_splitting(spark):
    assert one(spark, ["今日は。明日は？ ", "あいうえお、かきくけこ、さしすせそ"], lambda x: tx.sentences(x, 8)) == [["今日は。", "明日は？"], ["あいうえお、", "かきくけこ、", "さしすせそ"]]
    long = "あ" * 55 + "、" + "い" * 90 + "。"
    pieces = one(spark, [long, "短い", "、。"], tx.length_pieces)
    assert [len(p) for p in pieces[0]] == [56, 80, 11] and "".join(pieces[0]) == long and pieces[1:] == [["短い"], []]


def test_frames_are_cut_by_length(spark):
    df = spark.createDataFrame([("t", 1, 0, 1450, "…" + "あ" * 55 + "、" + "い" * 90), ("t", 2, 2000, 3000, " …はい "), ("t", 3, 5, 5, "x"), ("t", 4, 4000, 5000, "、。")], "track string, pos int, start_ms long, end_ms long, text string")
    r = sg.frame_cues(df).orderBy("pos", "piece").collect()
    assert [(x.pos, x.start_ms, x.end_ms, len(x.text)) for x in r] == [(1, 0, 550, 56), (1, 550, 1350, 80), (1, 1350, 1450, 10), (2, 2000, 3000, 2)]


def test_review_and_numbered_lines(spark):
    df = spark.createDataFrame([(1, "ああっ", ""), (2, "gogogogo", "去去去去去去去"), (3, "a", "x" * 99), (4, "b", "名前はカナ"), (5, "c", "fine"), (6, "d", None)], "i int, source_text string, text string")
    r = {x.i: (x.issues, x.action, x.output) for x in ck.reviewed(df).collect()}
    assert r[1] == ("empty", "phonetic_fallback", "啊啊") and r[2][1:] == ("retained_source_repetition", "去去去去去去去")
    assert r[3][1] == r[6][1] == "review_placeholder" and r[4][:2] == ("kana_residue", "retained_for_review") and r[5] == ("", "accepted", "fine")
    raws = ["[1] a\n[2] b", "[2] b\n\n[1] a", "[1] a", "[1] a\n[1] b", "[1] a\nno", "[1]\n[2] b", "[0] a\n[1] b"]
    assert one(spark, raws, lambda x: ck.numbered_lines(x, F.lit(2))) == [["a", "b"], ["a", "b"], None, None, None, None, None]


def test_broken_metadata_is_left_out(spark):
    texts = ['{"chunks": [{"start": 10, "speech_regions": [[0, 1.5], [1.0, 2.0], [3], ["x", 4], [5, 5]]}, {"start": "bad", "speech_regions": [[0, 1]]}, 7, {"speech_regions": 3}]}', "nothing", "[1]", None, ""]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, text string")
    assert sorted((r.file, r.start_ms, r.end_ms) for r in du.speech_regions(files).collect()) == [(0, 0, 1000), (0, 10000, 12000)]
    assert du.dump_chunks(files).filter("file > 0").count() == 0


def test_status_of_files(spark):
    good = "1\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:03,000 --> 00:00:04,000\nb"
    texts = [good, good.replace("00:00:03", "00:00:00"), "", None, "x\ny", good + "\n\n2\n00:00:05,000 --> 00:00:06,000\nc"]
    rows = [(f"f{i}", t) for i, t in enumerate(texts)] + [(None, None)]
    cues, status = sub.strict_cues(spark.createDataFrame(rows, "file string, text string"))
    assert {r.file: r.status for r in status.collect()} == {"f0": "valid", "f1": "partial_invalid", "f2": "empty", "f3": "missing", "f4": "invalid", "f5": "partial_invalid", None: "not_provided"}
    assert cues.count() == 6


def test_files_digests_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.SRT").write_text("x")
    (tmp_path / "in/sub/b.srt").write_text("y")
    (tmp_path / "in/c.txt").write_text("z")
    found = du.inventory(spark, f"file://{tmp_path}/in", [".srt"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.SRT", "b.srt"] and "content" not in found.columns
    assert du.file_digests(spark, f"file://{tmp_path}/in").filter("path like '%c.txt'").first().sha256.startswith("594e519ae499312b")
    cues = spark.createDataFrame([("t", i, i * 1000, i * 1000 + 500, f"line {i}") for i in range(30)], "track string, pos int, start_ms long, end_ms long, text string")
    sub.write_rows(sub.srt_rows(cues), f"file://{tmp_path}/out", files=3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/track=t").glob("part-*")))
    back = sub.strict_cues(spark.createDataFrame([("t", text)], "file string, text string"))[0]
    assert [(r.id, r.text) for r in back.orderBy("block").collect()] == [(str(i + 1), f"line {i}") for i in range(30)]
    for label in ("a", "b"):
        du.append_metrics(spark.createDataFrame([(1,)], "n int"), f"file://{tmp_path}/metrics", label)
    assert spark.read.json(f"file://{tmp_path}/metrics").count() == 2


def test_missing_times_are_filled_in(spark):
    df = spark.createDataFrame([("ab、cd", [("a", 0.0, 10.0), ("d", 40.0, 50.0)]), ("xyz", [("q", 0.0, 30.0)]), ("ab", []), (None, []), ("zab", [("a", 10.0, 20.0), ("b", 20.0, 30.0)])], "t string, a array<struct<ch:string,start_ms:double,end_ms:double>>")
    r = [x.y for x in df.select(sg.source_times("t", "a").alias("y")).collect()]
    assert [tuple(x) for x in r[0]] == [("a", 0, 10), ("b", 10, 25), ("c", 25, 40), ("d", 40, 50)]
    assert [tuple(x) for x in r[1]] == [("x", 0, 10), ("y", 10, 20), ("z", 20, 30)] and [tuple(x) for x in r[2]] == [("a", 0, 0), ("b", 0, 0)] and r[3] is None
    assert tuple(r[4][0]) == ("z", 10, 10)


def test_units_of_collapsed_alignments(spark):
    texts = spark.createDataFrame([("t", 0, "ab。cd。ef。gh。")], "track string, chunk int, text string")
    items = spark.createDataFrame([("t", 0, 0, "ab", 0, 400), ("t", 0, 1, "cd", 420, 420), ("t", 0, 2, "ef", 430, 900)], "track string, chunk int, pos int, word string, start_ms long, end_ms long")
    r = {x.unit: x.reasons for x in sg.unit_faults(texts, items).collect()}
    assert r == {1: "zero_span", 2: "same_start", 3: "missing_chars"}


def test_segments_with_and_without_a_cap(spark):
    prob = [0.9, 0.9, 0.1, 0.9, 0.1, 0.1, 0.1, 0.4, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9]
    df = spark.createDataFrame([("t", i, p) for i, p in enumerate(prob)], "track string, frame int, prob double")
    got = lambda t: sorted((r.start, r.end, r.reason) for r in t.collect())
    assert got(sg.speech_segments(df, 0.5, 2, 2, 0)) == got(sg.capped_segments(df, 99, 0.5, 2, 2)) == [(0, 4, "silence"), (8, 16, "series_end")]
    assert got(sg.capped_segments(df, 3, 0.5, 2, 2)) == [(0, 3, "forced_max_speech"), (8, 11, "forced_max_speech"), (13, 16, "series_end")]


def test_event_logs_are_read_back(spark):
    given = ['{"schema_version": 1, "timestamp": "2024-01-02T03:04:05.000006+00:00", "event": "stage", "stage": "asr", "n": 3}', "nothing", None, '{"event": "x"}', '{"schema_version": 2, "timestamp": "2024-01-02T03:04:05+00:00", "event": "y"}', "[1]"]
    df = spark.createDataFrame([(v,) for v in given], "value string")
    got = du.event_rows(df).select(F.unix_micros("at").alias("us"), "event", "fields", "fault").collect()
    assert [r.fault for r in got] == [None, "invalid JSON", "invalid JSON", "no event", "schema", "invalid JSON"]
    assert (got[0].us, got[0].event, got[0].fields) == (1704164645000006, "stage", {"stage": "asr", "n": "3"})
    events = spark.createDataFrame([("a", 1704164645000006, None), ("b", 5, "z")], "name string, us long, job string")
    back = du.event_rows(du.event_lines(events, F.col("name"), F.timestamp_micros("us"), "job"))
    assert sorted((r.event, r.us, r.fields.get("job"), r.fault) for r in back.select("*", F.unix_micros("at").alias("us")).collect()) == [("a", 1704164645000006, None, None), ("b", 5, "z", None)]


def test_a_large_glossary_finds_what_a_small_one_does(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cat and then"), (2, None), (3, "an"), (4, "x" * 9), (5, "a")], "i int, text string")
    terms = spark.createDataFrame([("the", "A"), ("then", "B"), ("an", "C"), ("a", "D"), ("xyz", "E")], "source string, target string")
    found = lambda: sorted((r.i, r.source, r.target) for r in tr.matched_terms(df, terms, ["i"]).collect())
    small = found()
    monkeypatch.setattr(tr, "SMALL_GLOSSARY", 0)
    assert found() == small == [(1, "an", "C"), (1, "then", "B"), (3, "an", "C"), (5, "a", "D")]
