from cueline.operators import runs as rn

CUE = "track string, pos int, start_ms long, end_ms long, text string"


def test_window_texts_count_touching_cues(spark):
    seg = spark.createDataFrame([("t", 1, 1000, 2000, "x")], CUE)
    cues = spark.createDataFrame([("t", 1, 0, 500, "a"), ("t", 2, 2500, 3000, "b"), ("t", 3, 2501, 3000, "c"), ("u", 1, 1000, 2000, "d")], CUE)
    assert [r.window_text for r in rn.window_texts(seg, cues, 500).collect()] == ["a b"]


def test_nearest_takes_the_earlier_of_two_within_reach(spark):
    cues = spark.createDataFrame([("t", 1, 0, 5, "a"), ("t", 2, 100, 105, "b")], CUE)
    points = spark.createDataFrame([("t", 0, 50), ("t", 1, 80), ("t", 2, 900), ("u", 0, 1)], "track string, anchor int, at_ms long")
    got = {(r.track, r.anchor): r.pos for r in rn.nearest(points, cues, 200).collect()}
    assert got == {("t", 0): 1, ("t", 1): 2}


def test_timeline_skips_silence_and_ends_at_the_last_region(spark):
    regions = spark.createDataFrame([("t", 1000, 2000), ("t", 5000, 6000)], "track string, start_ms long, end_ms long")
    points = spark.createDataFrame([("t", x) for x in (0, 500, 1000, 1001, 2000, 9000)], "track string, at_ms long")
    got = {r.at_ms: r.real_ms for r in rn.timeline_to_real(points, regions).collect()}
    assert got == {0: 1000, 500: 1500, 1000: 2000, 1001: 5001, 2000: 6000, 9000: 6000}


def test_fillers(spark):
    rows = [("w", 0, 1000), ("s", 2000, 2100), ("f", 3000, 3100), ("f", 4000, 4100), ("w", 5000, 6000), ("f", 20000, 20100), ("w", 60000, 61000), ("f", 61500, 61600), ("f", 62000, 62100), ("f", 62500, 62600), ("w", 63000, 64000)]
    df = spark.createDataFrame([("t", i, a, b, c) for i, (c, a, b) in enumerate(rows)], "track string, pos int, start_ms long, end_ms long, core string")
    got = sorted(r.pos for r in rn.filler_drop(df, ["f"], ["s"], 8000).collect())
    assert got == [0, 1, 2, 3, 4, 6, 10]  # the answer and the two beside speech stay; the lone one and the chain of three go


def test_neighbour_filter(spark):
    df = spark.createDataFrame([("t", 1, 0, 1000, True, False), ("t", 2, 2000, 3000, False, True), ("t", 3, 20000, 21000, False, True), ("t", 4, 22000, 23000, False, False)], "track string, pos int, start_ms long, end_ms long, hard boolean, risky boolean")
    assert sorted(r.pos for r in rn.neighbour_filter(df).collect()) == [3, 4]


def test_table_differences_name_the_fields(spark):
    lock = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", None), (5, "e", 1)], "id int, x string, y int")
    got = spark.createDataFrame([(1, "a", 1), (3, "c", 2), (4, "d", 1), (5, "e", 1), (5, "e", 1)], "id int, x string, y int")
    t = {r.id: (r.kind, r.fields) for r in rn.table_differences(lock, got, ["id"], ["x", "y"]).collect()}
    assert t == {2: ("missing", ""), 3: ("differs", "y"), 4: ("unknown", ""), 5: ("repeated", "")}
