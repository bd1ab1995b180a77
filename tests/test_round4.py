"""Results and bounds that the review of round 3 asked for."""

from math import comb, exp, lgamma, log
from pathlib import Path

import pandas as pd
from cueline.functions.fragments import filler_runs
from cueline.llm import exact, near
from cueline.operators import tracks as tr
from cueline.plans.cues import QUERIES as CUES
from cueline.plans.texts import QUERIES
from cueline.streaming.sessions import _latest
from pyspark.sql import functions as F


def test_sign_test_of_many_votes(spark):
    """A step a vote: the square of them would not end here."""
    long = lambda n: F.lit(n).cast("long")
    pairs = [(20, 5), (0, 7), (7, 0), (0, 0), (30, 30), (1, 900)]
    for w, l in pairs:
        want = min(1.0, 2 * sum(comb(w + l, i) for i in range(min(w, l) + 1)) / 2 ** (w + l)) if w + l else 1.0
        assert abs(spark.range(1).select(tr.sign_test(long(w), long(l))).first()[0] - want) < 1e-12
    n, k = 400_000, 199_500
    term = total = 1.0  # the same sum relative to its largest term, going down
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
    want = 2 * total * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2))
    assert abs(spark.range(1).select(tr.sign_test(long(n - k), long(k))).first()[0] - want) < 1e-7


class State:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def test_stage_status_of_a_group_in_several_parts():
    """Arrow batches cut a group anywhere; what comes late in the same batch counts."""
    rows = [(10, "started", None), (20, "progress", "[s] 1/8 done"), (30, "started", None), (40, "progress", "[s] 5/8 done"), (40, "completed", None), (50, "progress", None)]
    for order in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [3, 5, 0, 2, 1, 4]):
        for size in (1, 2, 6):
            part = lambda k: pd.DataFrame([rows[i] for i in order[k : k + size]], columns=["at_ms", "status", "line"])
            state = State()
            got = next(_latest((1, "a"), iter([part(k) for k in range(0, 6, size)]), state)).iloc[0].tolist()
            assert got == [1, "a", "progress", 30, 50, 20, 0.625]
            again = next(_latest((1, "a"), iter([pd.DataFrame([(45, "started", None), (60, "completed", None)], columns=["at_ms", "status", "line"])]), state)).iloc[0].tolist()
            assert again == [1, "a", "completed", 30, 60, 30, 0.625]  # the late start undoes nothing


def test_strict_srt_numbers_cues_with_a_span(spark, tmp_path):
    """Cues without a span are not written, so they take no number."""
    spark.sql("select id event_id, timestamp_micros(1704067200000000 + id * 1000000) ts, 1L user_id, 'view' event_type, if(id = 2, 0.0D, 1.5D) value, 'x' props from range(5)").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.id, r.start_ms) for r in QUERIES["io01_strict_srt"][0](spark, str(tmp_path)).collect()) == [(1, 0), (2, 1000), (3, 3000), (4, 4000)]


def test_characters_are_no_rows(spark):
    """Rows are lines and words on the way to cues; characters stay in lists (before: each was a row of several shuffles)."""
    for name, most in (("g11_aligned_cues", 3), ("u08_soft_cues", 3), ("a09_unit_faults", 3), ("g09_budget_pieces", 4), ("g10_without_filler_runs", 4)):
        plan = CUES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") <= most, name


def test_fillers_of_plain_texts():
    assert filler_runs(["a", "b, ", "c"]) == [True] * 3 and filler_runs(["は、"] * 3) == [True, False, False]


def test_deduplication_leaves_no_tables_of_texts(spark):
    """What nothing reads any more is deleted: cut texts, sets of shingles, signatures."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "cueline"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for stage in (exact.kept_documents, near.kept_documents):
        before = set(folder.glob("*"))
        kept = stage(docs)
        columns = {c for f in set(folder.glob("*")) - before for c in spark.read.parquet(f"file://{f}").columns}
        assert columns and not columns & {"chunks", "shingles", "bands", "sketch"} and 0 < kept.count() < docs.count()
