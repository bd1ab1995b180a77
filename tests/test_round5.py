"""Results and bounds that the review's second look at round 3 asked for."""

import difflib
import random
import time

from cueline.functions import normal as nm
from cueline.functions import text as tx
from cueline.llm import mixing, quality
from pyspark.sql import functions as F


def _texts(rnd, most):
    kind = rnd.choice(["ab", "abc ", "abcdefghij é日", "a"])
    a = "".join(rnd.choice(kind) for _ in range(rnd.randrange(most)))
    b = "".join("" if rnd.random() < 0.1 else c + rnd.choice(kind) * (rnd.random() < 0.1) for c in a)
    return a, rnd.choice([b, b[len(b) // 3 :] + a[:9], "".join(rnd.sample(b, len(b)))])


def test_longest_matches_of_long_texts():
    """As difflib has them (first in a, then in b); a row of the table a character would not end here."""
    rnd = random.Random(5)
    for _ in range(600):
        a, b = _texts(rnd, 120)
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert nm.longest_match(a, b) == (tuple(m.find_longest_match()) if m.find_longest_match().size else (0, 0, 0))
        assert nm.ratio(a, b) == m.ratio()
        n = m.find_longest_match().size
        assert nm.echoed(a, b) == (n >= 6 and 10 * n >= 7 * len(a))
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    a = " ".join(rnd.choice(words) for _ in range(12_000))
    b = a[:20_000] + "#" + a[20_001:40_000] + a[40_100:]
    began = time.time()
    assert nm.longest_match(a, b)[2] == len(a) - 40_100 and not nm.echoed(a, b) and nm.echoed(a[:20_000], b)
    assert nm.ratio(a, b) == 2 * (len(b) - 1) / (len(a) + len(b))
    assert time.time() - began < 5


def test_folded_repeats_side_by_side():
    """The texts of a batch at once, each as on its own; 20 looks at each character would not end here."""
    rnd = random.Random(6)
    unit = lambda k: "".join(rnd.choice("abc") for _ in range(k))
    texts = ["", "a", "aaaa", "aaaa"] + ["".join(unit(rnd.choice([1, 2, 3, 20, 21])) * rnd.randrange(1, 9) for _ in range(4)) for _ in range(800)]
    for times, keep, longest in ((4, 2, 20), (2, 1, 5), (3, 3, 7)):
        assert nm.all_folded_repeats(texts, times, keep, longest) == [nm.folded_repeats(t, times, keep, longest) for t in texts]
    many = [unit(900) + "la " * 50 for _ in range(2000)]
    began = time.time()
    assert all(t.endswith("la la ") for t in nm.all_folded_repeats(many))
    assert time.time() - began < 4


def test_edit_counts_of_many_and_long_texts():
    """As a plain table of costs has them; a row of the whole table a character would not end here."""
    rnd = random.Random(7)
    pairs = [_texts(rnd, 40) for _ in range(300)] + [("", ""), ("", "ab"), ("ab", ""), ("abc", "xyz"), ("kitten", "sitting")]
    for (a, b), got in zip(pairs, nm.all_edit_counts(*zip(*pairs))):
        row = [(j, j, 0) for j in range(len(b) + 1)]  # edits, insertions and deletions, deletions
        for i, x in enumerate(a, 1):
            new = [(i, i, i)]
            for j, y in enumerate(b, 1):
                (p, q, d), (e, f, g), (h, k, n) = row[j - 1], row[j], new[-1]
                new.append(min((p + (x != y), q, d), (e + 1, f + 1, g + 1), (h + 1, k + 1, n)))
            row = new
        e, both, d = row[-1]
        assert got == (e - both, both - d, d)
    a = "".join(rnd.choice("abcdefghij ") for _ in range(60_000))
    began = time.time()
    assert nm.edit_counts(a, a.replace("a", "")) == (0, 0, a.count("a"))
    assert nm.edit_counts(a, a.replace("e", "#")) == (a.count("e"), 0, 0)
    b = a[:100] + "##" + a[102:30_000] + "#" + a[30_000:50_000] + a[50_001:]
    assert sum(nm.edit_counts(a, b)) == 4
    assert time.time() - began < 20


def test_shares_of_pairs_side_by_side(spark):
    """As the expressions have them; null and blank texts, wide characters, copies."""
    rnd = random.Random(8)
    rows = [(None, "ab"), ("ab", None), ("", ""), ("a", "a"), (" \t\u3000", "ab"), ("a b", "ab"), ("\U0001F600\U0001F601x", "\U0001F601x"), ("\U0010FFFF\U0010FFFF", "\U0010FFFF\U0010FFFF\U0010FFFF"), *[(_texts(rnd, 60)) for _ in range(200)]]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    want = tx.set_overlap(tx.bigrams(F.coalesce("a", F.lit(""))), tx.bigrams(F.coalesce("b", F.lit(""))))
    assert all(r.got == r.want for r in df.select(nm.pair_share("a", "b").alias("got"), want.alias("want")).collect())
    many = [" ".join(rnd.choice(["lorem", "ipsum", "日本", "\t"]) for _ in range(400)) for _ in range(2000)]
    began = time.time()
    assert set(nm.all_shares(many, many)) == {1.0} and set(nm.all_shares(many, [""] * len(many))) == {0.0}
    assert time.time() - began < 5


def test_classes_of_marks(spark):
    """Letters and digits told apart first change no class: every mark, its neighbours, letters and digits, inside and outside."""
    signs = sorted({chr(ord(c) + k) for c in tx.UNTIMED + tx.SOUNDS for k in (-1, 0, 1)} | set(map(chr, range(1, 256))))
    df = spark.createDataFrame([(c,) for c in signs], "c string")
    for marks in (tx.UNTIMED, "".join(c for c in tx.UNTIMED if c not in "、，, "), ".!?", "、", "abcdefgh.、"):
        got = df.select("c", F.col("c").rlike(f"(?s)^{tx._class(marks)}$").alias("in"), F.col("c").rlike(f"(?s)^{tx._class(marks, True)}$").alias("out")).collect()
        assert all(r["in"] == (r.c in marks) != r["out"] for r in got)


def test_verdicts_and_mixes_meet_texts_by_shuffles(spark):
    """A join that has to shuffle the texts of many rows does so for few, so that what it writes grows with the input."""
    docs = spark.createDataFrame([(k, "some words of a text " * k, "en", "s") for k in range(40)], "doc_id long, text string, lang string, source string")
    for out in (quality.kept_documents(docs), mixing.mixed_documents(docs)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
