"""Seeded samples and splits that a rerun gives again: windows, anchors, groups that never leak between splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded
from .intervals import outside, range_join

KEYS = ("track",)


def seeded(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def spaced_sample(candidates: DataFrame, count: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``count`` windows (``window``: a number) in turns over the tracks, in seeded order, never two neighbours of one track: ``turn, rank``.

    Within a track windows are taken greedily in seeded order; by sets: only runs of neighbours bear on each other, so each run is
    one small fold."""
    w = Window.partitionBy(*keys).orderBy("window")
    t = candidates.select(*keys, "window").distinct().withColumn("key", seeded(seed, *keys, "window"))
    t = t.withColumn("_new", F.when(F.col("window") - F.lag("window").over(w) == 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        taken: set[int] = set()
        for r in rows:
            if not {r["window"] - 1, r["window"] + 1} & taken:
                taken.add(r["window"])
                yield r

    kept = folded(t.drop("_new"), fold, [*keys, "_run"], order=("key",)).drop("_run")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("key"))
    t = kept.withColumn("turn", turn).orderBy("turn", *keys).limit(count)
    return t.select(*keys, "window", "turn")


def jittered_anchors(tracks: DataFrame, shares: Sequence[float], jitter_ms: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A point at each share of a track's duration, moved by up to ``jitter_ms`` either way by hash and kept within the track."""
    t = tracks.select(*keys, "duration_ms", F.posexplode(F.array(*map(F.lit, shares))).alias("anchor", "_share"))
    part = F.conv(F.substring(seeded(seed, *keys, "anchor"), 1, 8), 16, 10).cast("long") % (2 * jitter_ms + 1) - jitter_ms
    return t.select(*keys, "anchor", F.greatest(F.lit(0).cast("long"), F.least(F.col("duration_ms"), F.floor(F.col("duration_ms") * F.col("_share")) + part)).alias("at_ms"))


def dialogue_windows(cues: DataFrame, tracks: DataFrame, seen: DataFrame, group_ms: int = 1_200_000, guard_ms: int = 120_000, context_ms: int = 15_000, least_cues: int = 2, least_chars: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidate windows of whole dialogue (``group, start_ms, end_ms``): from half a second before a cue over 15 to 35 s, with enough cues of
    enough characters in the first 20 s, inside their group of time less guards, and with context clear of what was seen (widened by a guard)."""
    group = F.floor((F.col("start_ms") - 500) / group_ms)
    t = cues.join(tracks, list(keys)).select(*keys, "pos", group.alias("group"), (F.col("start_ms") - 500).alias("from_ms"), (group * group_ms).alias("_lo"), F.least((group + 1) * group_ms, "duration_ms").alias("_hi"))
    t = t.filter((F.col("from_ms") >= F.col("_lo") + guard_ms) & (F.col("from_ms") < F.col("_hi") - guard_ms - 20_000)).withColumns({"start_ms": F.col("from_ms"), "end_ms": F.col("from_ms") + 20_000})
    active = range_join(t, cues.select(*keys, "start_ms", "end_ms", "text"), keys).groupBy(*keys, "pos", "group", "from_ms", "_hi").agg(F.count_if(F.length("b_text") >= least_chars).alias("_n"), F.max("b_end_ms").alias("_last"))
    end = F.greatest(F.col("from_ms") + 15_000, F.col("_last") + 500)
    good = active.filter(F.col("_n") >= least_cues).select(*keys, "group", F.col("from_ms").alias("start_ms"), end.alias("end_ms"), "_hi").filter((F.col("end_ms") - F.col("start_ms") <= 35_000) & (F.col("end_ms") + context_ms <= F.col("_hi") - guard_ms)).drop("_hi").distinct()
    wide = good.select(*keys, "group", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), (F.col("start_ms") - context_ms).alias("start_ms"), (F.col("end_ms") + context_ms).alias("end_ms"))
    near = seen.select(*keys, F.greatest(F.lit(0), F.col("start_ms") - guard_ms).alias("start_ms"), (F.col("end_ms") + guard_ms).alias("end_ms"))
    return outside(wide, near, keys).select(*keys, "group", F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))


def group_splits(groups: DataFrame, seen: DataFrame, held_out: int, seed: int, group_ms: int = 1_200_000, guard_ms: int = 120_000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each group's split as a whole: of the groups that nothing seen (widened by a guard) touches, the first ``held_out`` of a track in seeded
    order are held out; all others are for development."""
    g = groups.select(*keys, "group").distinct().withColumns({"start_ms": F.col("group") * group_ms, "end_ms": (F.col("group") + 1) * group_ms})
    near = seen.select(*keys, F.greatest(F.lit(0), F.col("start_ms") - guard_ms).alias("start_ms"), (F.col("end_ms") + guard_ms).alias("end_ms"))
    fresh = outside(g, near, keys).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(seeded(seed, *keys, "group"), "group")))
    held = fresh.filter(F.col("_r") <= held_out).select(*keys, "group", F.lit("heldout").alias("_split"))
    return g.join(held, [*keys, "group"], "left").select(*keys, "group", F.coalesce("_split", F.lit("development")).alias("split"))


def separated(windows: DataFrame, apart_ms: int, most: int, order: Sequence[str], keys: Sequence[str] = (*KEYS, "split")) -> DataFrame:
    """Up to ``most`` windows of each key, taken greedily in the given order, each at least ``apart_ms`` from those taken. A fold keeps what it has
    taken, ``most`` windows at most."""

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        taken: list[tuple[int, int]] = []
        for r in rows:
            if len(taken) < most and all(r["end_ms"] + apart_ms <= a or r["start_ms"] - apart_ms >= b for a, b in taken):
                taken.append((r["start_ms"], r["end_ms"]))
                yield r

    return folded(windows, fold, keys, order=order)


def hinted_windows(cues: DataFrame, splits: DataFrame, hints: dict[str, str], context_ms: int = 35_000, focus_ms: int = 40_000, group_ms: int = 1_200_000, guard_ms: int = 120_000, least_context: int = 8, least_focus: int = 3, least_hints: int = 2, least_chars: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Long windows of difficult dialogue in groups that have a split already: enough cues in context and focus, and enough of the hint patterns in
    the focus: ``group, split, start_ms, end_ms, hints`` (their names)."""
    start = F.col("start_ms") - 500
    t = cues.select(*keys, F.floor(start / group_ms).alias("group"), start.alias("from_ms")).distinct().join(splits, [*keys, "group"])
    t = t.filter((F.col("from_ms") - context_ms >= F.col("group") * group_ms + guard_ms) & (F.col("from_ms") + focus_ms + context_ms <= (F.col("group") + 1) * group_ms - guard_ms))
    t = t.withColumns({"start_ms": F.col("from_ms") - context_ms, "end_ms": F.col("from_ms") + focus_ms + context_ms})
    long = F.length("b_text") >= least_chars
    focal = (F.col("b_end_ms") > F.col("from_ms")) & (F.col("b_start_ms") < F.col("from_ms") + focus_ms)
    found = {k: F.bool_or(focal & F.col("b_text").rlike(p)).alias(f"_h_{k}") for k, p in hints.items()}
    g = range_join(t, cues.select(*keys, "start_ms", "end_ms", "text"), keys).groupBy(*keys, "group", "split", "from_ms").agg(F.count_if(long).alias("_c"), F.count_if(long & focal).alias("_f"), *found.values())
    names = F.array_compact(F.array(*[F.when(F.col(f"_h_{k}"), F.lit(k)) for k in hints]))
    return g.filter((F.col("_c") >= least_context) & (F.col("_f") >= least_focus) & (F.size(names) >= least_hints)).select(*keys, "group", "split", F.col("from_ms").alias("start_ms"), (F.col("from_ms") + focus_ms).alias("end_ms"), F.array_join(names, ",").alias("hints"))


def contiguous_windows(cues: DataFrame, chosen: DataFrame, least: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the cues chosen for each key (``id``, ``n``: their order) can be a translation window over cues (``id, pos, focus, eligible``): ``least`` different
    ids, all known, neighbours in order, covering every focus cue, all eligible: ``accepted`` and what fails."""
    at = cues.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    t = chosen.select(*keys, "id", "n").join(at.select(*keys, "id", "_at", "focus", "eligible"), [*keys, "id"], "left").withColumn("_step", F.col("_at") - F.lag("_at").over(Window.partitionBy(*keys).orderBy("n")))
    c = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("id").alias("_d"), F.bool_or(F.col("_at").isNull()).alias("_unknown"), F.coalesce(F.bool_or(F.col("_step") != 1), F.lit(False)).alias("_apart"), F.count_if("focus").alias("_focus"), F.coalesce(F.bool_and("eligible"), F.lit(False)).alias("_eligible"))
    f = cues.groupBy(*keys).agg(F.count_if("focus").alias("_all"), F.count_if(F.col("focus") & ~F.col("eligible")).alias("_odd"))
    t = c.join(f, list(keys))
    kinds = {"uncertain focus": (F.col("_all") == 0) | (F.col("_odd") > 0), "too few": (F.col("_n") < least) | (F.col("_d") < F.col("_n")), "unknown": F.col("_unknown"), "apart": F.col("_apart"), "focus left out": F.col("_focus") < F.col("_all"), "uncertain context": ~F.col("_eligible")}
    failed = F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in kinds.items()]))
    return t.select(*keys, (F.size(failed) == 0).alias("accepted"), F.array_join(failed, ",").alias("failed"))
