"""Operators on several runs over the same tracks: windows, recall, consensus, as-of lookups, differences, samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import pair_share
from ..functions.text import compact
from .intervals import range_join, same_keys
from .tracks import blocks, matched_terms

TRACK = ("track",)


def window_texts(segments: DataFrame, cues: DataFrame, pad_ms: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per segment (keys, pos) the texts, in order and joined by a blank, of the cues that touch it widened by ``pad_ms``.

    Touching counts. Segments without a cue have no row."""
    a = segments.select(*keys, "pos", (F.col("start_ms") - pad_ms).alias("start_ms"), (F.col("end_ms") + pad_ms + 1).alias("end_ms"))
    b = cues.select(*keys, "pos", "start_ms", (F.col("end_ms") + 1).alias("end_ms"), "text")
    found = range_join(a, b, keys).groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct("b_start_ms", "b_pos", "b_text"))).alias("all"))
    return found.select(*keys, "pos", F.array_join(F.col("all.b_text"), " ").alias("window_text"))


def _shares(segments: DataFrame, runs: DataFrame, of: DataFrame | None, pad_ms: int, least_chars: int, keys: Sequence[str], width: int = 600_000) -> DataFrame:
    """``run`` (of ``of``, the runs of each track as a list, else one), keys, ``pos``, ``share``: of the character pairs of a segment of enough characters, how many the cues of the run around it
    have (``window_texts``).

    Segments and cues meet once, in buckets of time, and what lies in one bucket is settled there. Only segments in several buckets, and those that share their ``pos`` (their cues count for
    each of them), are moved on with their texts.
    """
    place = Window.partitionBy(*keys, "pos")
    s = segments.filter(F.length(compact(F.col("text"))) >= F.lit(max(2, least_chars)))
    s = s.select(*keys, "pos", "text", (F.col("start_ms") - pad_ms).alias("_from"), (F.col("end_ms") + pad_ms + 1).alias("_to"), F.row_number().over(place.orderBy("start_ms", "end_ms", "text")).alias("_k"), F.count(F.lit(1)).over(place).alias("_same"))
    slot = lambda c: F.floor(c / width)
    end = lambda a, b: F.greatest(F.col(b), F.col(a) + 1) - 1
    a = s.withColumn("_whole", F.coalesce((F.col("_same") == 1) & (slot(F.col("_from")) == slot(end("_from", "_to"))), F.lit(False)))
    a = a.select("*", F.explode_outer(F.sequence(slot(F.col("_from")), slot(end("_from", "_to")))).alias("_bucket"))
    b = runs.select(F.col("run").alias("_run"), *[F.col(k).alias(f"_b_{k}") for k in keys], F.col("pos").alias("_b_pos"), F.col("text").alias("_b_text"), F.col("start_ms").alias("_b_from"), (F.col("end_ms") + 1).alias("_b_to"))
    b = b.select("*", F.explode(F.sequence(slot(F.col("_b_from")), slot(end("_b_from", "_b_to")))).alias("_b_bucket"))
    on = reduce(lambda c, k: c & (a[k] == b[f"_b_{k}"]), keys, (a["_bucket"] == b["_b_bucket"]) & (F.col("_from") < F.col("_b_to")) & (F.col("_b_from") < F.col("_to")))
    t = a.join(b, on & (F.col("_bucket") == slot(F.greatest("_from", "_b_from"))), "left")
    cue = F.when(F.col("_b_bucket").isNotNull() & F.col("_run").isNotNull(), F.struct("_b_from", "_b_pos", "_b_text"))
    t = t.groupBy(*keys, "_bucket", "pos", "_k", "_run").agg(F.first("text").alias("text"), F.first("_whole").alias("_whole"), F.collect_list(cue).alias("_cues"))
    words = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["_b_text"]), " ")
    there, whole = F.size("_cues") > 0, F.col("_whole")
    share = pair_share(F.when(whole & there, F.col("text")), F.when(whole & there, words(F.col("_cues"))))
    t = t.select(*keys, "pos", F.when(whole & there, F.struct(F.col("_run").alias("run"), share.alias("share"))).alias("_s"), F.when(~whole, F.struct("_k", "text")).alias("_t"), F.when(~whole & there, F.struct(F.col("_run").alias("run"), F.col("_cues").alias("cues"))).alias("_p"))
    t = t.groupBy(*keys, "pos").agg(F.collect_list("_s").alias("_s"), F.collect_set("_t").alias("_t"), F.collect_list("_p").alias("_p"))
    t = t.withColumn("_runs", F.array(F.struct(F.lit("").alias("run")))) if of is None else t.join(of, list(keys))
    t = t.select(*keys, "pos", "_s", "_t", "_p", F.explode("_runs.run").alias("run"))
    own = lambda c: F.filter(c, lambda x: x["run"] == F.col("run"))
    t = t.select("run", *keys, "pos", F.get(own("_s"), F.lit(0))["share"].alias("_share"), F.flatten(own("_p")["cues"]).alias("_cues"), F.explode_outer("_t").alias("_t"))
    late = pair_share(F.col("_t.text"), F.when(F.col("_t").isNotNull(), words(F.col("_cues"))))
    return t.select("run", *keys, "pos", F.when(F.col("_t").isNull(), F.coalesce("_share", F.lit(0.0))).otherwise(late).alias("share"))


def recall(segments: DataFrame, cues: DataFrame, pad_ms: int, threshold: float, least_chars: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per track: segments of enough characters, those hit (the cues around them share enough of their character pairs), and the first one missed."""
    t = _shares(segments, cues.withColumn("run", F.lit("")), None, pad_ms, least_chars, keys).withColumn("hit", F.col("share") >= threshold)
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.count_if("hit").alias("hits"), F.min(F.when(~F.col("hit"), F.col("pos"))).alias("first_missed"))


def run_hits(segments: DataFrame, runs: DataFrame, pad_ms: int, threshold: float, least_chars: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Segments of enough characters and whether the cues around them share enough of their character pairs: ``run``, keys, ``pos``, ``hit``, for every run of ``runs`` (cues with a
    column ``run``) that has the segment's track."""
    of = runs.select("run", *keys).distinct().groupBy(*keys).agg(F.collect_list(F.struct("run")).alias("_runs"))
    return _shares(segments, runs, of, pad_ms, least_chars, keys).select("run", *keys, "pos", (F.col("share") >= threshold).alias("hit"))


def consensus(segments: DataFrame, runs: DataFrame, pad_ms: int, threshold: float, least_chars: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per segment: how many runs confirm it, and whether any does."""
    t = run_hits(segments, runs, pad_ms, threshold, least_chars, keys)
    return t.groupBy(*keys, "pos").agg(F.count_if("hit").alias("runs"), F.bool_or("hit").alias("confirmed"))


def run_scores(segments: DataFrame, runs: DataFrame, pad_ms: int, threshold: float, least_chars: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per run: segments, hits, recall to three places, and the health of its times."""
    t = run_hits(segments, runs, pad_ms, threshold, least_chars, keys).groupBy("run").agg(F.count(F.lit(1)).alias("segments"), F.count_if("hit").alias("hits"))
    before = F.lag("end_ms").over(Window.partitionBy("run", *keys).orderBy("start_ms", "end_ms", "pos"))
    span = F.col("end_ms") - F.col("start_ms")
    health = runs.withColumn("_before", before).groupBy("run").agg(F.count(F.lit(1)).alias("cues"), F.count_if(span < 400).alias("too_short"), F.count_if(span > 8000).alias("too_long"), F.count_if(F.col("start_ms") < F.col("_before")).alias("overlapping"))
    return t.join(health, "run").withColumn("recall", F.round(F.col("hits") / F.col("segments"), 3))


def anchors(tracks: DataFrame, shares: Sequence[float], keys: Sequence[str] = TRACK) -> DataFrame:
    """A point at each share of a track's duration."""
    at = F.posexplode(F.array(*[F.floor(F.col("duration_ms") * F.lit(x)).cast("long") for x in shares])).alias("anchor", "at_ms")
    return tracks.select(*keys, at)


def nearest(points: DataFrame, cues: DataFrame, most_ms: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Points (keys, anchor, at_ms) with the cue that starts nearest, the earlier of two, if within ``most_ms``.

    One sort of points and cues together; the cue before and the cue after come from the same window partition."""
    cue = cues.select(*keys, F.lit(None).cast("int").alias("anchor"), F.col("start_ms").alias("at_ms"), F.struct("start_ms", "pos").alias("cue"))
    both = cue.unionByName(points.select(*keys, "anchor", "at_ms", F.lit(None).cast(cue.schema["cue"].dataType).alias("cue")))
    w = Window.partitionBy(*keys).orderBy("at_ms", F.col("anchor").asc_nulls_first())
    t = both.withColumns({"_b": F.last("cue", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first("cue", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("anchor is not null")
    before, after = F.col("at_ms") - F.col("_b.start_ms"), F.col("_a.start_ms") - F.col("at_ms")
    t = t.withColumn("cue", F.when(F.col("_a").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a")))
    return t.filter(F.abs(F.col("cue.start_ms") - F.col("at_ms")) <= most_ms).select(*keys, "anchor", "at_ms", "cue.pos", "cue.start_ms")


def timeline_to_real(points: DataFrame, regions: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Points (``at_ms`` on the regions laid end to end) with their real time; beyond the last region, its end."""
    w = Window.partitionBy(*keys).orderBy("start_ms")
    span = F.col("end_ms") - F.col("start_ms")
    cum = regions.filter(span > 0).withColumn("_to", F.sum(span).over(w)).select(*keys, F.col("start_ms").alias("real_ms"), (F.col("_to") - span).alias("start_ms"), F.col("_to").alias("end_ms"))
    ends = regions.groupBy(*keys).agg(F.max("end_ms").alias("_last"))
    look = points.withColumns({"start_ms": F.greatest("at_ms", F.lit(1)) - 1, "end_ms": F.greatest("at_ms", F.lit(1))})
    hit = range_join(look, cum, keys).withColumn("real_ms", F.col("b_real_ms") + F.col("at_ms") - F.col("b_start_ms")).select(*points.columns, "real_ms")
    late = look.join(cum.groupBy(*keys).agg(F.max("end_ms").alias("_total")), list(keys)).filter("end_ms > _total").join(ends, list(keys)).select(*points.columns, F.col("_last").alias("real_ms"))
    return hit.union(late)


def first_region(cues: DataFrame, regions: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Cues with the first region (start) that holds their middle, its right edge included; null for orphans."""
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    points = cues.select(*keys, "pos", middle.alias("start_ms"), (middle + 1).alias("end_ms"))
    hit = range_join(points, regions.select(*keys, "start_ms", (F.col("end_ms") + 1).alias("end_ms")), keys).groupBy(*keys, "pos").agg(F.min("b_start_ms").alias("region_ms"))
    return cues.select(*keys, "pos").join(hit, [*keys, "pos"], "left")


def table_differences(lock: DataFrame, got: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Ids missing, unknown, repeated or with other fields (named in ``fields``)."""
    side = lambda t: t.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in fields])
    a, b = side(lock).alias("a"), side(got).alias("b")
    t = a.join(b, list(ids), "full")
    other = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    kind = F.when(F.col("b._n").isNull(), F.lit("missing")).when(F.col("a._n").isNull(), F.lit("unknown")).when(F.greatest("a._n", "b._n") > 1, F.lit("repeated")).when(F.size(other) > 0, F.lit("differs"))
    return t.select(*ids, kind.alias("kind"), F.when(kind == "differs", F.array_join(other, ",")).otherwise(F.lit("")).alias("fields")).filter("kind is not null")


def computed_once(df: DataFrame, key: str, order: Sequence[str], compute: Callable[[Column], Column]) -> DataFrame:
    """Adds ``result`` and ``sent``: each distinct value is computed once, for its first row, and joined back.

    The distinct values are counted on the map side first, so a value that holds a third of the rows is no hot task."""
    once = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).withColumn("result", compute(F.col(key)))
    t = df.join(once, df[key].eqNullSafe(once[key])).drop(once[key])
    return t.withColumn("sent", F.struct(*order) == F.col("_first")).drop("_first")


def merged_sources(df: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """Per key: rows, whether all rows agree in ``fields``, and the last row's order value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct(F.struct(*fields)) == 1).alias("consistent"), F.max(order).alias("last"))


def neighbour_filter(df: DataFrame, near_ms: int = 5000, keys: Sequence[str] = TRACK) -> DataFrame:
    """Rows that stay when ``hard`` ones go, and ``risky`` ones beside a hard one no further than ``near_ms``."""
    w = Window.partitionBy(*keys).orderBy("pos")

    def near(step) -> Column:
        hard, start, end = (step(c).over(w) for c in ("hard", "start_ms", "end_ms"))
        return F.coalesce(hard & ((F.abs(start - F.col("end_ms")) <= near_ms) | (F.abs(F.col("start_ms") - end) <= near_ms)), F.lit(False))

    return df.withColumn("_n", near(F.lag) | near(F.lead)).filter(~(F.col("hard") | (F.col("risky") & F.col("_n")))).drop("_n")


def filler_drop(df: DataFrame, fillers: Sequence[str], replies: Sequence[str], silence_ms: int, run_min: int = 3, run_gap_ms: int = 5000, lag_ms: int = 3000, keys: Sequence[str] = TRACK) -> DataFrame:
    """Rows that stay of a table with a column ``core``: islands of fillers go if silence lies on both sides or they are
    ``run_min`` long; a reply soon after a real word stays and ends an island.

    Where a cue is part of a longer frame, columns ``source_start_ms``, ``source_end_ms`` and ``source_core`` (null: the cue itself) may say so: silences are
    then measured between frames, and a filler inside a frame of more than a filler stays."""
    names = df.columns
    of = lambda c: F.coalesce(f"source_{c}", c) if f"source_{c}" in names else F.col(c)
    df = df.withColumns({"_a": of("start_ms"), "_b": of("end_ms"), "_whole": of("core")})
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "pos")
    reply, filler = F.col("core").isin(*replies), F.col("core").isin(*fillers, *replies)
    word_end = F.last(F.when(~filler, F.col("_b")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = df.withColumn("_f", filler & F.col("_whole").isin(*fillers, *replies) & ~F.coalesce(reply & (F.col("_a") - word_end <= lag_ms), F.lit(False)))
    gap = F.col("_a") - F.lag("_b").over(w)
    t = t.withColumns({"_lead": gap, "_trail": F.lead("_a").over(w) - F.col("_b"), "_new": F.when(F.col("_f") & F.coalesce(F.lag("_f").over(w) & (gap <= run_gap_ms), F.lit(False)), 0).otherwise(1)})
    t = t.withColumn("_island", F.sum("_new").over(w))
    island = Window.partitionBy(*keys, "_island").orderBy("start_ms", "end_ms", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walled = (F.coalesce(F.first("_lead").over(island), F.lit(silence_ms)) >= silence_ms) & (F.coalesce(F.last("_trail").over(island), F.lit(silence_ms)) >= silence_ms)
    t = t.withColumn("_gone", F.col("_f") & ((F.lit(silence_ms > 0) & walled) | (F.lit(run_min > 0) & (F.count(F.lit(1)).over(island) >= run_min))))
    return t.filter(~F.col("_gone")).select(*names)


def concatenated(df: DataFrame, length: Column, pause_ms: int = 4000, keys: Sequence[str] = TRACK) -> DataFrame:
    """Adds ``offset_ms``: where each clip starts when a track's clips are laid end to end with pauses."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset_ms", F.coalesce(F.sum(length + pause_ms).over(w), F.lit(0)))


def block_terms(df: DataFrame, terms: DataFrame, most: int, reset_ms: int) -> DataFrame:
    """Per block of a track: the matched terms in the order of their first cue."""
    at = blocks(df, most, reset_ms).select("track", "pos", "session", "block")
    hit = matched_terms(df, terms, ["track", "pos"]).join(at, ["track", "pos"]).groupBy("track", "session", "block", "source").agg(F.min("pos").alias("first"))
    return hit.groupBy("track", "session", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]), "|").alias("terms"))


def tumbling(df: DataFrame, width_ms: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Windows of fixed width that hold a cue's start, the last one clipped to the track's end."""
    t = df.groupBy(*keys, F.floor(F.col("start_ms") / width_ms).alias("window")).agg(F.count(F.lit(1)).alias("cues"), F.sum(F.length("text")).alias("chars"))
    ends = df.groupBy(*keys).agg(F.max("end_ms").alias("_end"))
    return t.join(ends, list(keys)).select(*keys, "window", "cues", "chars", (F.col("window") * width_ms).alias("start_ms"), F.least((F.col("window") + 1) * width_ms, "_end").alias("end_ms"))


def blind_sides(items: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """A seeded order of each group's items, and which run stands on the left."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")))
    return items.select(group, item, F.row_number().over(Window.partitionBy(group).orderBy(h, item)).alias("rank"), F.when(F.substr(h, F.lit(1), F.lit(1)).isin(*"01234567"), F.lit("ab")).otherwise(F.lit("ba")).alias("sides"))


def split_conflicts(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).filter("splits > 1")


def batch_budgets(df: DataFrame, batch: str, budget: Column) -> DataFrame:
    """Largest budget of each batch; batches of different budgets should be regrouped."""
    return df.groupBy(batch).agg(F.max(budget).alias("budget"), F.count_distinct(budget).alias("budgets")).withColumn("regroup", F.col("budgets") > 1)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns, sorted by name; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def review_acceptance(cues: DataFrame, decisions: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: cues, cues decided once, undecided, decided more than once, eligible; accepted if all are eligible."""
    d = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_and("eligible").alias("eligible"))
    t = cues.select(key, group).join(d, key, "left")
    good = F.coalesce((F.col("_n") == 1) & F.col("eligible"), F.lit(False))
    return t.groupBy(group).agg(F.count(F.lit(1)).alias("cues"), F.count_if(F.col("_n") == 1).alias("reviewed"), F.count_if(F.col("_n").isNull()).alias("undecided"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(good).alias("eligible"), F.bool_and(good).alias("accepted"))


def record_pivot(sources: DataFrame, records: DataFrame, names: Sequence[str], keys: Sequence[str] = TRACK, absent: str = "[uncovered]", deleted: str = "[deleted]") -> DataFrame:
    """One row a source id (``sources``: keys, ``id``) with what each run's records (``run, number, ids, text``) say of it, in the order of ``number``: a record of several ids
    is marked with them, one without text as deleted, an id that no record of the run has as uncovered. Null keys and ids are equal to null ones."""
    ids = F.transform("ids", lambda i: i.cast("string"))
    cell = F.concat(F.when(F.size("ids") > 1, F.concat(F.lit("[merged "), F.array_join(ids, ","), F.lit("] "))).otherwise(F.lit("")), F.coalesce("text", F.lit(deleted)))
    each = records.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "run", "number", F.explode("ids").alias("_r_id"), cell.alias("cell"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "cell"))), lambda x: x["cell"]), " | ")  # of one id
    wide = each.groupBy(*[f"_r_{k}" for k in keys], "_r_id").pivot("run", list(names)).agg(told)
    t = sources.join(wide, same_keys(sources, wide, [*keys, "id"], "_r_"), "left")
    return t.select(*sources.columns, *[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(absent)).otherwise(F.col(n)).alias(n) for n in names])


def run_pivot(runs: DataFrame, names: Sequence[str], keys: Sequence[str] = ("track", "pos"), absent: str = "[uncovered]") -> DataFrame:
    """One row a source with the text of each run; what a run doesn't cover is marked."""
    t = runs.groupBy(*keys).pivot("run", list(names)).agg(F.max("text"))
    return t.select(*keys, *[F.coalesce(n, F.lit(absent)).alias(n) for n in names])
