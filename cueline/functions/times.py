"""Time and number expressions on BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column, n: int = 2) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _part(ms: Column, unit: int, mod: int) -> Column:
    return F.floor(ms / unit) % mod


def parse_srt_time(s: Column) -> Column:
    """``hh:mm:ss,mmm`` to milliseconds; null where it doesn't match."""
    pattern = r"^(\d{2,}):([0-5]\d):([0-5]\d)[,.](\d{3})$"
    g = lambda i: F.regexp_extract(F.trim(s), pattern, i).cast("long")
    return F.when(F.trim(s).rlike(pattern), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def srt_time(ms: Column) -> Column:
    hours = F.floor(ms / 3600000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), _two(_part(ms, 60000, 60)), F.lit(":"), _two(_part(ms, 1000, 60)), F.lit(","), _two(ms % 1000, 3))


def ass_time(ms: Column) -> Column:
    """Centiseconds, half to even, not below 0."""
    cs = F.bround(F.greatest(ms, F.lit(0)) / 10).cast("long")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), _two(_part(cs, 6000, 60)), F.lit(":"), _two(_part(cs, 100, 60)), F.lit("."), _two(cs % 100))


def report_time(ms: Column) -> Column:
    return F.regexp_replace(srt_time(F.greatest(ms, F.lit(0))), ",", ".")


def clamp(x: Column, least, most) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(least))


def display_duration(chars: Column, least: int = 800, most: int = 8000) -> Column:
    """280 ms a character within bounds; nothing to show takes the least."""
    return clamp(chars * 280, least, most)


def padded_end(start: Column, end: Column, next_start: Column, lead_out: int, min_display: int, min_gap: int = 40) -> Column:
    """Later end, short of the next start by a gap, never before the original end."""
    wish = F.greatest(end + lead_out, start + min_display)
    return F.greatest(end, F.coalesce(F.least(wish, next_start - min_gap), wish))


def token_budget(ms: Column, rate: float, floor: int, cap: int) -> Column:
    return F.lit(cap) if rate <= 0 else F.least(F.lit(cap), F.greatest(F.lit(floor), F.ceil(ms / 1000 * rate)))


def fraction_label(hit: Column, total: Column) -> Column:
    return F.when(total == 0, F.concat(F.lit("n/a ("), hit.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise(F.concat(F.format_string("%.1f", 100.0 * hit / total), F.lit("% ("), hit.cast("string"), F.lit("/"), total.cast("string"), F.lit(")")))
