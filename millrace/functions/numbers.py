"""Rounding, ratios, amounts in texts, days and windows, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """To the nearest, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole; 0 if whole is 0."""
    scale = 10**digits
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / whole * (100 * scale) + 0.5) / scale)


def change(now: Column, before: Column) -> Column:
    """Percentage change, one digit; null from nothing to something, 0 from nothing to nothing."""
    grown = F.floor((now - before) / before * 1000 + 0.5) / 10
    return F.when(before > 0, grown).when(now == 0, F.lit(0.0))


def parse_number(text: Column) -> Column:
    """A number with . or , as thousands mark (groups of three) or decimal mark; null if it isn't one."""
    plain = F.regexp_replace(text, r"\s", "")
    grouped = F.rlike(plain, F.lit(r"^\d{1,3}([.,]\d{3})+$"))
    return F.when(grouped, F.regexp_replace(plain, "[.,]", "")).otherwise(F.replace(plain, F.lit(","), F.lit("."))).try_cast("double")


def amounts(text: Column, most: float = 10_000) -> Column:
    """Distinct amounts of euro in a text (before or after the sign or word), ascending."""
    number = r"(\d{1,6}(?:[.,]\d{1,2})?)"
    patterns = [rf"(?i)€\s*{number}", rf"(?i){number}\s*(?:€|euros?\b|eur\b)", rf"(?i)(?:eur|euro)\s*{number}"]
    found = reduce(F.array_union, [F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])
    values = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x > 0) & (x <= most))))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days that have passed from start to end, 0 at least."""
    return F.greatest(F.lit(0), F.floor((F.unix_millis(end) - F.unix_millis(start)) / 86_400_000))


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Half open: start included, end not."""
    return (at >= start) & (at < end)


def covers(start: Column, end: Column, now: Column) -> Column:
    """Whether a validity interval holds now; without an end it goes on."""
    return (start <= now) & (end.isNull() | (end > now))


def overlaps(start: Column, end: Column, begin: Column, horizon: Column) -> Column:
    return (start < horizon) & (end > begin)


def checklist(parts: list[tuple[Column, int]]) -> Column:
    """Sum of the weights of what holds."""
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, w in parts])


def issues(parts: list[tuple[Column, str]]) -> Column:
    """Names of what holds, as an array in this order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in parts]), lambda x: x.isNotNull())


def coordinates_state(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """MISSING, INCOMPLETE, ZERO, OUTSIDE of (south, west, north, east), or OK."""
    south, west, north, east = box
    return (
        F.when(lat.isNull() & lon.isNull(), "MISSING")
        .when(lat.isNull() | lon.isNull(), "INCOMPLETE")
        .when((lat == 0) & (lon == 0), "ZERO")
        .when(lat.between(south, north) & lon.between(west, east), "OK")
        .otherwise("OUTSIDE")
    )


def month_start(at: Column, zone: str = "UTC") -> Column:
    """The first instant of the calendar month, as a zone's clocks have it, that a moment is in."""
    local = F.from_utc_timestamp(at, zone)
    return F.to_utc_timestamp(F.date_trunc("month", local), zone)


def reporting_windows(today: Column, days: int, lag: int) -> Column:
    """A struct of start, end, before_start, before_end: ``days`` whole days up to today less the lag of the data, bounds
    included, and as many before them."""
    end = F.date_sub(today.cast("date"), lag)
    return F.struct(F.date_sub(end, days - 1).alias("start"), end.alias("end"), F.date_sub(end, 2 * days - 1).alias("before_start"), F.date_sub(end, days).alias("before_end"))
