"""Parts of the day, week and year of epoch seconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def second_of_day(t: Column) -> Column:
    return F.pmod(t, F.lit(DAY))


def day(t: Column) -> Column:
    """Days since 1970."""
    return F.floor(t / DAY).cast("long")


def day_part(t: Column) -> Column:
    """0 morning [6, 12), 1 afternoon [12, 18), 2 evening [18, 22), 3 night."""
    h = second_of_day(t) / 3600
    return F.when((h >= 6) & (h < 12), 0).when((h >= 12) & (h < 18), 1).when((h >= 18) & (h < 22), 2).otherwise(3)


def slot(t: Column) -> Column:
    """'06-09', '09-18', '18-21' or '21-06'; a slot begins just after its hour and ends with it."""
    s = second_of_day(t)
    inside = lambda a, b: (s > a * 3600) & (s <= b * 3600)
    return F.when(inside(6, 9), "06-09").when(inside(9, 18), "09-18").when(inside(18, 21), "18-21").otherwise("21-06")


def day_night(t: Column) -> Column:
    """'day' in (8, 19] o'clock, else 'night'."""
    s = second_of_day(t)
    return F.when((s > 8 * 3600) & (s <= 19 * 3600), "day").otherwise("night")


def weekend(t: Column) -> Column:
    """Saturday or Sunday; 1970-01-01 was a Thursday."""
    return F.pmod(day(t) + 3, F.lit(7)) >= 5


def month(t: Column) -> Column:
    """First day of the month as yyyy-MM."""
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM")


def seconds_of(text: Column) -> Column:
    """Seconds of 'H:M:S' or 'N day(s), H:M:S'."""
    days = F.coalesce(F.regexp_extract(text, r"(\d+) day", 1).try_cast("long"), F.lit(0))
    hms = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+)", i).try_cast("long")
    return days * DAY + hms(1) * 3600 + hms(2) * 60 + hms(3)


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Seconds that [a, b) and [c, d) share."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def two_month_windows(t: Column) -> Column:
    """Labels of the two-month windows of a time: (m-1, m) and (m, m+1) within its year."""
    m = F.month(F.timestamp_seconds(t))
    label = lambda x: F.concat(F.lpad((x).cast("string"), 2, "0"), F.lit("-"), F.lpad((x + 1).cast("string"), 2, "0"))
    return F.filter(F.array(F.when(m > 1, label(m - 1)), F.when(m < 12, label(m))), lambda x: x.isNotNull())
