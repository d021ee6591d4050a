"""Dates, deadlines and periods. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import PRESENT

# Texts that users see.
NO_DEADLINE, OPEN, EXPIRED, EXPIRES_SOON = "Không thời hạn", "Đang tuyển", "Hết hạn", "Sắp hết hạn"
JUST_NOW = "Vừa xong"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SOON_DAYS = 3
DAY = 86_400


def date_label(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit(NO_DEADLINE))


def job_state(deadline: Column, as_of: Column) -> Column:
    """By the deadline: a job stays open on its day (the server's rule, which wins over the client's)."""
    left = F.datediff(deadline, as_of)
    return F.when(deadline.isNull(), F.lit(OPEN)).when(left < 0, F.lit(EXPIRED)).when(left <= SOON_DAYS, F.lit(EXPIRES_SOON)).otherwise(F.lit(OPEN))


def elapsed_label(past: Column, now: Column) -> Column:
    """Minutes, hours, days or weeks since a moment, or its date from four weeks on."""
    s = F.unix_timestamp(now) - F.unix_timestamp(past)
    label = F.when(past.isNull() | (s < 60), F.lit(JUST_NOW))
    for until, unit, name in ((3600, 60, "phút"), (DAY, 3600, "giờ"), (7 * DAY, DAY, "ngày"), (28 * DAY, 7 * DAY, "tuần")):
        label = label.when(s < until, F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name} trước")))
    return label.otherwise(F.date_format(past, "d/M/yyyy"))


def month_name(number: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, MONTHS)), number)


def month_number(name: Column) -> Column:
    """1 to 12; 0 for no such name."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), name)


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_and_year(text: Column) -> Column:
    """The month's name and the year of a date; null for one that is none, or goes on."""
    d = F.try_to_timestamp(F.when(text != PRESENT, text), F.lit("yyyy-MM-dd"))
    return F.when(d.isNotNull(), F.struct(month_name(F.month(d)).alias("month"), F.year(d).alias("year")))


def end_label(d: Column) -> Column:
    return F.coalesce(d.cast("string"), F.lit(PRESENT))


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month as two digits each."""
    return F.transform(F.sequence(F.lit(1), F.day(F.last_day(first_of_month(year, month)))), lambda d: F.lpad(d.cast("string"), 2, "0"))


def recent_from(choice: str | None, as_of: Column) -> Column | None:
    """From when on: a week or a month before a day; no other choice limits anything. A month before the 31st is the last
    day of a shorter month."""
    return {"week": F.date_sub(as_of, 7), "month": F.add_months(as_of, -1)}.get(choice or "")


def month_label(d: Column) -> Column:
    """T with two digits."""
    return F.concat(F.lit("T"), F.date_format(d, "MM"))


def period_label(period: str, number: Column) -> Column:
    """2024; Quý 1; T1."""
    text = number.cast("string")
    return {"year": text, "quarter": F.concat(F.lit("Quý "), text), "month": F.concat(F.lit("T"), text)}[period]


def plus_seconds(at: Column, seconds: int) -> Column:
    return at + F.make_dt_interval(secs=F.lit(seconds))


def in_year(at: Column, year: int) -> Column:
    """A half-open range, which reaches the scan; year(at) = x would not."""
    return (at >= F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")) & (at < F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz"))


def in_month(at: Column, year: int, month: int) -> Column:
    after = (year + month // 12, month % 12 + 1)
    return (at >= F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp_ntz")) & (at < F.lit(f"{after[0]:04d}-{after[1]:02d}-01").cast("timestamp_ntz"))
