"""Date and time fields by their frame-library names, as Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F


def date(t):
    return F.to_date(t)


def time(t):
    return F.date_format(t, "HH:mm:ss")


def year(t):
    return F.year(t)


def month(t):
    return F.month(t)


def day(t):
    return F.dayofmonth(t)


def hour(t):
    return F.hour(t)


def minute(t):
    return F.minute(t)


def second(t):
    return F.second(t)


def microsecond(t):
    return F.unix_micros(t) % 1000000


def week(t):
    return F.weekofyear(t)


weekofyear = week


def dayofweek(t):
    """Monday is 0."""
    return F.weekday(t)


weekday = day_of_week = dayofweek


def dayofyear(t):
    return F.dayofyear(t)


day_of_year = dayofyear


def quarter(t):
    return F.quarter(t)


def is_month_start(t):
    return F.dayofmonth(t) == 1


def is_month_end(t):
    return F.to_date(t) == F.last_day(t)


def is_quarter_start(t):
    return is_month_start(t) & (F.month(t) % 3 == 1)


def is_quarter_end(t):
    return is_month_end(t) & (F.month(t) % 3 == 0)


def is_year_start(t):
    return F.dayofyear(t) == 1


def is_year_end(t):
    return is_month_end(t) & (F.month(t) == 12)


def is_leap_year(t):
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(t):
    return F.dayofmonth(F.last_day(t))


daysinmonth = days_in_month


def isocalendar(t):
    """(year, week, day) of the ISO calendar."""
    return F.struct(F.extract(F.lit("YEAROFWEEK"), t).alias("year"), F.weekofyear(t).alias("week"), (F.weekday(t) + 1).alias("day"))


def normalize(t):
    return F.date_trunc("day", t)


def strftime(t, pattern: str):
    """A Java date pattern."""
    return F.date_format(t, pattern)


def floor(t, unit: str):
    return F.date_trunc(unit, t)


def ceil(t, unit: str):
    low = F.date_trunc(unit, t)
    return F.when(low == t, t).otherwise(low + F.expr(f"interval 1 {unit}"))


def round_(t, unit: str):
    """To the nearest unit; ties go to the even one."""
    low = F.date_trunc(unit, t)
    high = low + F.expr(f"interval 1 {unit}")
    left, right = F.unix_micros(t) - F.unix_micros(low), F.unix_micros(high) - F.unix_micros(t)
    even = (F.floor(F.unix_micros(low) / (left + right)) % 2) == 0
    return F.when((left < right) | ((left == right) & even), low).otherwise(high)


def month_name(t):
    return F.date_format(t, "MMMM")


def day_name(t):
    return F.date_format(t, "EEEE")


def tz_localize(t, zone: str):
    """Wall-clock times of a zone as instants in UTC."""
    return F.to_utc_timestamp(t, zone)


def tz_convert(t, zone: str):
    """Instants in UTC as wall-clock times of a zone."""
    return F.from_utc_timestamp(t, zone)


def to_period(t, unit: str):
    return F.date_trunc(unit, t)


start_time = to_period


def end_time(t, unit: str):
    return F.date_trunc(unit, t) + F.expr(f"interval 1 {unit}") - F.expr("interval 1 microsecond")


def total_seconds(delta_micros):
    return delta_micros / 1e6


def days(delta_micros):
    return F.floor(delta_micros / 86_400_000_000)


def seconds(delta_micros):
    return F.floor((delta_micros - days(delta_micros) * 86_400_000_000) / 1_000_000)


def microseconds(delta_micros):
    return F.pmod(delta_micros, F.lit(1_000_000))
