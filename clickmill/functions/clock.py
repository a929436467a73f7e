"""Calendar and time arithmetic on epoch seconds; none of it depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, fractions dropped."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * DAY
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.floor(F.second(ts)).cast("bigint")
    )


def whole_div(value: Column, divisor: int) -> Column:
    """Truncating integer division that keeps BIGINT."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(whole_div(seconds, 3600), F.lit(24)).cast("int")


def minute_of_hour(seconds: Column) -> Column:
    return F.pmod(whole_div(seconds, 60), F.lit(60)).cast("int")


def second_of_minute(seconds: Column) -> Column:
    return F.pmod(seconds, F.lit(60)).cast("int")


def zero_minute(seconds: Column) -> Column:
    return minute_of_hour(seconds) == 0


def day_of_month(seconds: Column) -> Column:
    return F.dayofmonth(F.date_from_unix_date(whole_div(seconds, DAY).cast("int")))


def nanos_to_seconds(nanos: Column) -> Column:
    """Truncating division of a nanosecond difference."""
    return whole_div(nanos, 1_000_000_000)
