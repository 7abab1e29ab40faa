"""Time features of events and cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered time features. Case-level ones are in seconds; calendar ones are scaled to [-0.5, 0.5] on
# their natural range (low, high).
CASE_TIME = ("accumulated_time", "execution_time")
SKIPPED_TIME = "within_day"
CALENDAR = (
    ("month_of_year", 1, 12),
    ("day_of_month", 1, 31),
    ("week_of_year", 1, 53),
    ("day_of_week", 0, 6),
    ("hour_of_day", 0, 23),
    ("min_of_hour", 0, 59),
    ("sec_of_min", 0, 59),
)
TIME_FEATURES = (*CASE_TIME, SKIPPED_TIME, *[name for name, _, _ in CALENDAR])

DAY_US = 86_400_000_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def calendar_part(name: str, ts: Column) -> Column:
    return {
        "month_of_year": F.month,
        "day_of_month": F.dayofmonth,
        "week_of_year": F.weekofyear,
        "day_of_week": F.weekday,
        "hour_of_day": F.hour,
        "min_of_hour": F.minute,
        "sec_of_min": F.second,
    }[name](ts)


def scaled(value: Column, low: int, high: int) -> Column:
    return (value - F.lit(float(low))) / F.lit(float(high - low)) - F.lit(0.5)
