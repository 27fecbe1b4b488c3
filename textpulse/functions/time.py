"""Column expressions for time: content buckets, day keys, epoch conversion.

Everything is integer arithmetic on epoch values, so results do not depend on the session
time zone. Day keys are UTC calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpulse import fixed

MS_PER_DAY = 86_400_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_ms(seconds: Column | str, width_s: int = fixed.BUCKET_SECONDS) -> Column:
    """``(sec / width) * width * 1000`` with integer division truncating toward zero.

    Spark's ``%`` keeps the dividend's sign like Java, so ``s - s % w`` truncates the same way
    the original's long division does (a floor would differ for negative seconds).
    """
    s = _c(seconds).cast("bigint")
    return (s - s % F.lit(width_s)) * F.lit(1000)


def epoch_seconds(ts_col: str) -> Column:
    """Whole epoch seconds of a TIMESTAMP or TIMESTAMP_NTZ column, independent of session zone."""
    return F.expr(
        f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', to_timestamp_ntz(`{ts_col}`))"
    )


def tick_ms(seconds: Column | str, period_s: int = fixed.SNAPSHOT_PERIOD_SECONDS) -> Column:
    """Start of the snapshot period containing ``seconds``, in ms."""
    s = _c(seconds).cast("bigint")
    return (s - F.pmod(s, F.lit(period_s))) * F.lit(1000)


def day_of_ms(ms: Column | str) -> Column:
    """UTC calendar day ``yyyyMMdd`` of an epoch-ms value."""
    m = _c(ms).cast("bigint")
    days = ((m - F.pmod(m, F.lit(MS_PER_DAY))) / F.lit(MS_PER_DAY)).cast("int")
    return F.date_format(F.date_from_unix_date(days), fixed.DAY_FORMAT)


def previous_day(day: Column | str) -> Column:
    """The ``yyyyMMdd`` day before a ``yyyyMMdd`` day key."""
    d = F.to_date(_c(day), fixed.DAY_FORMAT)
    return F.date_format(F.date_sub(d, 1), fixed.DAY_FORMAT)


def seconds_to_timestamp(seconds: Column | str) -> Column:
    """TIMESTAMP (instant) from epoch seconds; used for event-time windows and watermarks."""
    return F.timestamp_seconds(_c(seconds).cast("bigint"))
