"""Time. Operators hold instants as microseconds since the epoch (long), null for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import DAY, UNKNOWN


def parse_utc(text: Column) -> Column:
    """Timestamp of an ISO text: with Z or an offset it is converted, without it is UTC; null if it can't be parsed."""
    return F.try_to_timestamp(text)


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def iso(micros_: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros_), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def date_of(micros_: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros_), "yyyy-MM-dd")


def days_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(DAY))


def age_days(query_time: Column, observed: Column) -> Column:
    """Days since observation. A document from after the query is an error, not a negative age."""
    age = days_between(query_time, observed)
    return F.when(age < 0, F.raise_error(F.lit("visibility violation: observed after the query")).cast("double")).otherwise(age)


def year_text(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}"), F.left(text, F.lit(4))).otherwise(F.lit(UNKNOWN))


def offset_after(event: Column, end: Column, window_end: Column, days: int = 30, fraction: float = 0.5, least_s: int = 2) -> Column:
    """(at, reason): an instant after the event, at most ``fraction`` into what remains of the new interval."""
    left = F.least(F.coalesce(end, window_end), window_end) - event
    step = F.least(F.lit(days * DAY), F.floor(left * F.lit(fraction)).cast("long"))
    short = left < F.lit(least_s * 1_000_000)
    return F.struct(F.when(~short, event + step).alias("at"), F.when(short, F.lit("NEW_INTERVAL_TOO_SHORT")).alias("reason"))


def offset_before(event: Column, start: Column, window_start: Column, days: int = 30, fraction: float = 0.5, least_s: int = 2) -> Column:
    """(at, reason): the mirror image, before the event and within the old interval."""
    left = event - F.greatest(F.coalesce(start, window_start), window_start)
    step = F.least(F.lit(days * DAY), F.floor(left * F.lit(fraction)).cast("long"))
    short = left < F.lit(least_s * 1_000_000)
    return F.struct(F.when(~short, event - step).alias("at"), F.when(short, F.lit("OLD_INTERVAL_TOO_SHORT")).alias("reason"))


def retime(start: Column, end: Column, window_end: Column, days: Column) -> Column:
    """(at, reason): ``days`` after the start, unless the interval or the window has ended by then."""
    at = start + days * F.lit(DAY)
    reason = F.when(at >= end, F.lit("CURRENT_INTERVAL_ENDS_BEFORE_OFFSET")).when(at > window_end, F.lit("BEYOND_OBSERVATION_WINDOW"))
    return F.struct(F.when(reason.isNull(), at).alias("at"), reason.alias("reason"))


def date_windows(start: Column, end: Column, days: int = 120) -> Column:
    """Array of contiguous (first, last) dates of at most ``days`` days, both inclusive."""
    firsts = F.sequence(start, end, F.expr(f"interval {days} days"))
    return F.transform(firsts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))
