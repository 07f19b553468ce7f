"""Zone shifts and calendar parts of zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(ts: Column, zone: str, source_zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of a timestamp recorded in ``source_zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), ts)


def part(name: str, ts: Column) -> Column:
    """Calendar part (WEEK is the ISO week) as bigint."""
    return F.extract(F.lit(name), ts).cast("bigint")


def as_instant(ts: Column) -> Column:
    """Zone-less UTC time as an instant whatever the session zone; watermarks need the instant type."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def as_utc_wall_time(instant: Column) -> Column:
    """The reverse of :func:`as_instant`."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def posting_time(posted: Column) -> Column:
    """Posting time of a feed record: epoch seconds, or milliseconds where there are 12 digits or more, or an ISO text;
    NULL when it is none of these."""
    digits = F.when(posted.rlike(r"^\d{1,15}$"), posted.cast("bigint"))
    from_epoch = as_utc_wall_time(
        F.when(F.length(posted) <= 11, F.timestamp_seconds(digits)).otherwise(F.timestamp_millis(digits))
    )
    # A text with an offset is an instant; one without is taken as UTC wall time.
    zoned = posted.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    from_zoned = as_utc_wall_time(F.when(zoned, posted).try_cast("timestamp"))
    from_plain = F.when(~zoned & digits.isNull(), posted).try_cast("timestamp_ntz")
    return F.when(digits.isNotNull(), from_epoch).otherwise(F.coalesce(from_zoned, from_plain))
