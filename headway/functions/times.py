"""Time helpers on epoch-second columns.

Times are stored as epoch seconds (LongType).  Local wall-clock values are
computed with ``convert_timezone`` on ``timestamp_ntz`` values so that no
result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import datetime as _dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.functions.constants import BLOCK_S, TIMEZONE

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_to_epoch(ts: Column | str) -> Column:
    """Whole seconds since the epoch of a ``timestamp_ntz`` read as UTC wall time."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), _col(ts))


def epoch_to_utc_ntz(x: Column | str) -> Column:
    return F.timestamp_add("SECOND", _col(x), F.expr(_EPOCH_NTZ))


def local_wall_clock(x: Column | str, tz: str = TIMEZONE) -> Column:
    """Epoch seconds -> ``timestamp_ntz`` holding the wall clock in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), epoch_to_utc_ntz(x))


def service_hour(x: Column | str) -> Column:
    """Hour of the service day, 3..26: hours 0-2 belong to the previous date."""
    h = F.hour(local_wall_clock(x))
    return F.when(h < 3, h + 24).otherwise(h).cast("int")


def service_date(x: Column | str) -> Column:
    """The service date rolls over at 03:00 local time."""
    local = local_wall_clock(x)
    d = F.to_date(local)
    return F.when(F.hour(local) < 3, F.date_sub(d, 1)).otherwise(d)


def minute_of_hour(x: Column | str) -> Column:
    """Local minute rounded down to the 5-minute block."""
    return ((F.minute(local_wall_clock(x)) / 5).cast("int") * 5).cast("int")


def block_start(x: Column | str) -> Column:
    """Start of the 5-minute block holding ``x`` (the zone's offsets are whole hours)."""
    c = _col(x)
    return c - F.pmod(c, F.lit(BLOCK_S))


def with_service_date_info(df, x: str, prefix: str = ""):
    """Add service_date, hour_of_day, minute_of_hour, block_start, block_end."""
    return (
        df.withColumn(prefix + "service_date", service_date(x))
        .withColumn(prefix + "hour_of_day", service_hour(x))
        .withColumn(prefix + "minute_of_hour", minute_of_hour(x))
        .withColumn(prefix + "block_start", block_start(x))
        .withColumn(prefix + "block_end", block_start(x) + BLOCK_S)
    )


def week_start(d: Column | str) -> Column:
    """Monday of the week holding date ``d``."""
    return F.trunc(_col(d), "week")


def week_label(d: Column | str) -> Column:
    return F.concat(F.lit("week_of_"), F.date_format(week_start(d), "yyyy_MM_dd"))


def format_unix(x: Column | str, tz: str = TIMEZONE) -> Column:
    """``YYYY-MM-DD HH:MM:SS EDT``; ``N/A`` for null.  The zone abbreviation is
    derived from the UTC offset, so the session time zone is irrelevant."""
    c = _col(x)
    local = local_wall_clock(c, tz)
    offset_h = F.timestamp_diff("HOUR", epoch_to_utc_ntz(c), local)
    abbrev = F.when(offset_h == -4, F.lit("EDT")).when(offset_h == -5, F.lit("EST")).otherwise(
        F.format_string("UTC%+d", offset_h)
    )
    return F.when(c.isNull(), F.lit("N/A")).otherwise(
        F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), abbrev)
    )


def iso8601_to_epoch(s: Column | str) -> Column:
    """ISO-8601 with offset (``2019-03-28T13:57:57-04:00``) -> epoch seconds; null if it is not a time."""
    return F.unix_seconds(F.try_to_timestamp(_col(s)))


def rfc1123_to_epoch(s: Column | str) -> Column:
    """HTTP date (``Tue, 30 Oct 2018 17:33:15 GMT``) -> epoch seconds, as UTC; null if it is not a date."""
    body = F.regexp_replace(F.regexp_replace(_col(s), r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", "")
    return F.unix_seconds(F.try_to_timestamp(F.concat(body, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss xx")))


# ---- driver-side helpers (parameters, not data) ----------------------------


def service_day_window(date: _dt.date, tz: str = TIMEZONE) -> tuple[int, int]:
    """Departure service day: 04:00 local on ``date`` to 02:00 local next day,
    inclusive, as epoch seconds.  A non-existent 02:00 resolves forward."""
    z = ZoneInfo(tz)
    start = _dt.datetime.combine(date, _dt.time(4, 0), z)
    # fold=0 on a non-existent 02:00 takes the pre-transition offset, i.e. 03:00 EDT
    end = _dt.datetime.combine(date + _dt.timedelta(days=1), _dt.time(2, 0), z)
    return int(start.timestamp()), int(end.timestamp())


def parse_iso_date(s) -> _dt.date | None:
    """A date in the extended form ``YYYY-MM-DD`` only; anything else is None."""
    if not isinstance(s, str) or len(s) != 10:
        return None
    try:
        return _dt.datetime.strptime(s, "%Y-%m-%d").date()
    except ValueError:
        return None
