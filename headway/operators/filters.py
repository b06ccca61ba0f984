"""Report filters over prediction_accuracy (parameters -> predicates).

Parameters are request values (strings); they are resolved on the driver
into literal predicates so Catalyst can push them into the Parquet scan
(``service_date`` and ``week_start`` prune partitions).  A bad parameter
yields an empty frame plus a message, like the report does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.constants import MAX_DAILY_RANGE_DAYS, expand_stop_groups, routes_for_mode
from headway.functions.times import parse_iso_date


class FilterError(ValueError):
    pass


def route_ids_for(route_ids, mode) -> list[str] | None:
    """CSV route list intersected with the mode's routes; None = no filter."""
    sets = []
    if isinstance(route_ids, str) and route_ids != "":
        sets.append(set(route_ids.split(",")))
    if isinstance(mode, str) and mode != "":
        sets.append(set(routes_for_mode(mode)))
    if not sets:
        return None
    out = sets[0]
    for s in sets[1:]:
        out = out & s
    return sorted(out)


def filter_by_route(df: DataFrame, route_ids, mode) -> DataFrame:
    ids = route_ids_for(route_ids, mode)
    if ids is None:
        return df
    return df.filter(F.col("route_id").isin(ids)) if ids else df.filter(F.lit(False))


def filter_by_stop(df: DataFrame, stop_ids) -> DataFrame:
    if not stop_ids:
        return df
    return df.filter(F.col("stop_id").isin(expand_stop_groups(list(stop_ids))))


def filter_by_direction(df: DataFrame, direction_id) -> DataFrame:
    if direction_id in ("0", "1"):
        return df.filter(F.col("direction_id") == int(direction_id))
    return df


def filter_by_bin(df: DataFrame, bins) -> DataFrame:
    if bins == "All" or not isinstance(bins, str) or bins == "":
        return df
    return df.filter(F.col("bin").isin(bins.split(",")))


def filter_by_kind(df: DataFrame, kinds) -> DataFrame:
    """SQL IN: never matches a null kind."""
    if not kinds:
        return df
    return df.filter(F.col("kind").isin([k for k in kinds if k is not None]))


def filter_by_in_next_two(df: DataFrame, value) -> DataFrame:
    if value == "true":
        return df.filter(F.col("in_next_two"))
    if value == "false":
        return df.filter(~F.col("in_next_two"))
    return df


def timeframe_bounds(chart_range, service_date, date_start, date_end) -> tuple[_dt.date, _dt.date]:
    """Validated inclusive date range of a request, or FilterError."""
    if chart_range in ("Daily", "By Station") and isinstance(date_start, str) and isinstance(date_end, str):
        d1, d2 = parse_iso_date(date_start), parse_iso_date(date_end)
        if d1 is None or d2 is None:
            raise FilterError("Can't parse start or end date.")
        n = (d2 - d1).days
        if n < 0:
            raise FilterError("Start date is after end date")
        if n > MAX_DAILY_RANGE_DAYS:
            raise FilterError("Dates can't be more than 5 weeks apart")
        return d1, d2
    if chart_range == "Hourly" and isinstance(service_date, str):
        d = parse_iso_date(service_date)
        if d is None:
            raise FilterError("Can't parse service date.")
        return d, d
    if chart_range == "Hourly":
        raise FilterError("No service date given.")
    if chart_range in ("Daily", "By Station"):
        raise FilterError("No start or end date given.")
    raise FilterError(f"Unknown chart range {chart_range!r}")


def filter_by_timeframe(df: DataFrame, chart_range, service_date, date_start, date_end) -> DataFrame:
    d1, d2 = timeframe_bounds(chart_range, service_date, date_start, date_end)
    pred = (F.col("service_date") >= F.lit(d1)) & (F.col("service_date") <= F.lit(d2))
    if "week_start" in df.columns:
        # the partition column is derived, so state its bound explicitly
        lo = d1 - _dt.timedelta(days=d1.weekday())
        pred = pred & (F.col("week_start") >= F.lit(lo)) & (F.col("week_start") <= F.lit(d2))
    return df.filter(pred)


def filter_accuracy(df: DataFrame, params: dict) -> tuple[DataFrame, str | None]:
    """All report filters in order; the first error wins and empties the frame."""
    try:
        q = filter_by_route(df, params.get("route_ids"), params.get("mode"))
        q = filter_by_stop(q, params.get("stop_ids"))
        q = filter_by_direction(q, params.get("direction_id"))
        q = filter_by_bin(q, params.get("bin"))
        q = filter_by_kind(q, params.get("kinds"))
        q = filter_by_in_next_two(q, params.get("in_next_two"))
        q = filter_by_timeframe(
            q, params.get("chart_range"), params.get("service_date"), params.get("date_start"), params.get("date_end")
        )
        return q, None
    except FilterError as e:
        return df.filter(F.lit(False)), str(e)
