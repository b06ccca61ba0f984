"""Unpredicted departures and unrealised predictions.

* unpredicted: a terminal departure no prediction announced in time (no
  prediction linked to the event, made strictly before the departure,
  with a departure time);
* missed (unrealised): terminal departure predictions whose trip never got
  an event.

The service builds each report for one (date, environment) with correlated
``NOT EXISTS`` subqueries.  Here a report covers every service day and
environment at once (``date=None``) or one of each; the existence test is a
left join against the distinct event keys that have a qualifying
prediction.  Departure service days run 04:00 to 02:00 next day, local,
inclusive.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import pct_of, route_rank
from headway.functions.constants import TERMINALS, TIMEZONE
from headway.functions.times import epoch_to_utc_ntz, format_unix, service_day_window
from headway.operators.events import EVENT_KEY

MATCH_KEY = ["ev_environment", "ev_vehicle_id", "ev_stop_id", "ev_arrival_snapshot"]


def departure_service_day(x: Column | str) -> Column:
    """Service day of a departure instant: 04:00 local of D to 02:00 local of
    D+1 inclusive is day D; instants after 02:00 and before 04:00 have none.

    One zone conversion: the wall clock of the second before, counted from
    04:00 (a second early, so that the instant 02:00 of a night without that
    hour, which shows 03:00, still counts)."""
    c = F.col(x) if isinstance(x, str) else x
    # the UTC fields of this timestamp are the local ones: no part of it depends on the session time zone
    wall = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(c - 1), TIMEZONE))
    since = wall + (1 - 4 * 3600)
    day = F.date_from_unix_date(F.floor(since / 86400).cast("int"))
    return F.when(F.pmod(since, F.lit(86400)) <= 22 * 3600, day)


def _day_filter(df: DataFrame, time_col: str, date: _dt.date | None, env: str | None) -> DataFrame:
    if env is not None:
        df = df.filter(F.col("environment") == env)
    if date is not None:
        lo, hi = service_day_window(date)
        df = df.filter((F.col(time_col) >= lo) & (F.col(time_col) <= hi)).withColumn("service_day", F.lit(date))
        if time_col == "file_timestamp" and "file_date" in df.columns:
            # stored predictions are partitioned by UTC file date: prune to the window's dates
            d0 = _dt.datetime.fromtimestamp(lo, _dt.timezone.utc).date()
            d1 = _dt.datetime.fromtimestamp(hi, _dt.timezone.utc).date()
            df = df.filter(F.col("file_date").between(F.lit(d0), F.lit(d1)))
    else:
        df = df.withColumn("service_day", departure_service_day(time_col)).filter(F.col("service_day").isNotNull())
    return df


def eligible_departures(events: DataFrame, date=None, env=None, terminals_only: bool = True) -> DataFrame:
    ev = events.filter(
        F.col("trip_id").isNotNull() & F.col("departure_time").isNotNull() & (F.col("is_deleted") == F.lit(False))
    )
    if terminals_only:
        ev = ev.filter(F.col("stop_id").isin(TERMINALS))
    return _day_filter(ev, "departure_time", date, env)


def flag_predicted(departures: DataFrame, matched_predictions: DataFrame) -> DataFrame:
    """Add ``predicted``: some prediction linked to the event was made before
    the departure and carries a departure time (any environment)."""
    p = matched_predictions.filter(
        F.col("departure_time").isNotNull() & F.col("ev_arrival_snapshot").isNotNull()
    ).select(*[F.col(m).alias(k) for m, k in zip(MATCH_KEY, EVENT_KEY)], F.col("file_timestamp"))
    # the earliest such prediction decides, so events are read and joined once
    first = p.groupBy(*EVENT_KEY).agg(F.min("file_timestamp").alias("_first"))
    return (
        departures.join(first, EVENT_KEY, "left")
        .withColumn("predicted", F.coalesce(F.col("_first") < F.col("departure_time"), F.lit(False)))
        .drop("_first")
    )


def _unpredicted_counts(df: DataFrame, keys: list) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("departures"),
        F.count(F.when(~F.col("predicted"), 1)).alias("unpredicted"),
    ).withColumn("pct_unpredicted", pct_of("unpredicted", "departures"))


def unpredicted_summary(events, matched_predictions, date=None, env=None) -> DataFrame:
    """Per route: terminal departures, unpredicted ones, percentage; in subway
    display order (unknown routes rank with Red)."""
    f = flag_predicted(eligible_departures(events, date, env), matched_predictions)
    s = _unpredicted_counts(f, ["environment", "service_day", "route_id"])
    return s.orderBy("environment", "service_day", route_rank("route_id"), "route_id")


def with_stop_description(df: DataFrame, stops: DataFrame, stop_col: str = "stop_id", dim_key: Column | None = None) -> DataFrame:
    """Stop description: the stop id when the id is unknown, else the (possibly
    null) description.  ``stops`` is a small dimension (one row per stop)."""
    k = dim_key if dim_key is not None else F.col(stop_col)
    dim = stops.select(F.col("id").alias("_dim_id"), F.col("description").alias("_desc"))
    j = df.withColumn("_key", k).join(dim, F.col("_key") == F.col("_dim_id"), "left")
    return j.withColumn(
        "stop_name", F.when(F.col("_dim_id").isNull(), F.col(stop_col)).otherwise(F.col("_desc"))
    ).drop("_key", "_dim_id", "_desc")


def unpredicted_by_stop(events, matched_predictions, stops, route_id: str | None = None, date=None, env=None, dim_key=None) -> DataFrame:
    ev = eligible_departures(events, date, env)
    if route_id is not None:
        ev = ev.filter(F.col("route_id") == route_id)
    s = _unpredicted_counts(flag_predicted(ev, matched_predictions), ["environment", "service_day", "route_id", "stop_id"])
    return with_stop_description(s, stops, dim_key=dim_key).orderBy("environment", "service_day", "route_id", "stop_id")


def unpredicted_detail(events, matched_predictions, route_id=None, stop_id=None, date=None, env=None) -> DataFrame:
    """Unpredicted departures of one route at one stop (any stop, no terminal
    restriction), with the departure formatted in local time."""
    ev = eligible_departures(events, date, env, terminals_only=False)
    if route_id is not None:
        ev = ev.filter(F.col("route_id") == route_id)
    if stop_id is not None:
        ev = ev.filter(F.col("stop_id") == stop_id)
    f = flag_predicted(ev, matched_predictions).filter(~F.col("predicted"))
    return f.select(
        "environment", "service_day", "route_id", "stop_id", "vehicle_id", "trip_id", "departure_time",
        format_unix("departure_time").alias("departure"),
    ).orderBy("environment", "service_day", "route_id", "stop_id", "departure_time")


def totals(summary: DataFrame, base: str, missed: str, keys: list[str]) -> DataFrame:
    """Grand total of a summary: sums of the per-row counts (so distinct
    counts are summed, not re-distincted), pct 0.0 when the base is 0."""
    return summary.groupBy(*keys).agg(
        F.sum(base).cast("long").alias("total_" + base),
        F.sum(missed).cast("long").alias("total_" + missed),
    ).withColumn(
        "total_pct",
        F.when(F.col("total_" + base) > 0, F.col("total_" + missed) * 100.0 / F.col("total_" + base)).otherwise(F.lit(0.0)),
    )


# ---- unrealised predictions ---------------------------------------------------------


def eligible_departure_predictions(matched_predictions: DataFrame, date=None, env=None, terminals_only=True) -> DataFrame:
    p = matched_predictions.filter(F.col("departure_time").isNotNull())
    if terminals_only:
        p = p.filter(F.col("stop_id").isin(TERMINALS))
    return _day_filter(p, "file_timestamp", date, env)


def _distinct_trip_counts(p: DataFrame, keys: list[str]) -> DataFrame:
    """count(DISTINCT trip) and count(DISTINCT trip) FILTER (unmatched), as two
    plain aggregations: first per (keys, trip), then per keys.  A trip with
    both a matched and an unmatched prediction counts as unrealised."""
    per_trip = p.filter(F.col("trip_id").isNotNull()).groupBy(*keys, "trip_id").agg(
        F.max(F.when(~F.col("matched"), 1).otherwise(0)).alias("_unmatched")
    )
    return per_trip.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("_unmatched").cast("long").alias("missed_trips")
    ).withColumn("pct_missed", pct_of("missed_trips", "trips"))


def missed_summary(matched_predictions, date=None, env=None) -> DataFrame:
    p = eligible_departure_predictions(matched_predictions, date, env)
    s = _distinct_trip_counts(p, ["environment", "service_day", "route_id"])
    return s.orderBy("environment", "service_day", route_rank("route_id"), "route_id")


def missed_by_stop(matched_predictions, stops, route_id=None, date=None, env=None, dim_key=None) -> DataFrame:
    p = eligible_departure_predictions(matched_predictions, date, env)
    if route_id is not None:
        p = p.filter(F.col("route_id") == route_id)
    s = _distinct_trip_counts(p, ["environment", "service_day", "route_id", "stop_id"])
    return with_stop_description(s, stops, dim_key=dim_key).orderBy(
        "environment", "service_day", "route_id", F.desc("trips"), "stop_id"
    )


def missed_detail(matched_predictions, route_id=None, stop_id=None, date=None, env=None) -> DataFrame:
    """Unrealised predictions per (vehicle, trip): first/last predicted
    departure and first/last file time (formatted), and the count."""
    p = eligible_departure_predictions(matched_predictions, date, env, terminals_only=False).filter(~F.col("matched"))
    if route_id is not None:
        p = p.filter(F.col("route_id") == route_id)
    if stop_id is not None:
        p = p.filter(F.col("stop_id") == stop_id)
    g = p.groupBy("environment", "service_day", "route_id", "stop_id", "vehicle_id", "trip_id").agg(
        F.min("departure_time").alias("min_departure"),
        F.max("departure_time").alias("max_departure"),
        F.min("file_timestamp").alias("min_file_timestamp"),
        F.max("file_timestamp").alias("max_file_timestamp"),
        F.count(F.lit(1)).alias("predictions"),
    )
    return g.select(
        "environment", "service_day", "route_id", "stop_id", "vehicle_id", "trip_id",
        format_unix("min_departure").alias("first_departure"),
        format_unix("max_departure").alias("last_departure"),
        format_unix("min_file_timestamp").alias("first_file"),
        format_unix("max_file_timestamp").alias("last_file"),
        "predictions", "min_departure",
    ).orderBy("environment", "service_day", "route_id", "stop_id", F.col("vehicle_id").asc_nulls_last(), F.col("min_departure").asc_nulls_last())


__all__ = [
    "departure_service_day", "unpredicted_summary", "unpredicted_by_stop", "unpredicted_detail", "missed_summary",
    "missed_by_stop", "missed_detail", "totals", "epoch_to_utc_ntz",
]
