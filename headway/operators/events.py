"""Vehicle snapshots -> transitions -> vehicle events (dwells).

A vehicle's previous state is its record in the *immediately previous*
snapshot of the same feed; a vehicle missing from that snapshot is new
again.  Instead of a window over each vehicle's whole history (one task per
vehicle, unbounded), every record looks up its predecessor with an
equi-join on (environment, mode, vehicle id, previous snapshot time):
high-cardinality keys that spread evenly over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import blank_to_null, floor_div, is_stopped
from headway.functions.constants import MATTAPAN_MAX_DWELL_S, MAX_DWELL_S
from headway.operators.sequence import neighbors

FEED_KEYS = ["environment", "mode"]
EVENT_KEY = ["environment", "vehicle_id", "stop_id", "arrival_snapshot"]
VEHICLE_COLS = ["label", "is_deleted", "trip_id", "route_id", "direction_id", "current_status", "stop_id", "timestamp"]


def snapshot_sequence(snapshots: DataFrame) -> DataFrame:
    """(environment, mode, snapshot_time) -> + prev_snapshot_time, next_snapshot_time."""
    s = snapshots.select(*FEED_KEYS, "snapshot_time").distinct()
    return neighbors(s, FEED_KEYS, "snapshot_time", prev_name="prev_snapshot_time", next_name="next_snapshot_time")


def vehicle_transitions(positions: DataFrame, snapshots: DataFrame, sequence: DataFrame | None = None) -> DataFrame:
    """One row per vehicle record with its previous record (if it was in the
    previous snapshot) and the transition it causes:

    ``new`` / ``new_arrival`` (first sight, stopped or not), ``arrival``
    (same stop, now stopped, was not), ``departure`` (left a stop where it
    was stopped, not stopped now), ``departure_arrival`` (stopped at one stop,
    now stopped at another), ``none`` (anything else).

    ``sequence`` may pass a precomputed ``snapshot_sequence(snapshots)``."""
    seq = snapshot_sequence(snapshots) if sequence is None else sequence
    cur = positions.join(seq, [*FEED_KEYS, "snapshot_time"], "inner")
    # the join sorts by its keys, so the one of most values comes first
    old = positions.select(
        *FEED_KEYS,
        "id",
        F.col("snapshot_time").alias("prev_snapshot_time"),
        *[F.col(c).alias("old_" + c) for c in VEHICLE_COLS],
    )
    j = cur.join(old, ["id", "prev_snapshot_time", *FEED_KEYS], "left")
    new = F.col("old_timestamp").isNull()
    stopped, was_stopped = is_stopped("current_status"), is_stopped("old_current_status")
    same_stop = F.col("stop_id").eqNullSafe(F.col("old_stop_id"))
    kind = (
        F.when(new & stopped, F.lit("new_arrival"))
        .when(new, F.lit("new"))
        .when(same_stop & stopped & ~was_stopped, F.lit("arrival"))
        .when(~same_stop & was_stopped & stopped, F.lit("departure_arrival"))
        .when(~same_stop & was_stopped, F.lit("departure"))
        .otherwise(F.lit("none"))
    )
    return j.withColumn("transition", kind)


REQUIRED_TEXT = ["vehicle_id", "environment", "vehicle_label", "route_id", "trip_id", "stop_id"]
REQUIRED = [*REQUIRED_TEXT, "is_deleted", "direction_id"]


def arrival_rows(transitions: DataFrame) -> DataFrame:
    """The event that each arrival would make, whether it can be stored or not."""
    a = transitions.filter(F.col("transition").isin("new_arrival", "arrival", "departure_arrival"))
    return a.select(
        "environment",
        F.col("id").alias("vehicle_id"),
        F.col("label").alias("vehicle_label"),
        "is_deleted",
        "route_id",
        "direction_id",
        "trip_id",
        "stop_id",
        F.col("timestamp").alias("arrival_time"),
        F.col("snapshot_time").alias("arrival_snapshot"),
    )


def missing_fields():
    """Changeset check of a new event: the required fields it lacks, joined (empty: it is valid).  Blank strings count as
    missing; arrival_time is optional."""
    lacks = [F.when(blank_to_null(F.col(c)).isNull() if c in REQUIRED_TEXT else F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    return F.concat_ws(",", *lacks)


def arrivals(transitions: DataFrame) -> DataFrame:
    return arrival_rows(transitions).filter(missing_fields() == "")


def rejected_arrivals(transitions: DataFrame) -> DataFrame:
    """The arrivals that make no event, with what they lack (``missing``)."""
    return arrival_rows(transitions).withColumn("missing", missing_fields()).filter(F.col("missing") != "")


def departures(transitions: DataFrame) -> DataFrame:
    """A departure is recorded against the *old* record (its stop, route,
    trip) with the *new* record's timestamp."""
    d = transitions.filter(F.col("transition").isin("departure", "departure_arrival"))
    return d.select(
        "environment",
        F.col("id").alias("vehicle_id"),
        F.col("old_label").alias("vehicle_label"),
        F.col("old_route_id").alias("route_id"),
        F.col("old_trip_id").alias("trip_id"),
        F.col("old_stop_id").alias("stop_id"),
        F.col("timestamp").alias("departure_time"),
        F.col("snapshot_time").alias("departure_snapshot"),
    )


def _dwell_limit(route):
    return F.when(route == "Mattapan", F.lit(MATTAPAN_MAX_DWELL_S)).otherwise(F.lit(MAX_DWELL_S))


def vehicle_events(transitions: DataFrame, bucket_s: int = MAX_DWELL_S) -> DataFrame:
    """Dwells: each arrival closed by the first later departure of the same
    vehicle from the same stop with ``arrival_time > departure_snapshot -
    max_dwell(route of the departing record)``.  A departure closes every
    open arrival that qualifies (``closed_with`` counts them).

    Fan-out control: a closing departure lies within (arrival_snapshot,
    arrival_time + max dwell), so departures are keyed by
    ``departure_snapshot div bucket_s`` and each arrival is replicated to the
    (usually one or two) buckets that window touches.  No key -- however hot
    one vehicle at one stop is -- pairs more than a dwell's worth of rows."""
    arr = arrivals(transitions)
    pairs = dwell_candidates(arr, departures(transitions), bucket_s).filter(
        (F.col("departure_snapshot") > F.col("arrival_snapshot"))
        & (F.col("arrival_time") > F.col("departure_snapshot") - _dwell_limit(F.col("dep_route_id")))
    )
    first = pairs.groupBy(*EVENT_KEY).agg(
        F.min(F.struct("departure_snapshot", "departure_time")).alias("d")
    ).select(*EVENT_KEY, F.col("d.departure_snapshot").alias("departure_snapshot"), F.col("d.departure_time").alias("departure_time"))
    # dwells closed by the same departure; counted on closed pairs only, so
    # open dwells (no departure) never share one window partition
    w = Window.partitionBy("environment", "vehicle_id", "stop_id", "departure_snapshot")
    first = first.withColumn("closed_with", F.count(F.lit(1)).over(w).cast("int"))
    return arr.join(first, EVENT_KEY, "left")


def dwell_candidates(arr: DataFrame, dep: DataFrame, bucket_s: int = MAX_DWELL_S) -> DataFrame:
    """(arrival, departure) pairs sharing (environment, vehicle, stop, time
    bucket), before the exact range test.  Each arrival is copied to the
    buckets its closing window (arrival_snapshot, arrival_time + max dwell)
    touches; an empty window gives no copy."""
    first_b = floor_div("arrival_snapshot", bucket_s)
    last_b = floor_div(F.col("arrival_time") + F.lit(MAX_DWELL_S), bucket_s)
    arr_b = arr.withColumn(
        "bucket", F.explode(F.when(last_b >= first_b, F.sequence(first_b, last_b)).otherwise(F.array()))
    )
    dep_b = dep.select(
        "environment", "vehicle_id", "stop_id",
        floor_div("departure_snapshot", bucket_s).alias("bucket"),
        F.col("route_id").alias("dep_route_id"), "departure_time", "departure_snapshot",
    )
    return arr_b.join(dep_b, ["environment", "vehicle_id", "stop_id", "bucket"], "inner")


def departure_anomalies(events: DataFrame) -> DataFrame:
    """Departures that closed more than one open dwell (logged as an error for
    subway routes, info for commuter rail; they match no predictions)."""
    return (
        events.filter(F.col("closed_with") > 1)
        .groupBy("environment", "vehicle_id", "stop_id", "departure_snapshot")
        .agg(
            F.count(F.lit(1)).cast("long").alias("dwells_closed"),
            F.min("arrival_snapshot").alias("first_arrival_snapshot"),
            F.max("route_id").alias("route_id"),
        )
    )


def dropped_vehicles(positions: DataFrame, snapshots: DataFrame, sequence: DataFrame | None = None) -> DataFrame:
    """Vehicles present in a snapshot and missing from the next one of the same
    feed: count and sorted labels per (environment, mode, next snapshot).
    The label list is bounded by one snapshot's vehicles."""
    seq = (snapshot_sequence(snapshots) if sequence is None else sequence).filter(F.col("next_snapshot_time").isNotNull())
    cur = positions.join(seq, [*FEED_KEYS, "snapshot_time"], "inner")
    nxt = positions.select(*FEED_KEYS, "id", F.col("snapshot_time").alias("next_snapshot_time"))
    lost = cur.join(nxt, [*FEED_KEYS, "id", "next_snapshot_time"], "left_anti")
    return lost.groupBy(*FEED_KEYS, F.col("next_snapshot_time").alias("snapshot_time")).agg(
        F.count(F.lit(1)).cast("long").alias("dropped"),
        F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"),
    )


def event_touches(events: DataFrame) -> DataFrame:
    """Moments at which an event looks for predictions: its arrival, and its
    departure if that departure closed exactly this one dwell."""
    base = [*EVENT_KEY, "trip_id", "direction_id", "arrival_time", "departure_time", "departure_snapshot"]
    at_arrival = events.select(*base, F.col("arrival_snapshot").alias("touch_time"))
    at_departure = events.filter(F.col("closed_with") == 1).select(*base, F.col("departure_snapshot").alias("touch_time"))
    return at_arrival.unionByName(at_departure)


def vehicle_events_top(events: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` events by arrival time, nulls last (a top-k report)."""
    return events.orderBy(F.col("arrival_time").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in EVENT_KEY]).limit(n)
