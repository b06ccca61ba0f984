"""Predictions -> the vehicle event that realised them (interval joins).

A touch (event arrival, or a departure that closed exactly one dwell) at
time t claims every still-unmatched prediction:

* standard: same environment, vehicle and stop, ``t - 30 min < file_ts <= t``;
* terminal: predictions without a vehicle id, same environment, trip,
  direction and stop, ``t - 40 min <= file_ts <= t`` (and the prediction
  takes the event's vehicle id).

A prediction keeps the earliest touch (tie: event key).  The two cases are
disjoint (vehicle id null or not), so they are computed separately and
unioned.  Both joins add a time bucket to the equi-key: touches are keyed
by ``t div W`` and each prediction is copied to the two buckets its window
can reach, so a hot (vehicle, stop) pairs only rows within one window.
The per-prediction choice is a min over a struct: partial aggregation, no
sort of all candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import floor_div
from headway.functions.constants import STANDARD_MATCH_WINDOW_S, TERMINAL_MATCH_WINDOW_S
from headway.operators.events import EVENT_KEY

BUCKET_S = TERMINAL_MATCH_WINDOW_S
MATCH_COLUMNS = [
    "prediction_id", "match_type", "touch_time", "ev_environment", "ev_vehicle_id", "ev_stop_id",
    "ev_arrival_snapshot", "ev_arrival_time", "ev_departure_time", "ev_departure_snapshot",
]


def _bucketed(p: DataFrame, window_s: int) -> DataFrame:
    """Copy each prediction to the (at most two) buckets its window reaches."""
    lo = floor_div("file_timestamp", BUCKET_S)
    hi = floor_div(F.col("file_timestamp") + window_s, BUCKET_S)
    return p.withColumn("bucket", F.explode(F.array_distinct(F.array(lo, hi))))


def _touch_side(touches: DataFrame) -> DataFrame:
    return touches.select(
        floor_div("touch_time", BUCKET_S).alias("bucket"),
        "touch_time",
        F.col("environment"),
        F.col("vehicle_id").alias("ev_vehicle_id"),
        F.col("stop_id"),
        F.col("trip_id").alias("ev_trip_id"),
        F.col("direction_id").alias("ev_direction_id"),
        F.col("arrival_snapshot").alias("ev_arrival_snapshot"),
        F.col("arrival_time").alias("ev_arrival_time"),
        F.col("departure_time").alias("ev_departure_time"),
        F.col("departure_snapshot").alias("ev_departure_snapshot"),
    )


def _first_touch(cands: DataFrame, match_type: str) -> DataFrame:
    best = cands.groupBy(F.col("id").alias("prediction_id")).agg(
        F.min(
            F.struct(
                "touch_time", "ev_arrival_snapshot", "ev_vehicle_id", "environment", "stop_id",
                "ev_arrival_time", "ev_departure_time", "ev_departure_snapshot",
            )
        ).alias("m")
    )
    return best.select(
        "prediction_id",
        F.lit(match_type).alias("match_type"),
        F.col("m.touch_time").alias("touch_time"),
        F.col("m.environment").alias("ev_environment"),
        F.col("m.ev_vehicle_id").alias("ev_vehicle_id"),
        F.col("m.stop_id").alias("ev_stop_id"),
        F.col("m.ev_arrival_snapshot").alias("ev_arrival_snapshot"),
        F.col("m.ev_arrival_time").alias("ev_arrival_time"),
        F.col("m.ev_departure_time").alias("ev_departure_time"),
        F.col("m.ev_departure_snapshot").alias("ev_departure_snapshot"),
    )


def standard_candidates(predictions: DataFrame, touches: DataFrame) -> DataFrame:
    """(prediction, touch) pairs sharing (environment, vehicle, stop, bucket),
    before the exact window test."""
    p = predictions.filter(F.col("vehicle_id").isNotNull()).select(
        "id", "environment", F.col("vehicle_id").alias("ev_vehicle_id"), "stop_id", "file_timestamp"
    )
    return _bucketed(p, STANDARD_MATCH_WINDOW_S).join(
        _touch_side(touches), ["bucket", "ev_vehicle_id", "stop_id", "environment"], "inner"
    )


def match_standard(predictions: DataFrame, touches: DataFrame) -> DataFrame:
    c = standard_candidates(predictions, touches).filter(
        (F.col("file_timestamp") <= F.col("touch_time"))
        & (F.col("file_timestamp") > F.col("touch_time") - STANDARD_MATCH_WINDOW_S)
    )
    return _first_touch(c, "standard")


def match_terminal(predictions: DataFrame, touches: DataFrame) -> DataFrame:
    p = predictions.filter(F.col("vehicle_id").isNull()).select(
        "id", "environment", F.col("trip_id").alias("ev_trip_id"),
        F.col("direction_id").alias("ev_direction_id"), "stop_id", "file_timestamp",
    )
    t = _touch_side(touches)
    c = (
        _bucketed(p, TERMINAL_MATCH_WINDOW_S)
        .join(t, ["bucket", "ev_trip_id", "stop_id", "ev_direction_id", "environment"], "inner")
        .filter(
            (F.col("file_timestamp") <= F.col("touch_time"))
            & (F.col("file_timestamp") >= F.col("touch_time") - TERMINAL_MATCH_WINDOW_S)
        )
    )
    return _first_touch(c, "terminal")


def match_all(predictions: DataFrame, touches: DataFrame) -> DataFrame:
    """prediction_id -> matched event (key, times, touch time, match type)."""
    return match_standard(predictions, touches).unionByName(match_terminal(predictions, touches))


def with_matches(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Predictions with vehicle_event key columns (null when unmatched) and the
    vehicle id a terminal match fills in."""
    m = matches.select(
        F.col("prediction_id").alias("id"), "ev_environment", "ev_vehicle_id", "ev_stop_id", "ev_arrival_snapshot",
        "match_type",
    )
    return (
        predictions.join(m, "id", "left")
        .withColumn("vehicle_id", F.coalesce("vehicle_id", "ev_vehicle_id"))
        .withColumn("matched", F.col("ev_arrival_snapshot").isNotNull())
    )


__all__ = ["match_standard", "match_terminal", "match_all", "with_matches", "EVENT_KEY", "MATCH_COLUMNS"]
