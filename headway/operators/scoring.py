"""Scoring: matched predictions -> prediction_accuracy rows.

The service runs one INSERT ... SELECT per (environment, kind, bin,
in-next-two) every five minutes: 96 queries per block.  Here all blocks,
environments, kinds, bins and flags are one grouped pass: the bin is a
``CASE`` on the lead time, the rest are grouping keys.  The only exchanges
are the prediction/match join on the prediction id and the group-by
(partially aggregated before its shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import bin_error_bounds, bin_of_lead
from headway.functions.constants import BIN_NAMES, ENVIRONMENTS, KIND_VALUES, VISIBILITY_LAG_S
from headway.functions.times import block_start, minute_of_hour, service_date, service_hour

ACCURACY_COLUMNS = [
    "environment", "service_date", "hour_of_day", "minute_of_hour", "route_id", "stop_id",
    "direction_id", "bin", "kind", "in_next_two", "num_predictions", "num_accurate_predictions",
    "mean_error", "root_mean_squared_error",
]


def scorable_predictions(predictions: DataFrame) -> DataFrame:
    """Rows any of the 96 per-block queries could pick, with their block keys.

    * block bounds are exclusive at both ends, so a file stamped exactly on a
      5-minute boundary is never scored;
    * known environment, kind in the kind list or null;
    * predicted instant (arrival, else departure) strictly after the file
      time, lead time inside one bin;
    * a null stop id cannot be stored and is left out."""
    instant = F.coalesce("arrival_time", "departure_time")
    lead = instant - F.col("file_timestamp")
    ft = F.col("file_timestamp")
    return (
        predictions.filter(
            F.col("environment").isin(ENVIRONMENTS)
            & (F.col("kind").isNull() | F.col("kind").isin(KIND_VALUES))
            & instant.isNotNull()
            & (instant > ft)
            & (block_start(ft) != ft)
            & F.col("stop_id").isNotNull()
        )
        .withColumn("bin", bin_of_lead(lead))
        .filter(F.col("bin").isNotNull())
        .withColumn("in_next_two", F.coalesce(F.col("nth_at_stop").isin(1, 2), F.lit(False)))
        .withColumn("block_start", block_start(ft))
    )


def attach_matches(scorable: DataFrame, matches: DataFrame | None, visibility_lag_s: int | None = VISIBILITY_LAG_S) -> DataFrame:
    """LEFT join predictions to their matched event (arrival / departure time).

    ``matches`` has prediction_id, touch_time, ev_arrival_time,
    ev_departure_time, ev_departure_snapshot.  With ``visibility_lag_s`` the
    block is scored as the service does it, at block_start + lag: a match
    touched later, or a departure recorded later, is not visible yet."""
    if matches is None:
        return scorable.withColumn("ve_arrival_time", F.lit(None).cast("long")).withColumn(
            "ve_departure_time", F.lit(None).cast("long")
        )
    m = matches.select(
        F.col("prediction_id").alias("id"), "touch_time", "ev_arrival_time", "ev_departure_time", "ev_departure_snapshot"
    )
    j = scorable.join(m, "id", "left")
    if visibility_lag_s is None:
        seen = F.col("touch_time").isNotNull()
        dep_seen = F.col("ev_departure_time").isNotNull()
    else:
        horizon = F.col("block_start") + F.lit(visibility_lag_s)
        seen = F.col("touch_time") <= horizon
        dep_seen = F.col("ev_departure_snapshot") <= horizon
    return j.withColumn("ve_arrival_time", F.when(seen, F.col("ev_arrival_time"))).withColumn(
        "ve_departure_time", F.when(seen & dep_seen, F.col("ev_departure_time"))
    )


def graded(rows: DataFrame) -> DataFrame:
    """Signed error = actual - predicted, graded on arrival when the prediction
    has one, else on departure; accurate when strictly inside the bin's tolerance."""
    err = F.when(
        F.col("arrival_time").isNotNull(), F.col("ve_arrival_time") - F.col("arrival_time")
    ).otherwise(F.col("ve_departure_time") - F.col("departure_time"))
    emin, emax = bin_error_bounds("bin")
    return rows.withColumn("err", err).withColumn(
        "accurate", F.when((F.col("err") > emin) & (F.col("err") < emax), 1).otherwise(0)
    )


def accuracy_rows(rows: DataFrame, *more_keys) -> DataFrame:
    """prediction_accuracy rows of graded predictions (``more_keys``: a stream's event-time window)."""
    keys = ["environment", "block_start", "route_id", "stop_id", "direction_id", "bin", "kind", "in_next_two"]
    agg = rows.groupBy(*keys, *more_keys).agg(
        F.count(F.lit(1)).cast("int").alias("num_predictions"),
        F.sum("accurate").cast("int").alias("num_accurate_predictions"),
        F.avg("err").alias("mean_error"),
        F.sqrt(F.avg(F.pow(F.col("err"), 2))).alias("root_mean_squared_error"),
    )
    return agg.select(
        "environment",
        service_date("block_start").alias("service_date"),
        service_hour("block_start").alias("hour_of_day"),
        minute_of_hour("block_start").alias("minute_of_hour"),
        "route_id",
        "stop_id",
        "direction_id",
        "bin",
        "kind",
        "in_next_two",
        "num_predictions",
        "num_accurate_predictions",
        "mean_error",
        "root_mean_squared_error",
        "block_start",
    )


def score(predictions: DataFrame, matches: DataFrame | None, visibility_lag_s: int | None = VISIBILITY_LAG_S) -> DataFrame:
    """prediction_accuracy rows for every 5-minute block present in ``predictions``.

    Unmatched predictions count in num_predictions only."""
    return accuracy_rows(graded(attach_matches(scorable_predictions(predictions), matches, visibility_lag_s)))


def score_block(predictions: DataFrame, matches: DataFrame | None, block_start_s: int, **kw) -> DataFrame:
    """Score one block (the scheduled 5-minute run): prune to the block first
    so the file-time predicate reaches the scan."""
    p = predictions.filter(
        (F.col("file_timestamp") > block_start_s) & (F.col("file_timestamp") < block_start_s + 300)
    )
    return score(p, matches, **kw)


INSERT_REQUIRED = [
    "service_date", "hour_of_day", "minute_of_hour", "stop_id", "route_id", "direction_id", "bin",
    "num_predictions", "num_accurate_predictions",
]


def validate_accuracy(rows: DataFrame) -> DataFrame:
    """Insert-changeset check: service_date, hour, minute, stop, route,
    direction, bin and both counts required; kind, if set, in the kind list;
    bin in the (current) bin list.  Adds ``is_valid``."""
    ok = F.lit(True)
    for c in INSERT_REQUIRED:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.col("kind").isNull() | F.col("kind").isin(KIND_VALUES)) & F.col("bin").isin(BIN_NAMES)
    return rows.withColumn("is_valid", F.coalesce(ok, F.lit(False)))
