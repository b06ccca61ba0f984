"""Domain tables built from the driver's test tables with the operators.

These are the inputs every registered query starts from; each is a lazy
DataFrame (nothing is collected), so Catalyst sees one plan per query from
the parquet scans to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from headway.functions.times import epoch_to_utc_ntz, week_start
from headway.operators import events as E
from headway.operators import matching as M
from headway.session import materialize
from headway.sources import adapters as A
from headway.sources import schemas as SC


def events(spark: SparkSession, d: str) -> DataFrame:
    """The driver's events with their times and JSON properties parsed, stored once per session: a filter over columns
    of theirs would else parse each of them anew."""
    return materialize(spark, lambda: A.base_events(spark, d), "events", (d,))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """The landed vehicle-position records (one per vehicle and snapshot)."""
    return materialize(spark, lambda: A.vehicle_positions(spark, d, events(spark, d)), "vehicle_positions", (d,))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return A.vehicle_snapshots(spark, d, events(spark, d))


def snapshot_log(spark: SparkSession, d: str) -> DataFrame:
    """Processed snapshots with their previous / next snapshot per feed."""
    return materialize(spark, lambda: E.snapshot_sequence(snapshots(spark, d)), "snapshot_log", (d,))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transition log (one row per vehicle record), stored once per session."""
    return materialize(
        spark,
        lambda: E.vehicle_transitions(positions(spark, d), None, sequence=snapshot_log(spark, d)),
        "transitions",
        (d,),
    )


def vehicle_events(spark: SparkSession, d: str) -> DataFrame:
    """The stored vehicle_events table (dwells), written once per session."""
    return materialize(spark, lambda: E.vehicle_events(transitions(spark, d)), "vehicle_events", (d,))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The stored predictions table (flattened, ranked), written once per
    session, partitioned by the UTC date of the file time and sorted by
    (file time, environment) inside files, the order in which they are ranked,
    so day and block filters prune."""

    def build() -> DataFrame:
        p = A.predictions(spark, d, events(spark, d)).withColumn("file_date", F.to_date(epoch_to_utc_ntz("file_timestamp")))
        return p.sortWithinPartitions("file_date", "file_timestamp", "environment")

    return materialize(spark, build, "predictions", (d,), partition_by=["file_date"])


def matches(spark: SparkSession, d: str) -> DataFrame:
    """The stored prediction -> event links, written once per session."""
    return materialize(
        spark,
        lambda: M.match_all(predictions(spark, d), E.event_touches(vehicle_events(spark, d))),
        "matches",
        (d,),
    )


def accuracy_hist(spark: SparkSession, d: str) -> DataFrame:
    """The stored prediction_accuracy history: partitioned by week (the
    service's weekly range partitions), clustered by (route, environment)
    inside each file; large weeks are split over several.  The lines are dealt
    by week before their texts are made."""

    def build() -> DataFrame:
        lines = A.accuracy_lines(spark, d).withColumn("week_start", week_start("service_date")).hint("rebalance", "week_start")
        h = A.accuracy_rows_of(lines, "week_start")
        return h.sortWithinPartitions("week_start", "route_id", "environment", "service_date")

    return materialize(spark, build, "prediction_accuracy", (d,), partition_by=["week_start"])


# ---- landed feed documents (JSON Lines, read back with explicit schemas) ----------------


def landed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Feed snapshots landed once as gzipped JSON Lines files and read back through
    the JSON source with the feed's explicit schema (no inference)."""
    builders = {
        "trip_updates": (A.trip_update_docs, SC.TRIP_UPDATES),
        "cr_predictions": (A.cr_prediction_docs, SC.CR_PREDICTIONS),
        "vehicle_feed": (A.vehicle_feed_docs, SC.VEHICLE_FEED),
        "cr_vehicles": (A.cr_vehicle_docs, SC.CR_VEHICLES),
        "stops": (A.stops_docs, SC.STOPS),
    }
    build, schema = builders[name]
    return materialize(spark, lambda: build(spark, d), "landed_" + name, (d,), fmt="json", schema=schema, compression="gzip")
