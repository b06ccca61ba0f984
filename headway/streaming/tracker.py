"""Vehicle tracker: transitions of stored vehicle snapshots.

The same transition rows as the batch ``vehicle_transitions``, plus one
``dropped`` row per vehicle that left the feed, from equi-joins on
(environment, mode, vehicle, previous snapshot); Spark deals out the vehicles
of a feed, however many they are.

Every snapshot must reach the tracker even when it has no valid vehicle (then
everything drops): the input carries one heartbeat row per snapshot, or more,
with a null vehicle id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.constants import STATUS_STOPPED
from headway.operators import events as E
from headway.operators import ingest as IN

RECORD_COLS = ["label", "is_deleted", "trip_id", "route_id", "direction_id", "current_status", "stop_id", "timestamp"]
RECORD_SCHEMA = (
    "label string, is_deleted boolean, trip_id string, route_id string, direction_id int, "
    "current_status string, stop_id string, timestamp long"
)
OUTPUT_SCHEMA = (
    "environment string, mode string, id string, snapshot_time long, prev_snapshot_time long, transition string, "
    + RECORD_SCHEMA
    + ", old_label string, old_trip_id string, old_route_id string, old_stop_id string, old_current_status string, "
    "old_timestamp long"
)
_OUT_COLS = [f.split()[0] for f in OUTPUT_SCHEMA.split(", ")]


def classify(new: dict, old: dict | None) -> str:
    """Transition of one vehicle between consecutive snapshots."""
    stopped = new["current_status"] == STATUS_STOPPED
    if old is None:
        return "new_arrival" if stopped else "new"
    was_stopped = old["current_status"] == STATUS_STOPPED
    same = new["stop_id"] == old["stop_id"]
    if same and stopped and not was_stopped:
        return "arrival"
    if not same and was_stopped and stopped:
        return "departure_arrival"
    if not same and was_stopped:
        return "departure"
    return "none"


def tracker_input(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Valid vehicle records plus one heartbeat row (null id) per snapshot."""
    cols = ["environment", "mode", "snapshot_time", "pos", "id", *RECORD_COLS]
    hb = snapshots.select(
        "environment", "mode", "snapshot_time", F.lit(-1).cast("int").alias("pos"), F.lit(None).cast("string").alias("id"),
        *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in RECORD_SCHEMA.split(", ")],
    )
    return records.select(*cols).unionByName(hb.select(*cols))


def track(inputs: DataFrame) -> DataFrame:
    """Transitions of tracker input rows, which hold whole snapshots."""
    snaps = inputs.select(*E.FEED_KEYS, "snapshot_time")
    recs = IN.last_record_per_vehicle(inputs.filter(F.col("id").isNotNull()))
    seq = E.snapshot_sequence(snaps)
    moved = E.vehicle_transitions(recs, snaps, seq).select(*_OUT_COLS)
    nxt = recs.select(*E.FEED_KEYS, "id", F.col("snapshot_time").alias("next_snapshot_time"))
    lost = recs.join(seq.filter(F.col("next_snapshot_time").isNotNull()), [*E.FEED_KEYS, "snapshot_time"])
    lost = lost.join(nxt, [*E.FEED_KEYS, "id", "next_snapshot_time"], "left_anti")
    told = {"snapshot_time": "next_snapshot_time", "prev_snapshot_time": "snapshot_time", "old_label": "label"}
    same = ("environment", "mode", "id")
    dropped = lost.select(*[
        F.lit("dropped").alias(n) if n == "transition"
        else F.col(told.get(n, n)).alias(n) if n in told or n in same
        else F.lit(None).cast(t).alias(n)
        for n, t in (f.split() for f in OUTPUT_SCHEMA.split(", "))
    ])
    return moved.unionByName(dropped)
