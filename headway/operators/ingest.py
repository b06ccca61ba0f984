"""Feed snapshots -> flat rows (flatten, validate, rank, dedupe).

Snapshots are nested JSON documents; each one becomes many rows through
``posexplode`` of its arrays.  Every step is a narrow projection except the
nth-at-stop rank, a window bounded by one snapshot at one stop, and the
per-snapshot dedupe of vehicle records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from headway.functions.columns import generic_stop_id, kind_from_uncertainty
from headway.functions.constants import VEHICLE_STATUSES
from headway.functions.times import iso8601_to_epoch, rfc1123_to_epoch

ENV_LABELS = {"prod": "prod", "dev_green": "dev-green", "dev_blue": "dev-blue"}


# ---- P2 / W1 on flat rows ----------------------------------------------------


def keep_scorable_updates(df: DataFrame) -> DataFrame:
    """Keep updates with stops_away and at least one of arrival/departure time."""
    return df.filter(
        F.col("stops_away").isNotNull()
        & (F.col("arrival_time").isNotNull() | F.col("departure_time").isNotNull())
    )


def rank_at_stop(df: DataFrame, tie_break: list[str]) -> DataFrame:
    """nth_at_stop: 1-based rank within one fetch of a snapshot (environment,
    file_timestamp and, where the rows have it, fetched_at) per stop, vehicles
    already at the stop first, then by predicted instant; ``tie_break`` keeps
    the feed order.  Null stop -> null rank.

    The window partition is one snapshot at one stop, so it is bounded by the
    feed size, not by the data volume."""
    fetch = ["fetched_at"] if "fetched_at" in df.columns else []
    w = Window.partitionBy("file_timestamp", "environment", *fetch, "stop_id").orderBy(
        F.when(F.col("stops_away") == 0, 0).otherwise(1),
        F.coalesce("arrival_time", "departure_time").asc_nulls_last(),
        *[F.col(c) for c in tie_break],
    )
    return df.withColumn(
        "nth_at_stop",
        F.when(F.col("stop_id").isNotNull(), F.row_number().over(w)).cast("int"),
    )


# ---- S1 / P1 / P3 / P4 / P5: subway trip updates ------------------------------


FEED_ORDER = ["page", "entity_pos", "update_pos"]


def flatten_trip_updates(docs: DataFrame) -> DataFrame:
    """Trip-update snapshots -> prediction rows, ranked at their stop.  Each
    fetch of a file is ranked for itself: one file fetched twice gives its
    rows twice with the same ranks."""
    return rank_at_stop(trip_update_rows(docs), tie_break=FEED_ORDER)


def trip_update_rows(docs: DataFrame) -> DataFrame:
    """Trip-update snapshots -> prediction rows without the rank.

    ``docs`` has the ``TRIP_UPDATES`` schema (one row per fetched snapshot,
    with its environment).  Snapshots lacking ``entity`` or
    ``header.timestamp`` yield nothing; an entity without updates yields no
    row.  Trip fields are copied onto each update."""
    snap = docs.filter(F.col("entity").isNotNull() & F.col("header.timestamp").isNotNull())
    page = F.coalesce(F.col("page"), F.lit(0)) if "page" in docs.columns else F.lit(0)
    fetched = F.coalesce(F.col("fetched_at"), F.lit(0)) if "fetched_at" in docs.columns else F.lit(0)
    ent = snap.select(
        environment_label("environment").alias("environment"),
        F.col("header.timestamp").alias("file_timestamp"),
        fetched.cast("long").alias("fetched_at"),
        page.cast("int").alias("page"),
        F.posexplode("entity").alias("entity_pos", "e"),
    )
    upd = ent.select(
        "environment",
        "file_timestamp",
        "fetched_at",
        "page",
        "entity_pos",
        F.col("e.is_deleted").alias("is_deleted"),
        F.col("e.trip_update.trip.trip_id").alias("trip_id"),
        F.col("e.trip_update.vehicle.id").alias("vehicle_id"),
        F.col("e.trip_update.trip.route_id").alias("route_id"),
        F.col("e.trip_update.trip.direction_id").alias("direction_id"),
        F.posexplode("e.trip_update.stop_time_update").alias("update_pos", "u"),
    )
    rows = upd.select(
        "file_timestamp",
        "environment",
        "trip_id",
        "vehicle_id",
        "is_deleted",
        F.col("u.boarding_status").alias("boarding_status"),
        F.col("u.schedule_relationship").alias("schedule_relationship"),
        generic_stop_id(F.col("u.stop_id")).alias("stop_id"),
        "route_id",
        F.col("u.arrival.time").alias("arrival_time"),
        F.col("u.departure.time").alias("departure_time"),
        F.col("u.stop_sequence").alias("stop_sequence"),
        F.col("u.stops_away").alias("stops_away"),
        "direction_id",
        kind_from_uncertainty(F.col("u.arrival.uncertainty"), F.col("u.departure.uncertainty")).alias("kind"),
        "fetched_at",
        "page",
        "entity_pos",
        "update_pos",
    )
    return keep_scorable_updates(rows)


def prediction_id():
    """Key of a stored prediction: its place in its feed, without any limit on the parts
    (environment, file time, fetch, page, entity position, update position)."""
    return F.concat_ws("/", "environment", *[F.col(c).cast("string") for c in ["file_timestamp", "fetched_at", *FEED_ORDER]])


def environment_label(env_name):
    """Internal environment names (``dev_green``) -> stored labels (``dev-green``)."""
    c = F.col(env_name) if isinstance(env_name, str) else env_name
    out = None
    for k, v in ENV_LABELS.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(c)


# ---- S2 / P6: commuter-rail predictions --------------------------------------


def flatten_cr_predictions(docs: DataFrame) -> DataFrame:
    """JSON:API prediction snapshots (+ ``last_modified`` header) -> rows.
    Rows without a vehicle are dropped; environment is always prod; stop ids
    are not normalised; the key is the row's place in its feed."""
    page = F.coalesce(F.col("page"), F.lit(0)) if "page" in docs.columns else F.lit(0)
    ent = docs.filter(F.col("data").isNotNull()).select(
        rfc1123_to_epoch("last_modified").alias("file_timestamp"),
        page.cast("int").alias("page"),
        F.posexplode("data").alias("pos", "p"),
    )
    a, r = "p.attributes.", "p.relationships."
    return ent.filter(F.col(r + "vehicle.data.id").isNotNull()).select(
        F.lit("prod").alias("environment"),
        "file_timestamp",
        F.col(r + "vehicle.data.id").alias("vehicle_id"),
        F.col(r + "trip.data.id").alias("trip_id"),
        F.col(r + "route.data.id").alias("route_id"),
        F.col(a + "direction_id").alias("direction_id"),
        iso8601_to_epoch(F.col(a + "arrival_time")).alias("arrival_time"),
        iso8601_to_epoch(F.col(a + "departure_time")).alias("departure_time"),
        F.col(a + "status").alias("boarding_status"),
        F.col(a + "schedule_relationship").alias("schedule_relationship"),
        F.col(r + "stop.data.id").alias("stop_id"),
        F.col(a + "stop_sequence").alias("stop_sequence"),
        F.lit(None).cast("boolean").alias("is_deleted"),
        F.lit(None).cast("int").alias("stops_away"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("int").alias("nth_at_stop"),
        F.concat_ws("/", F.lit("commuter_rail"), *[F.col(c).cast("string") for c in ["file_timestamp", "page", "pos"]]).alias("id"),
    )


# ---- S3 / P7 / W3: subway vehicle positions -----------------------------------


def parse_vehicle_feed(docs: DataFrame, raw: bool = False) -> DataFrame:
    """Vehicle snapshots -> records with ``parse_status`` valid / ignore / error;
    with ``raw`` also the ``entity`` they were parsed from, as JSON.

    error: a required field is missing or has a bad value or type; ignore: the
    record is well formed but its stop id is no string.  A document without
    ``entity`` yields no rows (but still counts as a snapshot, see
    ``snapshots_of``)."""
    ent = docs.filter(F.col("entity").isNotNull()).select(
        "environment", "mode", "snapshot_time", F.posexplode("entity").alias("pos", "e")
    )
    v = "e.vehicle."
    recs = ent.select(
        "environment",
        "mode",
        "snapshot_time",
        "pos",
        _text(ent, v + "vehicle.id").alias("id"),
        _text(ent, v + "vehicle.label").alias("label"),
        F.col("e.is_deleted").alias("is_deleted"),
        _text(ent, v + "trip.trip_id").alias("trip_id"),
        _text(ent, v + "trip.route_id").alias("route_id"),
        F.col(v + "trip.direction_id").alias("direction_id"),
        _text(ent, v + "current_status").alias("current_status"),
        generic_stop_id(_text(ent, v + "stop_id")).alias("stop_id"),
        F.col(v + "timestamp").alias("timestamp"),
        _present(ent, v + "stop_id").alias("_stop"),
        *([F.to_json("e").alias("entity")] if raw else []),
    )
    well_formed = (
        F.col("is_deleted").isNotNull()
        & F.col("route_id").isNotNull()
        & F.col("trip_id").isNotNull()
        & F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("direction_id").isin(0, 1)
        & F.col("current_status").isin(VEHICLE_STATUSES)
        & F.col("timestamp").isNotNull()
        & F.col("_stop")
    )
    status = (
        F.when(~F.coalesce(well_formed, F.lit(False)), F.lit("error"))
        .when(F.col("stop_id").isNull(), F.lit("ignore"))
        .otherwise(F.lit("valid"))
    )
    return recs.withColumn("parse_status", status).drop("_stop")


def _is_variant(df: DataFrame, path: str) -> bool:
    return isinstance(df.select(F.col(path).alias("x")).schema["x"].dataType, VariantType)


def _text(df: DataFrame, path: str):
    """A text field; of one read as a variant only a JSON string counts, a number or null does not."""
    c = F.col(path)
    return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")) if _is_variant(df, path) else c


def _present(df: DataFrame, path: str):
    """Whether the record has the field at all, be it with a JSON null (known of variants only)."""
    return F.col(path).isNotNull() if _is_variant(df, path) else F.lit(True)


def last_record_per_vehicle(recs: DataFrame) -> DataFrame:
    """Within one snapshot the last record of a vehicle id wins.  The group is
    (snapshot, vehicle), so a max over a struct (partial aggregation) is
    enough; no window sort is needed."""
    keys = ["environment", "mode", "snapshot_time", "id"]
    rest = [c for c in recs.columns if c not in keys and c != "pos"]
    return (
        recs.groupBy(*keys)
        .agg(F.max(F.struct("pos", *rest)).alias("r"))
        .select(*keys, *[F.col("r." + c).alias(c) for c in rest])
    )


def vehicle_positions_from_feed(docs: DataFrame) -> DataFrame:
    recs = parse_vehicle_feed(docs).filter(F.col("parse_status") == "valid").drop("parse_status")
    return last_record_per_vehicle(recs)


# ---- S4 / P8: commuter-rail vehicles -----------------------------------------


def parse_cr_vehicles(docs: DataFrame, environment: str = "prod") -> DataFrame:
    """Commuter-rail vehicles, the last record of each in a snapshot (see ``cr_vehicle_records``)."""
    return last_record_per_vehicle(cr_vehicle_records(docs, environment))


def parse_cr_feed(docs: DataFrame, environment: str = "prod", raw: bool = False) -> DataFrame:
    """Records of commuter-rail vehicles with ``parse_status`` valid / error (and ``raw`` their ``entity``): only the prod tracker
    reads them.  Records missing any required key, or whose stop relationship has no data, are errors."""
    ent = docs.filter(F.col("data").isNotNull() & F.lit(environment == "prod")).select(
        "snapshot_time", F.posexplode("data").alias("pos", "d")
    )
    a, r = "d.attributes.", "d.relationships."
    recs = ent.select(
        F.lit("prod").alias("environment"),
        F.lit("commuter_rail").alias("mode"),
        "snapshot_time",
        "pos",
        F.col("d.id").alias("id"),
        F.col(a + "label").alias("label"),
        F.lit(False).alias("is_deleted"),
        F.col(r + "trip.data.id").alias("trip_id"),
        F.col(r + "route.data.id").alias("route_id"),
        F.col(a + "direction_id").alias("direction_id"),
        F.col(a + "current_status").alias("current_status"),
        F.col(r + "stop.data.id").alias("stop_id"),
        iso8601_to_epoch(F.col(a + "updated_at")).alias("timestamp"),
        F.col(a + "updated_at").alias("_updated_at"),
        F.col(r + "stop.data").isNotNull().alias("_stop"),
        *([F.to_json("d").alias("entity")] if raw else []),
    )
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_updated_at").isNotNull() & F.col(
        "current_status"
    ).isin(VEHICLE_STATUSES) & F.col("route_id").isNotNull() & F.col("trip_id").isNotNull() & F.col("_stop")
    status = F.when(F.coalesce(ok, F.lit(False)), F.lit("valid")).otherwise(F.lit("error"))
    return recs.withColumn("parse_status", status).drop("_updated_at", "_stop")


def cr_vehicle_records(docs: DataFrame, environment: str = "prod") -> DataFrame:
    """The valid records of ``parse_cr_feed``."""
    return parse_cr_feed(docs, environment).filter(F.col("parse_status") == "valid").drop("parse_status")


# ---- S6: snapshot dedupe ----------------------------------------------------


def dedupe_snapshots(docs: DataFrame) -> DataFrame:
    """Drop vehicle snapshots whose Last-Modified equals an earlier fetch of the
    same (environment, mode) feed (the 304 path).  Header names are already
    normalised when files are landed; the values compare exactly.  A snapshot
    without the header cannot be told to repeat another and is kept.
    Prediction snapshots are never deduplicated."""
    told = docs.filter(F.col("last_modified").isNotNull())
    first = told.groupBy("environment", "mode", "last_modified").agg(F.min("snapshot_time").alias("snapshot_time"))
    kept = told.join(first, ["environment", "mode", "last_modified", "snapshot_time"], "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter(F.col("last_modified").isNull()))


def snapshots_of(docs: DataFrame) -> DataFrame:
    """One row per processed vehicle snapshot (environment, mode, snapshot_time);
    a snapshot counts even when it holds no valid vehicle."""
    return docs.select("environment", "mode", "snapshot_time").distinct()
