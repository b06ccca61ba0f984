"""Explicit schemas for the domain tables and the nested feed documents."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
V = T.VariantType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---- domain tables ---------------------------------------------------------

PREDICTIONS = _struct(
    ("id", L), ("file_timestamp", L), ("environment", S), ("trip_id", S), ("vehicle_id", S),
    ("is_deleted", B), ("boarding_status", S), ("schedule_relationship", S), ("stop_id", S),
    ("route_id", S), ("arrival_time", L), ("departure_time", L), ("stop_sequence", I),
    ("stops_away", I), ("direction_id", I), ("kind", S), ("nth_at_stop", I),
)

VEHICLE_POSITIONS = _struct(
    ("environment", S), ("mode", S), ("id", S), ("label", S), ("is_deleted", B), ("trip_id", S),
    ("route_id", S), ("direction_id", I), ("current_status", S), ("stop_id", S),
    ("timestamp", L), ("snapshot_time", L),
)

PREDICTION_ACCURACY = _struct(
    ("environment", S), ("service_date", T.DateType()), ("hour_of_day", I), ("minute_of_hour", I),
    ("route_id", S), ("stop_id", S), ("direction_id", I), ("bin", S), ("kind", S),
    ("in_next_two", B), ("num_predictions", I), ("num_accurate_predictions", I),
    ("mean_error", D), ("root_mean_squared_error", D),
)

# ---- nested feeds ----------------------------------------------------------

_TIME = _struct(("time", L), ("uncertainty", I))
STOP_TIME_UPDATE = _struct(
    ("arrival", _TIME), ("departure", _TIME), ("boarding_status", S), ("schedule_relationship", S),
    ("stop_id", S), ("stop_sequence", I), ("stops_away", I),
)
TRIP_UPDATES = _struct(
    ("header", _struct(("timestamp", L))),
    (
        "entity",
        T.ArrayType(
            _struct(
                ("id", S),
                ("is_deleted", B),
                (
                    "trip_update",
                    _struct(
                        ("trip", _struct(("trip_id", S), ("route_id", S), ("direction_id", I))),
                        ("vehicle", _struct(("id", S))),
                        ("stop_time_update", T.ArrayType(STOP_TIME_UPDATE)),
                    ),
                ),
            )
        ),
    ),
    ("environment", S),
    ("page", I),  # landing metadata: part number when a snapshot is landed in several documents
    ("fetched_at", L),  # landing metadata: when it was fetched; a file may be fetched more than once
)

_REL = _struct(("data", _struct(("id", S))))
CR_PREDICTIONS = _struct(
    (
        "data",
        T.ArrayType(
            _struct(
                (
                    "attributes",
                    _struct(
                        ("arrival_time", S), ("departure_time", S), ("status", S),
                        ("schedule_relationship", S), ("direction_id", I), ("stop_sequence", I),
                    ),
                ),
                ("relationships", _struct(("vehicle", _REL), ("trip", _REL), ("route", _REL), ("stop", _REL))),
            )
        ),
    ),
    ("last_modified", S),
    ("page", I),
)

# Text fields are read as variants: as strings, numbers in their place would be taken for text.
VEHICLE_FEED = _struct(
    (
        "entity",
        T.ArrayType(
            _struct(
                ("is_deleted", B),
                (
                    "vehicle",
                    _struct(
                        ("current_status", V), ("stop_id", V), ("timestamp", L),
                        ("trip", _struct(("direction_id", I), ("route_id", V), ("trip_id", V))),
                        ("vehicle", _struct(("id", V), ("label", V))),
                    ),
                ),
            )
        ),
    ),
    ("environment", S), ("mode", S), ("snapshot_time", L), ("last_modified", S), ("page", I),
)

CR_VEHICLES = _struct(
    (
        "data",
        T.ArrayType(
            _struct(
                ("id", S),
                ("attributes", _struct(("current_status", S), ("label", S), ("updated_at", S), ("direction_id", I))),
                ("relationships", _struct(("route", _REL), ("stop", _REL), ("trip", _REL))),
            )
        ),
    ),
    ("snapshot_time", L), ("last_modified", S), ("page", I),
)

STOPS = _struct(
    ("data", T.ArrayType(_struct(("id", S), ("attributes", _struct(("description", S), ("name", S), ("platform_name", S)))))),
    ("mode", S),
)
