"""Matching and scoring as event-time streams.

Two streams meet: predictions, by the time of their file, and facts about
vehicle events, by the snapshot in which they were seen (an arrival, or the
departure that closed a dwell).  A left outer stream-stream join pairs a
prediction with the facts of its vehicle and stop (its trip, if it names no
vehicle) that come within ``reach_s`` of its file.  Both sides of the join
expire by watermark, and a prediction that nothing was heard about comes out
once, unmatched, when its time is over.  Grouped by prediction, the facts then
tell the first touch; grouped by 5-minute window, the predictions give the
accuracy rows of a block, in append mode: a block is written once and never
revised, as the service does it.

All state is bounded by time: a prediction is kept for ``reach_s`` and the
lateness, a fact as long, a block until the watermark passes it.  What comes
later than ``late`` behind the stream's newest row is refused, and counted in
the query's progress (``refused``).  A watermark is a stream's and not a feed's,
so run one query for each environment.

Rows that come twice (a replayed batch of the stream that wrote them) do no
harm: a prediction is one by its id, and facts are a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.constants import (
    BLOCK_S, MATTAPAN_MAX_DWELL_S, MAX_DWELL_S, STANDARD_MATCH_WINDOW_S, TERMINAL_MATCH_WINDOW_S, VISIBILITY_LAG_S,
)
from headway.operators import scoring as S

LATE = "10 minutes"
EVENT_COLS = ["vehicle_id", "stop_id", "arrival_snapshot", "arrival_time", "departure_time", "departure_snapshot"]
FACT_COLS = ["environment", "trip_id", "direction_id", *EVENT_COLS, "fact_time", "touches"]
FACT_SCHEMA = (
    "environment string, trip_id string, direction_id int, vehicle_id string, stop_id string, arrival_snapshot long, "
    "arrival_time long, departure_time long, departure_snapshot long, fact_time long, touches boolean"
)
ORDER = ["page", "entity_pos", "update_pos"]


def event_facts(events: DataFrame) -> DataFrame:
    """What was seen of each vehicle event, and when: its arrival (the departure is not known then), and its departure.

    ``touches``: whether the fact looks for predictions, as every arrival does,
    and a departure that closed one dwell only."""
    unknown = [F.lit(None).cast("long").alias(c) for c in ("departure_time", "departure_snapshot")]
    base = ["environment", "trip_id", "direction_id", "vehicle_id", "stop_id", "arrival_snapshot", "arrival_time"]
    came = events.select(*base, *unknown, F.col("arrival_snapshot").alias("fact_time"), F.lit(True).alias("touches"))
    left = events.filter(F.col("departure_snapshot").isNotNull())
    left = left.select(*base, "departure_time", "departure_snapshot", F.col("departure_snapshot").alias("fact_time"), (F.col("closed_with") == 1).alias("touches"))
    return came.unionByName(left)


def timed(rows: DataFrame, seconds: str, name: str, late: str = LATE) -> DataFrame:
    return rows.withColumn(name, F.timestamp_seconds(seconds)).withWatermark(name, late)


def ranked_stream(rows: DataFrame, late: str = LATE) -> DataFrame:
    """``rows`` of ``ingest.trip_update_rows`` with their ``id``, ranked at their stop when the watermark passes their file.

    The pages of a snapshot may come in different batches.  A group is one fetch
    of a snapshot at one stop; rows that come twice count once."""
    keys = ["environment", "file_timestamp", "fetched_at", "stop_id", "file_ts"]
    rows = rows if "file_ts" in rows.columns else timed(rows, "file_timestamp", "file_ts", late)
    instant = F.coalesce("arrival_time", "departure_time")
    order = [F.when(F.col("stops_away") == 0, 0).otherwise(1).alias("away"), instant.isNull().alias("last"), instant.alias("at"), *ORDER]
    rest = [c for c in rows.columns if c not in keys and c not in ORDER]
    at = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*order, *rest))).alias("rows"))
    at = at.select(*keys, F.posexplode("rows").alias("place", "r"))
    rank = F.when(F.col("stop_id").isNotNull(), F.col("place") + 1).cast("int").alias("nth_at_stop")
    return at.select(*keys, *[F.col(f"r.{c}").alias(c) for c in (*ORDER, *rest)], rank)


def _by_vehicle() -> Column:
    return F.concat(F.lit("v/"), F.col("vehicle_id"))


def _by_trip() -> Column:
    return F.concat(F.lit("t/"), F.col("direction_id").cast("string"), F.lit("/"), F.col("trip_id"))


def heard(predictions: DataFrame, facts: DataFrame, reach_s: int) -> DataFrame:
    """``predictions`` (with the event time ``file_ts``) with their ``match_type`` and ``heard``: the facts that each can be
    matched with or learn from, within ``reach_s`` of its file.

    Both kinds of match are one join: a prediction is known by its vehicle, or
    by its trip if it has none, and every fact can be met under both.  (Two
    joins would have two watermarks each, and the rarer kind would hold up all.)"""
    f = facts.withColumn("who", F.explode(F.array_compact(F.array(_by_vehicle(), _by_trip()))))
    f = f.select(*[F.col(c).alias(f"f_{c}") for c in (*FACT_COLS, "fact_ts", "who")])
    p = predictions.withColumn("match_type", F.when(F.col("vehicle_id").isNotNull(), "standard").otherwise("terminal"))
    p = p.withColumn("who", F.coalesce(_by_vehicle(), _by_trip()))
    on = (F.col("f_fact_ts") >= F.col("file_ts")) & (F.col("f_fact_ts") <= F.col("file_ts") + F.expr(f"interval {reach_s} seconds"))
    for c in ("environment", "stop_id", "who"):
        on = on & (F.col(c) == F.col(f"f_{c}"))
    fact = F.struct(*[F.col(f"f_{c}").alias(c) for c in ("fact_time", "environment", "touches", *EVENT_COLS)])
    told = F.when(F.col("f_fact_ts").isNotNull(), fact)
    return p.join(f, on, "left_outer").groupBy(*predictions.columns, "match_type").agg(F.collect_set(told).alias("heard"))


def _in_window(x: Column) -> Column:
    t, f = x["fact_time"], F.col("file_timestamp")
    standard = (f <= t) & (f > t - STANDARD_MATCH_WINDOW_S)
    terminal = (f <= t) & (f >= t - TERMINAL_MATCH_WINDOW_S)
    return x["touches"] & F.when(F.col("match_type") == "standard", standard).otherwise(terminal)


def first_touch(rows: DataFrame) -> DataFrame:
    """``rows`` of ``heard`` with the match's columns: the earliest touch (tie: the event's key), and the departure of its event as far as heard of."""
    touch = F.transform(
        F.filter("heard", _in_window),
        lambda x: F.struct(x["fact_time"].alias("touch_time"), x["arrival_snapshot"].alias("ev_arrival_snapshot"), x["vehicle_id"].alias("ev_vehicle_id"),
                           x["environment"].alias("ev_environment"), x["stop_id"].alias("ev_stop_id"), x["arrival_time"].alias("ev_arrival_time")))
    rows = rows.withColumn("m", F.array_min(touch))
    of = F.filter("heard", lambda x: (x["arrival_snapshot"] == F.col("m.ev_arrival_snapshot")) & (x["vehicle_id"] == F.col("m.ev_vehicle_id")) & x["departure_snapshot"].isNotNull())
    gone = F.array_min(F.transform(of, lambda x: F.struct(x["departure_snapshot"].alias("ev_departure_snapshot"), x["departure_time"].alias("ev_departure_time"))))
    return rows.withColumn("d", gone).select(*[c for c in rows.columns if c not in ("heard", "m")], "m.*", "d.*")


MATCH_REACH_S = TERMINAL_MATCH_WINDOW_S + max(MAX_DWELL_S, MATTAPAN_MAX_DWELL_S)  # from the file to the touch, and from there to the departure


def match_stream(predictions: DataFrame, facts: DataFrame, late: str = LATE) -> DataFrame:
    """The rows of ``matching.match_all``, each when the watermark passes its prediction's reach.

    ``predictions``: ``id, environment, vehicle_id, trip_id, direction_id,
    stop_id, file_timestamp``; ``facts``: see ``event_facts``."""
    p = predictions.select("id", "environment", "vehicle_id", "trip_id", "direction_id", "stop_id", "file_timestamp")
    m = first_touch(heard(timed(p, "file_timestamp", "file_ts", late), timed(facts, "fact_time", "fact_ts", late), MATCH_REACH_S))
    return m.filter(F.col("touch_time").isNotNull()).select(
        F.col("id").alias("prediction_id"), "match_type", "touch_time", "ev_environment", "ev_vehicle_id", "ev_stop_id",
        "ev_arrival_snapshot", "ev_arrival_time", "ev_departure_time", "ev_departure_snapshot")


SCORE_COLS = ["environment", "vehicle_id", "trip_id", "route_id", "direction_id", "stop_id", "file_timestamp", "arrival_time", "departure_time", "kind", "nth_at_stop"]


def score_stream(predictions: DataFrame, facts: DataFrame, late: str = LATE) -> DataFrame:
    """The rows of ``scoring.score``, each block when the watermark passes the last of its predictions' reach.

    ``predictions`` are ranked, or rows of ``ingest.trip_update_rows`` with an
    ``id``, which are ranked here.  A prediction hears of facts for as long as
    the service would wait with its block."""
    p = timed(predictions, "file_timestamp", "file_ts", late)
    if "nth_at_stop" not in p.columns:
        p = ranked_stream(p, late)
    p = S.scorable_predictions(p.select("id", *SCORE_COLS, "file_ts"))
    m = first_touch(heard(p, timed(facts, "fact_time", "fact_ts", late), VISIBILITY_LAG_S + BLOCK_S))
    horizon = F.col("block_start") + VISIBILITY_LAG_S
    seen = F.col("touch_time") <= horizon
    m = m.withColumn("ve_arrival_time", F.when(seen, F.col("ev_arrival_time")))
    m = m.withColumn("ve_departure_time", F.when(seen & (F.col("ev_departure_snapshot") <= horizon), F.col("ev_departure_time")))
    return S.accuracy_rows(S.graded(m), F.window("file_ts", f"{BLOCK_S} seconds"))


def refused(progress) -> int:
    """Rows that came too late, over the batches of a query's ``recentProgress``."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def start_live(rows: DataFrame, out_path: str, checkpoint: str, available_now: bool = True, processing_time: str = "1 minute"):
    """Append the rows of one of these streams to ``out_path``.  Spark's file sink logs its batches: readers see whole ones only, each once."""
    w = rows.writeStream.format("parquet").outputMode("append").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
