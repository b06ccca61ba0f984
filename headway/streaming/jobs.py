"""Structured Streaming jobs over landed feed files.

* vehicle tracker: vehicle snapshots (JSON files) -> deduped -> records,
  quarantine, counts and transitions by feed and hour, published together
  (``foreachBatch``, see ``snapshots``);
* prediction ingest: trip-update snapshots -> flattened rows -> predictions
  table by file date and environment (``foreachBatch``: every batch
  overwrites its own ``batch_id=`` folder, so replays are idempotent).  The
  rank at the stop is computed on reading (``stored_predictions``), since
  the pages of one snapshot may land in different batches;
* block scoring: a batch job per run that scores the blocks closed by the
  scoring lag and overwrites exactly those blocks (idempotent re-runs).  The
  streaming scorer keeps the horizon of its last run beside its checkpoint,
  so every block between two horizons is scored, however far apart they are.

Checkpoint folders must live in shared storage (the cluster's
``spark.checkpoint.dir``), never on a machine-local disk.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from headway.functions.constants import BLOCK_S, MAX_DWELL_S, TERMINAL_MATCH_WINDOW_S, VISIBILITY_LAG_S
from headway.functions.times import epoch_to_utc_ntz
from headway.operators import events as E
from headway.operators import ingest as IN
from headway.operators import matching as M
from headway.operators import scoring as S
from headway.operators.maintenance import write_accuracy
from headway.sources import schemas as SC
from headway.streaming.accuracy import publish_accuracy
from headway.streaming.snapshots import store_batch, stored_transitions


def read_feed(spark: SparkSession, landing: str, schema, max_files: int | None = None,
              one_doc_per_file: bool = True) -> DataFrame:
    """Landed feed files: one (pretty-printed) document per file, or JSON Lines
    with ``one_doc_per_file=False``."""
    r = spark.readStream.schema(schema).option("multiLine", one_doc_per_file)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(landing)


def dedupe_stream(docs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Drop re-fetched snapshots (same Last-Modified for the same feed); of a
    snapshot landed in pages every page counts for itself.  A snapshot without
    the header is kept.  ``watermark``: how late a snapshot may land behind the
    newest one of any feed; later ones are dropped.  The tracker has no such
    limit: it looks its snapshots up among those it has stored."""
    told = F.coalesce("last_modified", F.concat(F.lit("snapshot "), F.col("snapshot_time").cast("string")))
    page = F.coalesce("page", F.lit(0)) if "page" in docs.columns else F.lit(0)
    return (
        docs.withColumns({"_ts": F.timestamp_seconds("snapshot_time"), "_told": told, "_page": page})
        .withWatermark("_ts", watermark)
        .dropDuplicatesWithinWatermark(["environment", "mode", "_told", "_page"])
        .drop("_ts", "_told", "_page")
    )


def start_vehicle_tracker(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                          available_now: bool = True, processing_time: str = "1 second",
                          one_doc_per_file: bool = True, max_files: int = 500, mode: str = "subway", facts_path: str | None = None):
    """Publish the transitions of the landed vehicle snapshots, and what they come from, under ``out_path`` (see ``snapshots``).

    ``max_files`` bounds a micro-batch, so a backlog is worked off in steps.
    ``facts_path``: where to append what is seen of vehicle events, for the
    streams of ``live``."""
    docs = read_feed(spark, landing, SC.CR_VEHICLES if mode == "commuter_rail" else SC.VEHICLE_FEED, max_files, one_doc_per_file)
    if mode == "commuter_rail":  # which one (the prod) feed reports
        docs = docs.withColumns({"environment": F.lit("prod"), "mode": F.lit("commuter_rail")})

    def write(batch: DataFrame, epoch_id: int) -> None:
        store_batch(batch, out_path, epoch_id, writer=f"tracker {checkpoint}", rail=mode == "commuter_rail", facts_path=facts_path)

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def start_prediction_ingest(spark: SparkSession, landing: str, out_path: str, checkpoint: str, available_now: bool = True,
                            one_doc_per_file: bool = True, mode: str = "subway"):
    """Commuter-rail rows are stored without a rank, which they never get; give each mode its own folder."""
    rail = mode == "commuter_rail"
    docs = read_feed(spark, landing, SC.CR_PREDICTIONS if rail else SC.TRIP_UPDATES, one_doc_per_file=one_doc_per_file)

    def write(batch: DataFrame, epoch_id: int) -> None:
        # each micro-batch owns one folder and overwrites it: a batch replayed
        # after a failure replaces its own rows instead of appending twice
        rows = IN.flatten_cr_predictions(batch) if rail else IN.trip_update_rows(batch).withColumn("id", IN.prediction_id())
        rows = rows.withColumn("file_date", F.to_date(epoch_to_utc_ntz("file_timestamp")))
        rows.write.mode("overwrite").partitionBy("file_date", "environment").parquet(f"{out_path}/batch_id={epoch_id}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


def stored_predictions(spark: SparkSession, path: str, from_s: int | None = None, before_s: int | None = None) -> DataFrame:
    """Stored prediction rows with file times in [from_s, before_s), ranked at
    their stop if they were stored without a rank.  The dates of the bounds
    prune the partitions."""
    p = spark.read.parquet(path)
    for bound, ops in ((from_s, ("__ge__", "__ge__")), (before_s, ("__lt__", "__le__"))):
        if bound is None:
            continue
        p = p.filter(getattr(F.col("file_timestamp"), ops[0])(bound))
        if "file_date" in p.columns:
            day = _dt.datetime.fromtimestamp(bound, _dt.timezone.utc).date()
            p = p.filter(getattr(F.col("file_date"), ops[1])(F.lit(day)))
    return p if "nth_at_stop" in p.columns else IN.rank_at_stop(p, IN.FEED_ORDER)


def score_closed_blocks(transitions: DataFrame, predictions: DataFrame, now_s: int,
                        lag_s: int = VISIBILITY_LAG_S, since_s: int | None = None) -> DataFrame:
    """Accuracy rows of every block closed at ``now_s`` (block_start + lag <=
    now), optionally only blocks starting at or after ``since_s``.  Inputs
    are pruned to the time range that can influence those blocks (a
    prediction's file time lies in its block; events and touches up to the
    scoring horizon)."""
    lo = None if since_s is None else since_s - MAX_DWELL_S - TERMINAL_MATCH_WINDOW_S
    t = transitions.filter(F.col("transition") != "dropped").filter(F.col("snapshot_time") <= now_s)
    p = predictions.filter(F.col("file_timestamp") < now_s)
    if lo is not None:
        t = t.filter(F.col("snapshot_time") >= lo)
        p = p.filter(F.col("file_timestamp") >= since_s)
    ev = E.vehicle_events(t)
    m = M.match_all(p, E.event_touches(ev))
    acc = S.score(p, m, visibility_lag_s=lag_s)
    acc = acc.filter(F.col("block_start") + lag_s <= now_s)
    return acc if since_s is None else acc.filter(F.col("block_start") >= since_s)


def run_scoring(spark: SparkSession, transitions_path: str, predictions_path: str, out_path: str, now_s: int,
                since_s: int | None = None, publish: bool = False) -> None:
    """One scheduled scoring run: score every block closed at ``now_s`` that
    starts at or after ``since_s`` (by default: the current service day) and
    overwrite exactly these blocks.  Re-running it, or running it after a
    failure, writes the same rows; blocks it does not score stay.  With
    ``publish`` the run and its report sums appear at once, in one version of
    the table (see ``accuracy``); without, partition by partition."""
    since = service_day_start(now_s - VISIBILITY_LAG_S) if since_s is None else since_s
    since -= since % BLOCK_S  # whole blocks only: a block is replaced as a whole
    predictions = stored_predictions(spark, predictions_path, since, now_s)
    transitions = stored_transitions(spark, transitions_path, since - MAX_DWELL_S - TERMINAL_MATCH_WINDOW_S, now_s)
    acc = score_closed_blocks(transitions, predictions, now_s, since_s=since)
    if publish:
        publish_accuracy(spark, acc, out_path)
    else:
        write_accuracy(acc, out_path)


def run_matching(spark: SparkSession, transitions_path: str, predictions_path: str, events_path: str, matches_path: str,
                 first: _dt.date, last: _dt.date, rejects_path: str | None = None) -> dict[str, int]:
    """Store the vehicle events that arrive, and the matches of the predictions
    filed, on the UTC dates ``first`` to ``last``: each date's partition is
    written anew.  Transitions are read for as long before and after as a dwell
    or a match can reach, so days may be run one by one in any order.

    Arrivals that make no event are stored at ``rejects_path`` with what they
    lack; how many arrivals were stored and rejected is returned, counted while
    they are written."""
    day = lambda d: int(_dt.datetime.combine(d, _dt.time(), _dt.timezone.utc).timestamp())
    lo, hi = day(first), day(last + _dt.timedelta(days=1))
    reach = 2 * MAX_DWELL_S + TERMINAL_MATCH_WINDOW_S
    t = stored_transitions(spark, transitions_path, lo - reach, hi + reach).filter(F.col("transition") != "dropped")
    t = t.filter((F.col("snapshot_time") >= lo - reach) & (F.col("snapshot_time") < hi + reach))
    events = E.vehicle_events(t)
    p = stored_predictions(spark, predictions_path, lo, hi)
    filed = p.select(F.col("id").alias("prediction_id"), F.to_date(epoch_to_utc_ntz("file_timestamp")).alias("file_date"))
    matches = M.match_all(p, E.event_touches(events)).join(filed, "prediction_id")
    own = events.filter((F.col("arrival_snapshot") >= lo) & (F.col("arrival_snapshot") < hi))
    own = own.withColumn("event_date", F.to_date(epoch_to_utc_ntz("arrival_snapshot")))
    rejected = E.rejected_arrivals(t.filter((F.col("snapshot_time") >= lo) & (F.col("snapshot_time") < hi)))
    rejected = rejected.withColumn("event_date", F.to_date(epoch_to_utc_ntz("arrival_snapshot")))
    seen = {"stored": Observation(), "rejected": Observation()}
    tables = [(own.observe(seen["stored"], F.count(F.lit(1)).alias("n")), "event_date", events_path), (matches, "file_date", matches_path)]
    if rejects_path:
        tables.append((rejected.observe(seen["rejected"], F.count(F.lit(1)).alias("n")), "event_date", rejects_path))
    for rows, key, path in tables:
        out = rows.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(key).parquet(path)
    return {what: o.get["n"] for what, o in seen.items() if what == "stored" or rejects_path}


def service_day_start(epoch_s: int) -> int:
    """Epoch of 03:00 local on the service date holding ``epoch_s``."""
    from zoneinfo import ZoneInfo

    from headway.functions.constants import TIMEZONE

    z = ZoneInfo(TIMEZONE)
    local = _dt.datetime.fromtimestamp(epoch_s, z)
    day = local.date() - _dt.timedelta(days=1) if local.hour < 3 else local.date()
    return int(_dt.datetime.combine(day, _dt.time(3, 0), z).timestamp())


def _horizon(spark: SparkSession, path: str, before: int) -> int | None:
    """The newest file time that the runs before ``before`` had seen."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.schema("now long, epoch long").parquet(path)
    except AnalysisException:  # nothing written yet
        return None
    return done.filter(F.col("epoch") < before).agg(F.max("now")).first()[0]


def start_block_scorer(spark: SparkSession, predictions_path: str, transitions_path: str, out_path: str,
                       checkpoint: str, lag_s: int = VISIBILITY_LAG_S, available_now: bool = True, publish: bool = False):
    """Event-time scoring trigger: each micro-batch of new prediction files
    advances "now" to the newest file time seen.  Scored are all blocks that
    closed since the last run's horizon and all older ones that the batch
    brought predictions for.  The horizon of each run is stored under
    ``checkpoint`` by batch number, so a replayed batch scores the same blocks."""
    schema = spark.read.parquet(predictions_path).schema
    times = spark.readStream.schema(schema).parquet(predictions_path).select("file_timestamp")
    horizons = f"{checkpoint}-horizons"

    def score(batch: DataFrame, epoch_id: int) -> None:
        first, now = batch.agg(F.min("file_timestamp"), F.max("file_timestamp")).first()
        if now is None:
            return
        before = _horizon(spark, horizons, epoch_id)
        # a block is open until block_start + lag, so the first one not yet scored starts after this
        since = first if before is None else min(first, before - lag_s)
        now = max(now, before or now)
        run_scoring(spark, transitions_path, predictions_path, out_path, int(now), int(since), publish)
        done = spark.createDataFrame([(int(now), int(epoch_id))], "now long, epoch long")
        done.write.mode("overwrite").parquet(f"{horizons}/batch={epoch_id}")

    w = times.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()
