"""Retention, weekly partitioning, windowed backfill and reconciliation.

Tables are Parquet datasets; stored ones are pruned by dropping the folders of
expired dates, and "partitions" are a derived ``week_start`` column used with
``partitionBy``, so a new week needs no DDL.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.constants import MATTAPAN_MAX_DWELL_S, MAX_DWELL_S, PRUNE_LOOKBACK_S
from headway.functions.times import week_label, week_start


def prune_predictions(predictions: DataFrame, as_of: int, lookback_s: int = PRUNE_LOOKBACK_S) -> DataFrame:
    """Rows kept by the retention job: file time not before as_of - lookback."""
    return predictions.filter(F.col("file_timestamp") >= as_of - lookback_s)


def prune_events(events: DataFrame, as_of: int, lookback_s: int = PRUNE_LOOKBACK_S) -> DataFrame:
    """Events are kept a longest dwell longer; an open record without an
    arrival time is never pruned."""
    cutoff = as_of - lookback_s - max(MAX_DWELL_S, MATTAPAN_MAX_DWELL_S)
    return events.filter(F.col("arrival_time").isNull() | (F.col("arrival_time") >= cutoff))


def expired_folders(spark: SparkSession, path: str, column: str, cutoff_s: int, slack_s: int = 0) -> list[str]:
    """The ``column=date`` folders, at any depth of one or two below ``path``, whose UTC day ended ``slack_s`` before ``cutoff_s``."""
    fs = spark._jvm.org.apache.hadoop.fs
    out = []
    for pattern in (f"{path}/{column}=*", f"{path}/*/{column}=*"):
        p = fs.Path(pattern)
        for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
            name = s.getPath().toString()
            day = name.rsplit("=", 1)[1]
            if day.startswith("__HIVE"):  # rows without a date are never pruned
                continue
            end = _dt.datetime.combine(_dt.date.fromisoformat(day), _dt.time(), _dt.timezone.utc).timestamp() + 86400
            if end + slack_s <= cutoff_s:
                out.append(name)
    return sorted(out)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for f in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def prune_stored_predictions(spark: SparkSession, path: str, as_of: int, lookback_s: int = PRUNE_LOOKBACK_S) -> list[str]:
    """Drop the ``file_date`` folders of which ``prune_predictions`` would keep no row.  No row is read: those of the
    cutoff's own day go with their day."""
    folders = expired_folders(spark, path, "file_date", as_of - lookback_s)
    _delete(spark, folders)
    return folders


def prune_stored_events(spark: SparkSession, path: str, as_of: int, lookback_s: int = PRUNE_LOOKBACK_S) -> list[str]:
    """Drop the ``event_date`` folders that hold only events which ``prune_events`` would drop.

    An event's day is that of its arrival's snapshot, so a day has another day
    of grace for the vehicle's own clock.  A folder with an open record, which
    has no arrival time, stays; to find them only that column is read, of the
    expired folders alone."""
    cutoff = as_of - lookback_s - max(MAX_DWELL_S, MATTAPAN_MAX_DWELL_S)
    folders = expired_folders(spark, path, "event_date", cutoff, slack_s=86400)
    if not folders:
        return []
    rows = spark.read.option("basePath", path).parquet(*folders)
    kept = rows.filter(F.col("arrival_time").isNull() | (F.col("arrival_time") >= cutoff)).select("event_date").distinct().collect()  # a row a day
    stay = {str(r.event_date) for r in kept}
    gone = [f for f in folders if f.rsplit("=", 1)[1] not in stay]
    _delete(spark, gone)
    return gone


def with_week_partition(acc: DataFrame) -> DataFrame:
    """Add ``week_start`` (Monday) and the partition label ``week_of_YYYY_MM_DD``."""
    return acc.withColumn("week_start", week_start("service_date")).withColumn("week_label", week_label("service_date"))


def next_partition(today: _dt.date) -> tuple[_dt.date, _dt.date, str]:
    """The weekly job creates the partition of the week after the current one:
    [Monday + 7, Monday + 14) and its label."""
    lo = today - _dt.timedelta(days=today.weekday()) + _dt.timedelta(days=7)
    return lo, lo + _dt.timedelta(days=7), lo.strftime("week_of_%Y_%m_%d")


def write_accuracy(acc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by week, service date and, if ``acc`` has it, the
    block's start; rows clustered by (route, environment) in each file so
    min/max statistics prune like the composite index did.

    Dynamic partition overwrite replaces only the partitions present in
    ``acc``: a scoring run that passes ``block_start`` rewrites exactly the
    blocks it scored and leaves every other block of the day alone.  The rows
    are spread by a rebalance on the partition columns, which adaptive
    execution splits where a partition is large."""
    keys = ["week_start", "service_date"] + (["block_start"] if "block_start" in acc.columns else [])
    (
        with_week_partition(acc)
        .drop("week_label")
        .hint("rebalance", *keys)
        .sortWithinPartitions(*keys, "route_id", "environment")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def backfill_window(first_date: _dt.date, today: _dt.date, days: int = 7, min_days_in_past: int = 3):
    """Copy window [first, first + days - 1]; it is skipped (cursor unchanged)
    while its last date is fewer than ``min_days_in_past`` days before today."""
    last = first_date + _dt.timedelta(days=days - 1)
    if (today - last).days >= min_days_in_past:
        return first_date, last, "copied", last + _dt.timedelta(days=1)
    return first_date, last, "skipped", first_date


def backfill_copy(source: DataFrame, first_date: _dt.date, last_date: _dt.date) -> DataFrame:
    """Rows one backfill run copies (inclusive service-date range)."""
    return source.filter(F.col("service_date").between(F.lit(first_date), F.lit(last_date)))


def final_copy(source: DataFrame, cursor: _dt.date) -> DataFrame:
    """Rows the finalising copy moves: every service date from the cursor on
    (the windows before it were copied by the backfill runs)."""
    rows = source.filter(F.col("service_date") >= F.lit(cursor))
    if "week_start" in source.columns:
        rows = rows.filter(F.col("week_start") >= F.lit(cursor - _dt.timedelta(days=cursor.weekday())))
    return rows


def earliest_service_date(acc: DataFrame) -> DataFrame:
    """One row; of a table partitioned by week only the first week is read."""
    if "week_start" in acc.columns:
        first = acc.agg(F.min("week_start")).first()[0]  # partition values only
        acc = acc.filter(F.col("week_start") == F.lit(first))
    return acc.agg(F.min("service_date").alias("first_service_date"))


def backfill_run(source: DataFrame, cursor: _dt.date, today: _dt.date) -> tuple[DataFrame, DataFrame]:
    """One run of the windowed copy from ``cursor``: the rows to copy (an
    inclusive week, pruned through the week partition column when present)
    and a one-row report (first, last, status, next cursor, rows copied)."""
    first, last, status, nxt = backfill_window(cursor, today)
    rows = backfill_copy(source, first, last) if status == "copied" else source.filter(F.lit(False))
    if "week_start" in source.columns:
        lo = first - _dt.timedelta(days=first.weekday())
        rows = rows.filter((F.col("week_start") >= F.lit(lo)) & (F.col("week_start") <= F.lit(last)))
    report = rows.agg(F.count(F.lit(1)).alias("rows_copied")).select(
        F.lit(first).alias("first_service_date"),
        F.lit(last).alias("last_service_date"),
        F.lit(status).alias("status"),
        F.lit(nxt).alias("next_cursor"),
        "rows_copied",
    )
    return rows, report


def date_digests(copy: DataFrame, key: str = "id") -> DataFrame:
    """One row for each service date: the number of rows, and order-free digests of their keys."""
    h = F.xxhash64(key)
    return copy.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(key).isNull()).alias("no_key"),
        F.bit_xor(h).alias("xor"),
        F.sum(F.pmod(F.xxhash64(h, F.lit("sum")), F.lit(1 << 31))).alias("sum"),
    )


def differing_dates(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """The service dates on which the copies do not hold the same keys (or hold rows without one)."""
    x, y = date_digests(a, key).alias("x"), date_digests(b, key).alias("y")
    j = x.join(y, F.col("x.service_date").eqNullSafe(F.col("y.service_date")), "full_outer")
    same = F.lit(True)
    for c in ("n", "xor", "sum"):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return j.filter(~same | (F.col("x.no_key") > 0)).select(F.coalesce("x.service_date", "y.service_date").alias("service_date"))


def unmatched_rows(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows present in one copy only, with the side they come from; an id stands once in each copy.

    Only the rows of dates whose digests differ are shuffled into the full
    outer join on the id: of equal copies, none.  The dates are broadcast; there
    is one row for each day of the history."""
    dates = F.broadcast(differing_dates(a, b, key).withColumnRenamed("service_date", "_date"))
    only = lambda t: t.join(dates, F.col("service_date").eqNullSafe(F.col("_date")), "left_semi")
    x = only(a).select(F.col(key).alias("_a"), F.col("service_date").alias("_sa"))
    y = only(b).select(F.col(key).alias("_b"), F.col("service_date").alias("_sb"))
    j = x.join(y, F.col("_a") == F.col("_b"), "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(
        F.when(F.col("_b").isNull(), F.lit("monolithic")).otherwise(F.lit("partitioned")).alias("side"),
        F.coalesce("_a", "_b").alias(key),
        F.coalesce("_sa", "_sb").alias("service_date"),
    )


def reconcile(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Row counts of both copies and, per side, the unmatched count and its
    min / max service date."""
    u = unmatched_rows(a, b, key)
    per_side = u.groupBy("side").agg(
        F.count(F.lit(1)).alias("unmatched"),
        F.min("service_date").alias("min_service_date"),
        F.max("service_date").alias("max_service_date"),
    )
    totals = (
        a.select(F.lit("monolithic").alias("side"))
        .unionByName(b.select(F.lit("partitioned").alias("side")))
        .groupBy("side")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return totals.join(per_side, "side", "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(0)))


def reconcile_by_date(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Unmatched rows per (side, service_date)."""
    return unmatched_rows(a, b, key).groupBy("side", "service_date").agg(F.count(F.lit(1)).alias("unmatched"))


def consolidate_bins(acc: DataFrame) -> DataFrame:
    """Retired bins: drop 8-10 and 10-12 rows, relabel 6-8 as 6-12."""
    return acc.filter(~F.col("bin").isin("8-10 min", "10-12 min")).withColumn(
        "bin", F.when(F.col("bin") == "6-8 min", F.lit("6-12 min")).otherwise(F.col("bin"))
    )
