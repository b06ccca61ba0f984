"""The accuracy table as scoring runs publish it, with report sums kept beside.

A run replaces the blocks that it scored: their hours are written anew, with the
other blocks of the hour as they were.  In the same version the sums of the days
change by what the new rows add and the old ones took, so a report over months
reads sums, not blocks, and a reader never sees rows and sums that differ.

Pooled figures are sums of n, n * error and n * rmse^2; these are kept as
decimals, so adding and taking away is exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.times import week_start
from headway.operators import scoring as S
from headway.streaming.published import Published, Version

WRITER = "scoring"
HOUR_S = 3600
KEYS = ["environment", "hour_of_day", "route_id", "stop_id", "direction_id", "bin", "kind", "in_next_two"]
SUMS = ["num_predictions", "num_accurate_predictions", "known", "error", "square"]
ROWS_SCHEMA = (
    "environment string, hour_of_day int, minute_of_hour int, route_id string, stop_id string, direction_id int, bin string, kind string, "
    "in_next_two boolean, num_predictions int, num_accurate_predictions int, mean_error double, root_mean_squared_error double, block_start long, "
    "service_date date, block_hour long"
)
SUMS_SCHEMA = (
    "environment string, hour_of_day int, route_id string, stop_id string, direction_id int, bin string, kind string, in_next_two boolean, "
    "num_predictions long, num_accurate_predictions long, known long, error decimal(38,6), square decimal(38,6), service_date date"
)
_ROWS = [f.split()[0] for f in ROWS_SCHEMA.split(", ")]
_SUMS = [*KEYS, *SUMS, "service_date"]


def sums_of(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The mergeable sums of accuracy rows, by day and report keys; ``sign`` -1 for rows that are taken away."""
    n = F.col("num_predictions")
    exact = lambda x: F.coalesce(F.sum(x.cast("decimal(28,6)")), F.lit(0)) * sign
    return rows.groupBy("service_date", *KEYS).agg(
        (F.sum(n.cast("long")) * sign).alias("num_predictions"),
        (F.coalesce(F.sum(F.col("num_accurate_predictions").cast("long")), F.lit(0)) * sign).alias("num_accurate_predictions"),
        (F.count_if(F.col("mean_error").isNotNull()) * sign).alias("known"),
        exact(n * F.col("mean_error")).cast("decimal(38,6)").alias("error"),
        exact(n * F.pow("root_mean_squared_error", F.lit(2))).cast("decimal(38,6)").alias("square"),
    )


def merged(*sums: DataFrame) -> DataFrame:
    """One row for each key; keys that no row is left of are gone."""
    out = sums[0].select(_SUMS)
    for s in sums[1:]:
        out = out.unionByName(s.select(_SUMS))
    total = [F.sum(c).cast("decimal(38,6)" if c in ("error", "square") else "long").alias(c) for c in SUMS]
    return out.groupBy("service_date", *KEYS).agg(*total).filter(F.col("num_predictions") != 0)


def publish_accuracy(spark: SparkSession, acc: DataFrame, root: str) -> Version:
    """Replace the blocks of ``acc`` (rows of ``scoring.score``) in the table at ``root``, and bring its sums up to date.

    Rows that the insert check refuses (``scoring.validate_accuracy``) are kept
    in the table ``rejected``.  A run that is repeated, or was killed, does no harm; of two runs that score
    the same hour at once the second to publish fails."""
    p = Published(spark, root)
    base = p.latest()
    new = acc.withColumn("block_hour", F.col("block_start") - F.pmod("block_start", F.lit(HOUR_S))).select(_ROWS).persist()
    # partition names of the scored hours and days: a few for a run
    hours = {f"service_date={r.service_date}/block_hour={r.block_hour}" for r in new.select("service_date", "block_hour").distinct().collect()}
    days = {h.split("/")[0] for h in hours}
    new = S.validate_accuracy(new)
    blocks = new.select("service_date", "block_start").distinct()
    replace = {}
    for table, of in (("rows", F.col("is_valid")), ("rejected", ~F.col("is_valid"))):
        mine = new.filter(of).drop("is_valid")
        old = p.read(table, ROWS_SCHEMA, base, keep=hours.__contains__)
        gone = old.join(blocks, ["service_date", "block_start"], "left_semi")
        stay = old.join(blocks, ["service_date", "block_start"], "left_anti")
        rows = mine.unionByName(stay.select(_ROWS)).repartition("service_date", "block_hour").sortWithinPartitions("service_date", "block_hour", "route_id", "environment")
        # hours that nothing is left of have no folder
        replace[table] = {h: [] for h in hours if h in base.tables.get(table, {})} | p.write(rows, table, ["service_date", "block_hour"])
        if table == "rows":
            sums = merged(p.read("sums", SUMS_SCHEMA, base, keep=days.__contains__), sums_of(mine), sums_of(gone, -1))
            replace["sums"] = {d: [] for d in days if d in base.tables.get("sums", {})} | p.write(sums.repartition("service_date"), "sums", ["service_date"])
    new.unpersist()
    return p.commit(base, replace=replace, writer=WRITER, batch=base.writers.get(WRITER, 0) + 1)


def accuracy(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The blocks' rows, with the week that the report filters bound."""
    return Published(spark, root).read("rows", ROWS_SCHEMA, version).drop("block_hour").withColumn("week_start", week_start("service_date"))


def rejected(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The rows that were scored and not stored."""
    return Published(spark, root).read("rejected", ROWS_SCHEMA, version).drop("block_hour")


def report_rows(spark: SparkSession, root: str, first=None, last=None) -> DataFrame:
    """Rows for the hourly, daily and station reports of the service dates ``first`` to ``last``, one for each hour and key
    instead of one for each block: ``stats.stats_by_chart_range`` gives the same of them."""
    keep = lambda q: (first is None or q >= f"service_date={first}") and (last is None or q <= f"service_date={last}")
    s = Published(spark, root).read("sums", SUMS_SCHEMA, keep=keep)
    n = F.col("num_predictions")
    known = F.col("known") > 0
    return s.select(
        *KEYS, "service_date", "num_predictions", "num_accurate_predictions",
        F.when(known, F.col("error").cast("double") / n).alias("mean_error"),
        F.when(known, F.sqrt(F.col("square").cast("double") / n)).alias("root_mean_squared_error"))
