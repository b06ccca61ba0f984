"""Daily accuracy per subway route and day-over-day drop detection.

The service checks once a day: for each subway route, prod accuracy of
yesterday vs the day before (sum accurate / sum predictions, 0 without
predictions), and alerts when yesterday < previous - 0.1.  Here every day
is checked at once, for the fixed list of routes on the dates present and
the day after each (8 x dates rows), so a day without predictions reads 0.
A day's value is carried to the day after it, so the history is read once
and no window runs over a route's whole history.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import accuracy_ratio
from headway.functions.constants import DROP_THRESHOLD, SUBWAY_ROUTES


def route_daily_accuracy(acc: DataFrame, dates: list[_dt.date] | None = None) -> DataFrame:
    """(route_id, service_date) -> prod accuracy for every subway route on every
    date that has any prod row (or the given dates); 0 when none."""
    prod = acc.filter((F.col("environment") == "prod") & F.col("route_id").isin(SUBWAY_ROUTES))
    if dates is not None:
        prod = prod.filter(F.col("service_date").isin(dates))
    daily = prod.groupBy("route_id", "service_date").agg(
        F.sum("num_predictions").cast("long").alias("num_predictions"),
        F.sum("num_accurate_predictions").cast("long").alias("num_accurate_predictions"),
    )
    day_set = (
        prod.select("service_date").distinct()
        if dates is None
        else acc.sparkSession.createDataFrame([(d,) for d in dates], "service_date date")
    )
    spine = day_set.select("service_date", F.explode(F.array(*[F.lit(r) for r in SUBWAY_ROUTES])).alias("route_id"))
    return spine.join(daily, ["route_id", "service_date"], "left").select(
        "route_id",
        "service_date",
        F.coalesce("num_predictions", F.lit(0)).cast("long").alias("num_predictions"),
        F.coalesce("num_accurate_predictions", F.lit(0)).cast("long").alias("num_accurate_predictions"),
        accuracy_ratio("num_accurate_predictions", "num_predictions").alias("accuracy"),
    )


def accuracy_drops(acc: DataFrame) -> DataFrame:
    """For every subway route and every date D with data on D or D-1:
    yesterday_accuracy = acc(D), previous_day_accuracy = acc(D-1) (0 when a
    day has no prod rows) and ``drop`` = acc(D) < acc(D-1) - 0.1."""
    prod = acc.filter((F.col("environment") == "prod") & F.col("route_id").isin(SUBWAY_ROUTES))
    daily = prod.groupBy("route_id", "service_date").agg(
        accuracy_ratio(F.sum("num_accurate_predictions"), F.sum("num_predictions")).alias("accuracy")
    )
    # each day's value counts for that day and, as the previous one, for the day after: one scan, no self-join
    day, nothing = F.col("service_date"), F.lit(None).cast("double")
    value = F.col("accuracy").cast("double")
    both = daily.select(
        "route_id",
        F.explode(
            F.array(
                F.struct(day.alias("service_date"), value.alias("y"), nothing.alias("p")),
                F.struct(F.date_add(day, 1).alias("service_date"), nothing.alias("y"), value.alias("p")),
            )
        ).alias("d"),
    )
    of = lambda r, c: F.coalesce(F.max(F.when(F.col("route_id") == r, F.col(f"d.{c}"))), F.lit(0.0))
    routes = F.array(
        *[F.struct(F.lit(r).alias("route_id"), of(r, "y").alias("yesterday_accuracy"), of(r, "p").alias("previous_day_accuracy")) for r in SUBWAY_ROUTES]
    )
    days = both.groupBy(F.col("d.service_date").alias("service_date")).agg(routes.alias("routes"))
    j = days.select("service_date", F.explode("routes").alias("r")).select("service_date", "r.*")
    return j.withColumn(
        "drop", F.col("yesterday_accuracy") < F.col("previous_day_accuracy") - F.lit(DROP_THRESHOLD)
    )


def check_accuracy(acc: DataFrame, today_utc: _dt.date) -> DataFrame:
    """The daily check as the service runs it: yesterday vs the day before,
    both taken from the UTC date ``today_utc``."""
    y = today_utc - _dt.timedelta(days=1)
    return accuracy_drops(acc.filter(F.col("service_date").isin([y, y - _dt.timedelta(days=1)]))).filter(
        F.col("service_date") == F.lit(y)
    )
