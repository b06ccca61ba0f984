"""Report statistics over prediction_accuracy.

Accuracy rows are pooled: counts are summed, mean error and RMSE are
weighted by num_predictions.  The report's six per-environment queries
(three environments x {context, breakdown}) become one grouped pass each,
with environment as a grouping key; cross-environment alignment is a
conditional aggregation, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import (
    accuracy_percentage,
    accuracy_ratio,
    hh_mm,
    pooled_mean_error,
    pooled_rmse,
    resolution_bucket,
    round_or_zero,
)
from headway.functions.constants import ENVIRONMENTS

SCOPES = {"Hourly": ["hour_of_day"], "Daily": ["service_date"], "By Station": ["stop_id"]}


def scope_columns(chart_range: str, resolution: str | int | None = None) -> list[Column]:
    if chart_range == "Hourly" and resolution not in (None, "60", 60):
        return [F.col("hour_of_day"), resolution_bucket("minute_of_hour", int(resolution)).alias("resolution_bucket")]
    return [F.col(c) for c in SCOPES[chart_range]]


def pooled_aggs() -> list[Column]:
    return [
        F.sum("num_predictions").cast("long").alias("num_predictions"),
        F.sum("num_accurate_predictions").cast("long").alias("num_accurate_predictions"),
        pooled_mean_error().alias("mean_error"),
        pooled_rmse().alias("root_mean_squared_error"),
    ]


def stats_by_chart_range(acc: DataFrame, chart_range: str, resolution=None, extra_keys: list[str] | None = None) -> DataFrame:
    """(environment, scope) -> pooled counts / errors, ordered by scope."""
    keys = [F.col("environment"), *[F.col(k) for k in (extra_keys or [])], *scope_columns(chart_range, resolution)]
    names = ["environment", *(extra_keys or []), *[c for c in _names(chart_range, resolution)]]
    return acc.groupBy(*keys).agg(*pooled_aggs()).orderBy(*names[1:], "environment")


def _names(chart_range: str, resolution) -> list[str]:
    if chart_range == "Hourly" and resolution not in (None, "60", 60):
        return ["hour_of_day", "resolution_bucket"]
    return SCOPES[chart_range]


def accuracy_context(acc: DataFrame) -> DataFrame:
    """Ungrouped totals per environment (sum accurate, sum n, pooled errors)."""
    return acc.groupBy("environment").agg(*pooled_aggs())


def env_comparison(acc: DataFrame, chart_range: str, resolution=None) -> DataFrame:
    """One row per scope with every environment side by side; an environment
    without rows for that scope reads (0, 0, null, null)."""
    scope = scope_columns(chart_range, resolution)
    aggs = []
    for env in ENVIRONMENTS:
        p = env.replace("-", "_")
        is_env = F.col("environment") == env
        n = F.when(is_env, F.col("num_predictions"))
        aggs += [
            F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"{p}_num_predictions"),
            F.coalesce(F.sum(F.when(is_env, F.col("num_accurate_predictions"))), F.lit(0)).cast("long").alias(f"{p}_num_accurate"),
            F.try_divide(F.sum(F.when(is_env, F.col("mean_error") * F.col("num_predictions"))), F.sum(n)).alias(f"{p}_mean_error"),
            F.sqrt(
                F.try_divide(F.sum(F.when(is_env, F.pow(F.col("root_mean_squared_error"), 2) * F.col("num_predictions"))), F.sum(n))
            ).alias(f"{p}_rmse"),
        ]
    return acc.filter(F.col("environment").isin(ENVIRONMENTS)).groupBy(*scope).agg(*aggs).orderBy(*_names(chart_range, resolution))


def scope_label(chart_range: str, resolution=None, station_names: DataFrame | None = None) -> Column:
    if chart_range == "Hourly" and resolution not in (None, "60", 60):
        return hh_mm("hour_of_day", "resolution_bucket")
    if chart_range == "Daily":
        return F.date_format("service_date", "yyyy-MM-dd")
    if chart_range == "By Station" and station_names is not None:
        return F.coalesce(F.col("station_name"), F.col("stop_id"))
    return F.col(_names(chart_range, resolution)[0]).cast("string")


def export_rows(acc: DataFrame, chart_range: str, resolution=None, station_names: DataFrame | None = None) -> DataFrame:
    """CSV rows of the prod breakdown: <chart range>, Prod Accuracy, Err, RMSE, Count."""
    s = stats_by_chart_range(acc.filter(F.col("environment") == "prod"), chart_range, resolution)
    if chart_range == "By Station" and station_names is not None:
        s = s.join(station_names.select(F.col("stop_id"), F.col("station_name")), "stop_id", "left")
    return s.select(
        *[F.col(c) for c in _names(chart_range, resolution)],
        scope_label(chart_range, resolution, station_names).alias(chart_range),
        accuracy_percentage("num_accurate_predictions", "num_predictions").alias("Prod Accuracy"),
        round_or_zero("mean_error", 0).alias("Err"),
        round_or_zero("root_mean_squared_error", 0).alias("RMSE"),
        F.col("num_predictions").alias("Count"),
    ).orderBy(*_names(chart_range, resolution))


def write_csv(rows: DataFrame, path: str, chart_range: str) -> None:
    """CSV sink with the report header."""
    rows.select(chart_range, "Prod Accuracy", "Err", "RMSE", "Count").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def accuracy_series(acc: DataFrame, chart_range: str, resolution=None) -> DataFrame:
    """Chart data in long form: (scope, environment, accuracy ratio), zero when
    an environment has no predictions for the scope.  One aggregation; the
    wide row is turned into three long rows with ``inline``."""
    wide = env_comparison(acc, chart_range, resolution)
    names = _names(chart_range, resolution)
    per_env = []
    for env in ENVIRONMENTS:
        p = env.replace("-", "_")
        per_env.append(
            F.struct(
                F.lit(env).alias("environment"),
                accuracy_ratio(f"{p}_num_accurate", f"{p}_num_predictions").alias("accuracy"),
            )
        )
    return wide.select(*names, F.inline(F.array(*per_env)))


def stations_by_accuracy(acc: DataFrame) -> DataFrame:
    """Stations ordered by prod accuracy, then dev-green accuracy (numerically)."""
    wide = env_comparison(acc, "By Station")
    return wide.select(
        "stop_id",
        accuracy_ratio("prod_num_accurate", "prod_num_predictions").alias("prod_accuracy"),
        accuracy_ratio("dev_green_num_accurate", "dev_green_num_predictions").alias("dev_green_accuracy"),
        accuracy_ratio("dev_blue_num_accurate", "dev_blue_num_predictions").alias("dev_blue_accuracy"),
    ).orderBy("prod_accuracy", "dev_green_accuracy", "stop_id")


def accuracy_report(acc: DataFrame, params: dict) -> tuple[DataFrame, DataFrame, str | None]:
    """One accuracy-report request: filters, then the environments side by side
    per scope (hour, hour+sub-hour bucket, day or station) and the ungrouped
    totals per environment.  A bad parameter gives empty frames and the
    message, like the report page."""
    from headway.operators.filters import filter_accuracy

    q, err = filter_accuracy(acc, params)
    chart_range = params.get("chart_range") or "Hourly"
    if chart_range not in SCOPES:
        chart_range = "Hourly"
    breakdown = env_comparison(q, chart_range, params.get("timeframe_resolution"))
    return breakdown, accuracy_context(q), err
