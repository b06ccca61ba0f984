"""Stop dimension: uniqueness of (description, name, platform) and display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stops_from_feed(docs: DataFrame) -> DataFrame:
    """Stops documents (``STOPS`` schema, one per mode) -> one row per stop."""
    return docs.filter(F.col("data").isNotNull()).select("mode", F.explode("data").alias("s")).select(
        F.col("s.id").alias("id"),
        "mode",
        F.col("s.attributes.name").alias("name"),
        F.col("s.attributes.platform_name").alias("platform_name"),
        F.col("s.attributes.description").alias("description"),
    )


def with_unique_info(stops: DataFrame) -> DataFrame:
    """``unique_info``: no other stop of the mode has the same (description,
    name, platform_name); nulls compare equal.  The window partition is one
    such triple, bounded by the stop dimension."""
    w = Window.partitionBy("mode", "description", "name", "platform_name")
    return stops.withColumn("unique_info", F.count(F.lit(1)).over(w) == 1)


def display_name(stops_with_info: DataFrame) -> DataFrame:
    """Station label: ``name`` or ``name (platform)``, plus `` - id`` when the
    triple is not unique."""
    base = F.when(F.col("platform_name").isNull(), F.col("name")).otherwise(
        F.concat(F.col("name"), F.lit(" ("), F.col("platform_name"), F.lit(")"))
    )
    return stops_with_info.withColumn(
        "display_name", F.when(F.col("unique_info"), base).otherwise(F.concat(base, F.lit(" - "), F.col("id")))
    )


def stop_dim(stops: DataFrame) -> DataFrame:
    return display_name(with_unique_info(stops))


def station_names(keys: DataFrame, dim: DataFrame, stop_col: str = "stop_id") -> DataFrame:
    """Attach display names; an unknown stop id shows as itself."""
    d = dim.select(F.col("id").alias("_id"), F.col("mode").alias("_mode"), "display_name")
    j = keys.join(d, (F.col(stop_col) == F.col("_id")) & (F.col("_mode") == "subway"), "left")
    return j.withColumn("station_name", F.coalesce("display_name", F.col(stop_col))).drop("_id", "_mode", "display_name")
