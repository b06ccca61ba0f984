"""Previous / next element of an ordered sequence without one-task windows.

A window partitioned only by (environment, mode) would put a whole feed's
history into one task.  Instead the lag/lead is taken inside
(keys, day) partitions, and the first/last element of each day is
completed from a per-day summary whose size is days x keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 86400


def neighbors(df: DataFrame, keys: list[str], order_col: str, span_s: int = DAY_S,
              prev_name: str = "prev", next_name: str = "next") -> DataFrame:
    """Add the previous and next distinct value of ``order_col`` within ``keys``.

    ``df`` must hold one row per (keys, order_col)."""
    span = F.col(order_col) - F.pmod(F.col(order_col), F.lit(span_s))
    d = df.withColumn("_span", span)
    w = Window.partitionBy(*keys, "_span").orderBy(order_col)
    d = d.withColumn("_p", F.lag(order_col).over(w)).withColumn("_n", F.lead(order_col).over(w))
    spans = d.groupBy(*keys, "_span").agg(F.min(order_col).alias("_lo"), F.max(order_col).alias("_hi"))
    ws = Window.partitionBy(*keys).orderBy("_span")
    spans = spans.select(
        *keys, "_span",
        F.lag("_hi").over(ws).alias("_prev_hi"),
        F.lead("_lo").over(ws).alias("_next_lo"),
    )
    return (
        d.join(spans, [*keys, "_span"], "left")
        .withColumn(prev_name, F.coalesce("_p", "_prev_hi"))
        .withColumn(next_name, F.coalesce("_n", "_next_lo"))
        .drop("_span", "_p", "_n", "_prev_hi", "_next_lo")
    )
