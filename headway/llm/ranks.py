"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: 33 bits of row in partition


def numbered(rows: DataFrame, order: list, name: str, weight: str | None = None) -> DataFrame:
    """``rows`` with ``ordinal``, the number from 0 of the row in ``order``, and with ``weight`` also ``before``, the summed weight of the rows before it.

    A range partitioning sorts the rows; what precedes a partition is summed
    over one row for each partition.  ``order`` should tell all rows apart (add
    a stored row number), since equal ones cannot be dealt out to several
    tasks."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = stored(part.withColumn("__at", F.monotonically_increasing_id()), name)
    part = part.withColumn("__p", F.shiftright("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND(_IN_PARTITION))
    sums = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *([F.sum(weight).alias("__w")] if weight else []))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    told = [("__n", "__n0"), *([("__w", "__w0")] if weight else [])]
    sums = sums.select("__p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(to) for c, to in told])
    out = part.join(sums, "__p").withColumn("ordinal", F.col("__n0") + F.col("__i"))
    if weight:
        inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("__w0") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("__at", "__p", "__i", *[to for _, to in told])
