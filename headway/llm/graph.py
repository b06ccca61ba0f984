"""Connected components of a link table as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the smallest node reachable.

    Alternating large-star and small-star rounds (each one grouped minimum and
    one join) until the links no longer change: a logarithmic number of rounds
    even on long chains.  Every round is a stored table; nothing reaches the
    driver but a row count and a checksum.  The joins are on the node, with
    Spark free to split a hub's rows.  Null nodes are ignored; repeated links
    and self-links do no harm; an empty table gives an empty result.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v")
    e = stored(e.distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stored(small.select("x.u", "x.v").where("u != v").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    kids = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return kids.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
