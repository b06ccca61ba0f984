"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns.

1. Documents with the same set of sources (their membership pattern) are alike
   to the mix, so they are summed: words by pattern, and words by source.
2. A source's target is its weight's share of the whole budget, but no more
   than ``repeats`` times its size; what is cut off goes to the others by
   weight, until none is above.
3. Words flow from patterns to the sources they belong to.  A pattern's words
   may be taken ``repeats`` times, and each further copy costs more than the
   one before, so it is a convex cost.  With these costs the flow that meets
   all targets at least cost is found by augmenting paths with one copy's
   capacity first and raising it copy by copy: an augmenting path never takes
   words back from a pattern, only moves them to another of its sources.
   Patterns and sources that no document connects are flows of their own,
   which Spark deals out.
4. A pattern's flow is so many whole copies of all its documents and a rest.
   The rest is a prefix of its documents in a seeded order, by a running sum
   over range partitions, and two more documents: the largest that what then
   lacks has room for, and that which comes nearest to what still lacks.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ranks import numbered
from .tables import small_batches, stored

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
SHARE = 1.5
REPEATS = 2
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: str, doc_id: Column) -> Column:
    """Place of a document in the seeded order: 60 bits of a digest of seed and id."""
    told = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, total: int, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, size) with ``s`` (the source's number), ``weight`` and ``target``.

    The driver sees two sums a round; a round ends with more sources at their
    stop than the one before."""
    s = numbered(stored(sizes, "sizes"), [F.col("source").asc_nulls_last()], "sources").withColumnRenamed("ordinal", "s")
    s = stored(s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))), "weights")
    level, stops, found = 0.0, 0, -1
    while True:
        stop = F.col("weight") * F.lit(level) > repeats * F.col("size")
        full = F.coalesce(F.sum(F.when(stop, repeats * F.col("size"))), F.lit(0)).alias("full")
        stops, full, rest = s.agg(F.count_if(stop), full, F.sum(F.when(~stop, F.col("weight")))).first()
        if stops == found or not rest:
            break
        found, level = stops, max(share * total - full, 0.0) / rest
    target = F.least(F.col("weight") * F.lit(level), (repeats * F.col("size")).cast("double"))
    return s.withColumn("target", target)


def flow(arcs: list[tuple[int, int, int, int]], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Words by (pattern, source) of arcs (pattern, its words, source, the source's quota): the most that the quotas take, at
    least repetition."""
    cap = {p: c for p, c, _, _ in arcs}
    quota = {s: q for _, _, s, q in arcs}
    to, by = {}, {}
    for p, _, s, _ in arcs:
        to.setdefault(p, []).append(s)
        by.setdefault(s, []).append(p)
    x = dict.fromkeys(((p, s) for p, _, s, _ in arcs), 0)
    used, got = dict.fromkeys(cap, 0), dict.fromkeys(quota, 0)
    for copy in range(1, repeats + 1):
        while True:
            # breadth first: from patterns with words left, over sources, back over what flows there already
            came = {("p", p): None for p in cap if used[p] < copy * cap[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, v = queue.popleft()
                near = [("s", s) for s in to[v]] if kind == "p" else [("p", p) for p in by[v] if x[p, v]]
                for n in near:
                    if n not in came:
                        came[n] = (kind, v)
                        queue.append(n)
                        if n[0] == "s" and got[n[1]] < quota[n[1]]:
                            end = n
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            first = path[0][1]
            amount = min(copy * cap[first] - used[first], quota[end[1]] - got[end[1]])
            steps = list(zip(path, path[1:]))
            amount = min([amount, *(x[b[1], a[1]] for a, b in steps if a[0] == "s")])
            for a, b in steps:
                if a[0] == "p":
                    x[a[1], b[1]] += amount
                else:
                    x[b[1], a[1]] -= amount
            used[first] += amount
            got[end[1]] += amount
    return x


def routed(arcs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``(pattern, s, words)`` of arcs ``(pattern, cap, s, quota)``: the least-cost flow of each connected part.

    What meets in one task are the distinct patterns and sources of one part,
    never documents."""
    first = arcs.groupBy("pattern").agg(F.min("s").alias("a"))
    part = components(arcs.join(first, "pattern").select("a", F.col("s").alias("b")))
    arcs = arcs.join(part.withColumnRenamed("node", "s"), "s", "left").withColumn("part", F.coalesce("root", "s"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x = flow(list(rows[["pattern", "cap", "s", "quota"]].itertuples(index=False, name=None)), repeats)
        return pd.DataFrame([(p, s, n) for (p, s), n in x.items()], columns=["pattern", "s", "words"])

    return arcs.select("part", "pattern", "cap", "s", "quota").groupBy("part").applyInPandas(solve, "pattern long, s long, words long")


def mixed(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS,
          share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, size, members, taken)`` for every row of ``docs``, and ``(source, size, target, words)`` of the sources.

    ``members`` is an array of the sources that a document belongs to; null is a
    source of its own.  A document of no source is not taken; a null text has
    no words.  Rows with one id are documents of their own; among equal ones it
    makes no difference which are taken.  Where sources overlap so much that
    their documents cannot meet all targets, the flow is as large as it can be,
    and ``words`` says what each source got."""
    small_batches(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.array_sort(F.array_distinct(members.cast("array<string>"))).alias("members"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "measured")
    patterns = stored(rows.groupBy("members").agg(F.sum("size").alias("cap"), F.min("row").alias("pattern")), "patterns")
    total = patterns.agg(F.sum("cap")).first()[0] or 0
    of = patterns.select("pattern", "cap", F.explode("members").alias("source"))
    goal = stored(targets(of.groupBy("source").agg(F.sum("cap").alias("size")), total, weights, share, repeats), "targets")
    arcs = of.join(goal.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select("pattern", "cap", "s", F.floor(F.col("target") + 0.5).alias("quota"))
    moved = stored(routed(stored(arcs, "arcs"), repeats), "flow")

    plan = patterns.join(moved.groupBy("pattern").agg(F.sum("words").alias("words")), "pattern", "left")
    words = F.coalesce("words", F.lit(0))
    plan = plan.select("members", "pattern", F.expr("if(cap > 0, {0} div cap, 0)".format("coalesce(words, 0)")).alias("copies"), F.when(F.col("cap") > 0, words % F.col("cap")).otherwise(0).alias("rest"))
    plan = stored(plan, "plan")
    # only patterns of which a part of a copy is taken are put in order
    some = rows.withColumn("key", seeded(seed, F.col("doc_id"))).join(plan.where("rest > 0"), "members").select("pattern", "key", "size", "row", "rest")
    some = numbered(some, ["pattern", "key", "size", "row"], "seeded", weight="size")
    start = stored(some.groupBy("pattern").agg(F.min("before").alias("start")), "starts")
    some = some.join(start, "pattern").withColumn("end", F.col("before") - F.col("start") + F.col("size"))
    some = some.withColumn("inside", F.col("end") <= F.col("rest"))
    lacks = F.max("rest") - F.coalesce(F.max(F.when(F.col("inside"), F.col("end"))), F.lit(0))
    lacks = stored(some.groupBy("pattern").agg(lacks.alias("lacks")).where("lacks > 0"), "lacks")
    out_of = stored(some.where(~F.col("inside")).select("pattern", "ordinal", "row", "size"), "left-out")
    off = F.abs(F.col("size") - F.col("lacks"))
    near = lambda lacks, ok: out_of.join(lacks, "pattern").where(ok).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "ordinal", "size", "row")).alias("f"))
    fits = stored(near(lacks, F.col("size").between(1, F.col("lacks"))), "fits")
    lacks = lacks.join(fits, "pattern", "left").select("pattern", F.coalesce("f.off", "lacks").alias("lacks"), F.col("f.ordinal").alias("taken"))
    last = near(lacks, (off < F.col("lacks")) & ~F.col("ordinal").eqNullSafe(F.col("taken")))
    more = some.where("inside").select("row").unionByName(fits.select("f.row")).unionByName(last.select("f.row"))
    more = stored(more.withColumn("more", F.lit(1)), "more")

    out = rows.alias("r").join(plan.alias("p"), F.col("r.members").eqNullSafe(F.col("p.members"))).select("r.*", "p.copies").join(more, "row", "left")
    out = out.select("doc_id", "size", "members", (F.col("size") * (F.col("copies") + F.coalesce("more", F.lit(0)))).alias("taken"))
    got = moved.groupBy("s").agg(F.sum("words").alias("words"))
    return out, goal.join(got, "s", "left").select("source", "size", "target", F.coalesce("words", F.lit(0)).alias("words"))


def source_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``, each a member of its one source."""
    out, goal = mixed(docs, F.array(F.col(source_col)), id_col, text_col)
    goal = goal.select("source", F.col("size").alias("source_size"), "target")
    out = out.withColumn("of", F.element_at("members", 1)).join(goal, F.col("of").eqNullSafe(F.col("source")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SOURCE_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, sum(size) AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, row_number() OVER o AS n, (1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY size / w::DOUBLE, source NULLS LAST)
), t AS (
  SELECT source, size AS source_size,
         least(w * (SELECT level FROM c WHERE level * w <= 2 * size ORDER BY n LIMIT 1), 2.0::DOUBLE * size) AS target
  FROM s
), q AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS quota
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS copies,
         CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS stop
  FROM q
), l AS (SELECT *, max(rest) OVER p - coalesce(max(stop) FILTER (stop <= rest) OVER p, 0) AS lacks FROM r WINDOW p AS (PARTITION BY source)),
f AS (
  SELECT *, stop > rest AND lacks > 0 AND size BETWEEN 1 AND lacks
            AND row_number() OVER (PARTITION BY source, stop > rest AND size BETWEEN 1 AND lacks ORDER BY size DESC, key, doc_id) = 1 AS one
  FROM l
), g AS (SELECT *, lacks - coalesce(max(size) FILTER (one) OVER (PARTITION BY source), 0) AS still FROM f),
h AS (
  SELECT *, stop > rest AND NOT one AND abs(size - still) < still
            AND row_number() OVER (PARTITION BY source, stop > rest AND NOT one ORDER BY abs(size - still), key, size, doc_id) = 1 AS two
  FROM g
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (copies + CASE WHEN one OR two OR stop <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h
"""
