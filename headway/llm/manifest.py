"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

Every row is a leaf: the SHA-256 of its fields.  The leaves of one group (a
source), in order, are hashed in runs of ``FAN`` until one digest is left, the
group's subroot; the subroots, in order of the groups, likewise give the root.
What is stored is content-addressed: records of a digest and its children, one
for equal subtrees.

A request names a leaf by group and rank.  Its path from the root is spelt by
the digits, base ``FAN``, of the group's number and then of the rank.  All
requests descend together, level by level: what goes down is one state for
each node that some request wants, so the root is looked up once and not once
for each leaf.  A step joins the states with the records of their digests,
selects the child that the digit names and keeps the unselected ones as a
segment of the path.  Reversed, the segments are the proof, from the leaf to
the root; folding a leaf's digest into them gives the root again, if nothing
was changed.

Everything is DataFrame work; no group, however large, meets in one task: a
task's rows gather at most ``FAN`` digests, and the order comes from a range
partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered
from .tables import small_batches, stored

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


class Manifest(NamedTuple):
    """``leaves``: (g, rank, digest) and the rows' other columns; ``groups``: (g, group, subroot, height); ``records`` and
    ``tops``: for each level from 1 the nodes (g, rank, n, digest, children) of the groups' trees, and of that above them;
    ``root``: one row (digest), none for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    records: list[DataFrame]
    tops: list[DataFrame]
    root: DataFrame


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes, so that no two rows are spelt alike; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (g, rank, n, digest), ``n`` being the group's number of nodes, and (g, digest, height) of the roots."""
    top = lambda level, height: level.where("n = 1").select("g", "digest", F.lit(height).alias("height"))
    levels, roots, below = [], [top(nodes, 0)], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = below.where("n > 1").groupBy("g", F.expr(f"rank div {FAN}").alias("rank"))
        up = runs.agg(F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c"))
        up = up.select("g", "rank", "n", F.col("c.digest").alias("children"))
        below = stored(up.withColumn("digest", F.sha2(F.concat_ws("", "children").cast("binary"), 256)), f"{name}-{len(levels) + 1}")
        levels.append(below)
        roots.append(top(below, len(levels)))
        most = -(-most // FAN)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def build(leaves: DataFrame, group_col: str, order: list[str]) -> Manifest:
    """Manifest of rows with a ``digest`` and other columns: groups ascend by ``group_col`` (null first), leaves by ``order``
    (nulls first) and digest.  Rows that are equal in these are leaves of their own; their proofs differ by place."""
    at = stored(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    at = numbered(at, [group_col, *order, "digest", "__row"], "ordered").drop("__row")
    groups = at.groupBy(F.col(group_col).alias("group")).agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(numbered(stored(groups, "groups"), ["first"], "group-order").withColumnRenamed("ordinal", "g"), "numbered-groups")
    own = at.alias("x").join(groups.alias("y"), F.col(f"x.{group_col}").eqNullSafe(F.col("y.group")))
    nodes = own.select("x.*", "y.g", "y.n", (F.col("ordinal") - F.col("first")).alias("rank")).drop("ordinal")
    nodes = stored(nodes, "nodes")
    records, subroots = grown(nodes.select("g", "rank", "n", "digest"), "records")
    groups = stored(groups.select("g", "group").join(subroots.withColumnRenamed("digest", "subroot"), "g"), "subroots")
    count = groups.count()
    tops, root = grown(groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest")), "tops")
    return Manifest(nodes.drop("n"), groups, records, tops, root.select("digest"))


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def descend(records: list[DataFrame], starts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (g, rank and other columns) with the ``digest`` found at its place, the ``top`` it was reached from and the ``path`` to it.

    ``starts``: (g, digest, height, path), the root of each group with the
    segments above it.  A segment holds the digests left and right of the
    selected child, joined as hex text."""
    begin = lambda h: starts.where(F.col("height") == h).select("g", F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("top"), "path")
    states = None
    for level in range(len(records), 0, -1):
        here = begin(level) if states is None else states.unionByName(begin(level))
        # content-addressed: equal subtrees, of whatever groups, are one record
        kids = records[level - 1].select("digest", "children").dropDuplicates(["digest"])
        here = here.join(kids, "digest").select("g", F.col("rank").alias("up"), "top", "path", "children")
        rows = wanted if level == 1 else wanted.select("g", F.expr(f"rank div {FAN ** (level - 1)}").alias("rank")).distinct()
        down = rows.withColumn("up", F.expr(f"rank div {FAN}")).join(here, ["g", "up"])
        digit = F.expr(f"cast(rank % {FAN} as int)")
        # places are counted from 1 here
        segment = F.struct(
            F.concat_ws("", F.slice("children", F.lit(1), digit)).alias("left"),
            F.concat_ws("", F.slice("children", digit + 2, F.lit(FAN))).alias("right"))
        states = down.where(digit < F.size("children")).withColumn("digest", F.try_element_at("children", digit + 1)).withColumn("path", F.concat("path", F.array(segment)))
        states = states.select(*rows.columns, "digest", "top", "path")
    alone = wanted.join(begin(0), ["g", "rank"]).select(*wanted.columns, "digest", "top", "path")
    return alone if states is None else states.unionByName(alone)


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (g, rank and other columns) with the stored leaf ``digest``, the group's ``subroot`` and its ``path``: the segments of siblings from the leaf to the root.

    A request for a place that does not exist gives no row."""
    above = m.root.select(F.lit(0).cast("long").alias("g"), "digest", F.lit(len(m.tops)).alias("height"), F.expr(NO_PATH).alias("path"))
    of = descend(m.tops, above, m.groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), "height"))
    starts = stored(of.select(F.col("rank").alias("g"), "digest", "height", "path"), "starts")
    return descend(m.records, starts, requests).withColumnRenamed("top", "subroot").withColumn("path", F.reverse("path"))


def proof_digest(path: str) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def folded(path: str, leaf: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def dataset_leaves(docs: DataFrame, fields: list[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """The fields' first two columns and ``digest``; with ``changed`` also ``now``, the digest with these columns instead, where it differs."""
    cols = [F.col(c) for c in fields]
    out = [F.col(fields[0]).cast("long").alias("doc_id"), F.col(fields[1]).cast("string").alias("source"), digest_of(*[field(c) for c in cols]).alias("digest")]
    if changed:
        differ = F.lit(False)
        for c, to in changed.items():
            differ |= ~to.eqNullSafe(F.col(c))
        out.append(F.when(differ, digest_of(*[field(changed.get(c, F.col(c))) for c in fields])).alias("now"))
    return docs.select(*out)


def manifest_audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents``, and every row's proof against a copy with planted tampering.

    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one
    row for each of ``docs``.  Tampering lower-cases the text's ``A-Z`` where 5
    divides the CRC-32 of the id's decimal; null ids and texts stay.  Null
    fields are a value of their own; rows with one id and source follow each
    other by digest; an empty table gives no rows; other columns are ignored."""
    small_batches(docs.sparkSession)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.col("text").cast("string")
    tampered = F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)
    m = build(dataset_leaves(docs, changed={"text": tampered}), "source", ["doc_id"])
    rows = proofs(m, m.leaves.select("g", "rank", "doc_id", "now"))
    rows = rows.withColumn("folded_root", folded("path", F.coalesce("now", "digest"))).withColumn("proof_sha256", proof_digest("path"))
    root = m.root.first()
    rows = rows.withColumn("root", F.lit(root.digest if root else None).cast("string"))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _manifest_sql(levels: int) -> str:
    """DuckDB SQL for groups of at most ``FAN ** levels`` leaves, and as many groups."""
    text = f"CASE WHEN h % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    spelt = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda t: "sha256(" + " || ".join(spelt(c) for c in [*FIELDS[:-1], t]) + ")"
    out = [f"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS i, b::UBIGINT AS c FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
d AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::UBIGINT),
                            lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM documents, crc
), l AS (SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("CASE" + text[4:])} AS now FROM d),
s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM l),
a0 AS (SELECT source, r, n, leaf AS x FROM s0)"""]
    for i in range(1, levels + 1):
        out.append(f"""a{i} AS (
  SELECT source, r // {FAN} AS r, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) = 1 THEN max(x) ELSE sha256(string_agg(x, '' ORDER BY r)) END AS x
  FROM a{i - 1} GROUP BY source, r // {FAN})""")
    out.append(f"b0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n, x FROM a{levels})")
    for i in range(1, levels + 1):
        out.append(f"""b{i} AS (
  SELECT r // {FAN} AS r, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) = 1 THEN max(x) ELSE sha256(string_agg(x, '' ORDER BY r)) END AS x
  FROM b{i - 1} GROUP BY r // {FAN})""")
    # fold: siblings of the node's run, left and right of it
    join = lambda t, on: f"FROM {{}} f LEFT JOIN {t} k ON {on} AND k.r // {FAN} = f.at // {FAN}"
    out.append("p0 AS (SELECT doc_id, source, r AS own, r AS at, leaf, now AS x, '' AS path FROM s0)")
    left, right = "coalesce(string_agg(k.x, '' ORDER BY k.r) FILTER (k.r < f.at), '')", "coalesce(string_agg(k.x, '' ORDER BY k.r) FILTER (k.r > f.at), '')"
    for i in range(levels):
        out.append(f"""p{i + 1} AS (
  SELECT f.doc_id, f.source, f.own, f.at // {FAN} AS at, f.leaf, f.path || {left} || {right} AS path,
         CASE WHEN max(k.n) = 1 THEN f.x ELSE sha256({left} || f.x || {right}) END AS x
  {join(f"a{i}", "k.source IS NOT DISTINCT FROM f.source").format(f"p{i}")} GROUP BY f.doc_id, f.source, f.own, f.at, f.leaf, f.path, f.x)""")
    out.append(f"q0 AS (SELECT p.doc_id, p.source, p.own, b0.r AS at, p.leaf, b0.x AS subroot, p.path, p.x FROM p{levels} p JOIN b0 ON b0.source IS NOT DISTINCT FROM p.source)")
    for i in range(levels):
        out.append(f"""q{i + 1} AS (
  SELECT f.doc_id, f.source, f.own, f.at // {FAN} AS at, f.leaf, f.subroot, f.path || {left} || {right} AS path,
         CASE WHEN max(k.n) = 1 THEN f.x ELSE sha256({left} || f.x || {right}) END AS x
  {join(f"b{i}", "true").format(f"q{i}")} GROUP BY f.doc_id, f.source, f.own, f.at, f.leaf, f.subroot, f.path, f.x)""")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, b{levels}.x AS root, sha256(path) AS proof_sha256, q{levels}.x AS folded_root, q{levels}.x = b{levels}.x AS verified
FROM q{levels}, b{levels}
"""


MANIFEST_SQL = _manifest_sql(6)  # 16 million leaves a source
