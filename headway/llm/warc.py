"""Fixity audit of WARC record archives by Merkle trees.

An archive is a table of records in files of ``FILE`` slots; a record has its
place in the file, its byte offset there, its length and the SHA-256 of its
bytes.  A leaf of the tree hashes offset, length and digest of one record, a
node hashes up to ``FAN`` children in order, so a node stands for a range of
offsets and the files are nodes of level 2.  Two replicas are compared from
the root down: a level's children are looked at only below branches that
differ, so equal replicas cost one comparison, and a damaged record one path.
Under the differing branches records are matched by key, which tells damaged
records from missing, additional and merely shifted ones.

Everything is DataFrame work; a node gathers at most ``FAN`` hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

FAN = 32
FILE = FAN * FAN  # records in a file
FILE_LEVEL = 2


def record(url: str, body):
    """A WARC response record as a string column."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digests(pages: DataFrame, id_col: str, url_col: str, bodies: dict) -> DataFrame:
    """Id, url and, for each named body, the size and digest of the record made of it; no page text is shuffled."""
    cols = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")]
    for name, body in bodies.items():
        r = record(url_col, body)
        cols += [F.octet_length(r).cast("long").alias(f"size_{name}"), F.sha2(r.cast("binary"), 256).alias(f"sha_{name}")]
    return pages.select(*cols)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``file`` and ``seq`` by a global sort: range partitions, numbered by the counts of those before them."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = stored(part.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = part.withColumn("p", F.shiftright("at", 33)).withColumn("i", F.col("at").bitwiseAND((1 << 33) - 1))
    # one row for each partition
    before = part.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = part.join(before.select("p", "before"), "p").withColumn("ordinal", F.col("before") + F.col("i"))
    return n.withColumn("file", F.floor(F.col("ordinal") / FILE)).withColumn("seq", F.col("ordinal") % FILE).drop("at", "p", "i", "before", "ordinal")


def offsets(rows: DataFrame, size: str = "size") -> DataFrame:
    """``seq`` counted anew within each file, and the byte offset of each record."""
    w = Window.partitionBy("file").orderBy("seq")
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("seq", F.row_number().over(w).cast("long") - 1)


def keyed(rows: DataFrame) -> DataFrame:
    """Records with one id and url in a file are told apart by their order."""
    return rows.withColumn("again", F.row_number().over(Window.partitionBy("file", "page_id", "url").orderBy("seq")))


def tree(rows: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Levels 0 (leaves) to ``height`` (one root) of ``(node, hash)``."""
    leaf = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("size").cast("string"), "sha").cast("binary"), 256)
    levels = [stored(rows.select((F.col("file") * FILE + F.col("seq")).alias("node"), leaf.alias("hash")), f"{name}-0")]
    for level in range(1, height + 1):
        child = F.struct("node", "hash")
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), ",")
        levels.append(stored(up.select(F.col("up").alias("node"), F.sha2(joined.cast("binary"), 256).alias("hash")), f"{name}-{level}"))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], level: int) -> DataFrame:
    """Nodes of ``level`` whose hashes differ, reached from the root through differing branches only."""
    bad = None
    for n in range(len(a) - 1, level - 1, -1):
        x, y = a[n], b[n]
        if bad is not None:
            up = bad.select(F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / FAN)).join(up, "up", "left_semi").drop("up") for t in (x, y))
        both = x.withColumnRenamed("hash", "ha").join(y.withColumnRenamed("hash", "hb"), "node", "full")
        bad = both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node")
    return bad


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of replica ``a`` (and those only in ``b``) with their status.

    Both have ``file, seq, start, size, sha, page_id, url``.  Status: ``ok``;
    ``corrupt`` (other bytes); ``shifted`` (same bytes, other offset);
    ``missing`` in ``b``; ``extra`` in ``b``.  Null ids and urls are keys like
    others; repeated records are matched by their order in the file."""
    a, b = stored(keyed(a), "replica-a"), stored(keyed(b), "replica-b")
    last = a.select("file").unionByName(b.select("file")).agg(F.max("file")).first()[0]
    height, nodes = FILE_LEVEL, (last or 0) + 1
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // FAN)
    ta, tb = tree(a, height, "tree-a"), tree(b, height, "tree-b")
    files = stored(differing(ta, tb, FILE_LEVEL).withColumnRenamed("node", "file"), "files")
    leaves = differing(ta, tb, 0).select(F.floor(F.col("node") / FILE).alias("file"), (F.col("node") % FILE).alias("seq"))
    keys = ["file", "page_id", "url", "again"]
    x = a.join(leaves.withColumn("looked", F.lit(True)), ["file", "seq"], "left")
    y = b.join(files, "file", "left_semi")
    x, y = x.alias("x"), y.select(*keys, F.col("start").alias("b_start"), F.col("size").alias("b_size"), F.col("sha").alias("b_sha"), F.lit(True).alias("there")).alias("y")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    m = x.join(y, same, "full")
    status = (
        F.when(F.col("x.file").isNull(), "extra")
        .when(F.col("x.looked").isNull(), "ok")
        .when(F.col("y.there").isNull(), "missing")
        .when(~((F.col("x.sha") == F.col("y.b_sha")) & (F.col("x.size") == F.col("y.b_size"))), "corrupt")
        .when(F.col("x.start") != F.col("y.b_start"), "shifted")
        .otherwise("ok")
    )
    pick = lambda c, d=None: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{d or c}")).alias(c)
    return m.select(pick("page_id"), pick("url"), pick("file"), F.col("x.seq").alias("seq"), pick("start", "b_start"), pick("size", "b_size"), pick("sha", "b_sha"), status.alias("status"))


def pages_audit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive the pages, derive a second replica with planted damage, and audit it.

    The replica's record of every page whose id leaves 13 modulo 97 has its
    body's letters ``a`` turned to ``A``; those that leave 200
    modulo 5000 are lost.  Null bodies and urls count as empty."""
    page = F.col(id_col).cast("long")
    rot = F.when(F.pmod(page, F.lit(97)) == 13, F.translate(F.coalesce(F.col(html_col), F.lit("")), "a", "A")).otherwise(F.col(html_col))
    rows = digests(pages, id_col, url_col, {"a": F.col(html_col), "b": rot})
    rows = stored(placed(rows, ["page_id", "url", "sha_a"]), "archive")
    a = offsets(rows.select("page_id", "url", "file", "seq", F.col("size_a").alias("size"), F.col("sha_a").alias("sha")))
    lost = F.coalesce(F.pmod("page_id", F.lit(5000)) == 200, F.lit(False))
    b = offsets(rows.where(~lost).select("page_id", "url", "file", "seq", F.col("size_b").alias("size"), F.col("sha_b").alias("sha")))
    return audit(a, b)


PAGES_AUDIT_SQL = """
WITH r AS (
  SELECT page_id, url, html,
         CASE WHEN page_id % 97 = 13 THEN replace(html, 'a', 'A') ELSE html END AS rot,
         page_id % 5000 = 200 AS lost
  FROM pages
), d AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
            || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
            || chr(13) || chr(10) || chr(13) || chr(10) AS a,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
            || chr(13) || chr(10) || 'Content-Length: ' || strlen(rot) || chr(13) || chr(10) || chr(13) || chr(10) || rot
            || chr(13) || chr(10) || chr(13) || chr(10) AS b,
         row_number() OVER (ORDER BY page_id, url, html) - 1 AS n
  FROM r
), f AS (
  SELECT page_id, url, n // 1024 AS file, n % 1024 AS seq, strlen(a) AS size, sha256(a) AS sha, strlen(b) AS b_size,
         sha256(b) AS b_sha, lost
  FROM d
), o AS (
  SELECT *, coalesce(sum(size) OVER w, 0) AS start,
         coalesce(sum(CASE WHEN lost THEN 0 ELSE b_size END) OVER w, 0) AS b_start
  FROM f WINDOW w AS (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT page_id, url, CAST(file AS BIGINT) AS file, CAST(seq AS BIGINT) AS seq, CAST(start AS BIGINT) AS start,
       CAST(size AS BIGINT) AS size, sha,
       CASE WHEN lost THEN 'missing' WHEN sha <> b_sha THEN 'corrupt' WHEN start <> b_start THEN 'shifted' ELSE 'ok' END AS status
FROM o
"""
