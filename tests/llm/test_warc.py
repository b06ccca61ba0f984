"""The Merkle audit against comparing all records."""

import hashlib

from pyspark.sql import functions as F

from headway.llm import warc

RECORD = "file long, seq long, start long, size long, sha string, page_id long, url string"


def archive(spark, files):
    rows = []
    for f, records in files.items():
        at = 0
        for n, (page, body) in enumerate(records):
            rows.append((f, n, at, len(body), hashlib.sha256(body.encode()).hexdigest(), page, f"u{page}"))
            at += len(body)
    return spark.createDataFrame(rows, RECORD)


def status(df):
    return sorted(((r.file, r.page_id, r.status) for r in df.collect()), key=repr)


def test_equal_replicas_and_single_damage(spark):
    files = {f: [(f * 100 + n, f"body {n}") for n in range(70)] for f in range(40)}
    a = archive(spark, files)
    assert {s for _, _, s in status(warc.audit(a, archive(spark, files)))} == {"ok"}
    bad = {f: list(r) for f, r in files.items()}
    bad[7][40] = (740, "body X0"[:7])
    bad[9].pop(66)
    bad[11].append((9999, "more"))
    got = status(warc.audit(a, archive(spark, bad)))
    odd = [x for x in got if x[2] != "ok"]
    assert odd == sorted([(7, 740, "corrupt"), (9, 966, "missing"), (9, 967, "shifted"), (9, 968, "shifted"), (9, 969, "shifted"), (11, 9999, "extra")], key=repr)
    assert len(got) == 40 * 70 + 1


def test_only_differing_branches_are_entered(spark):
    files = {f: [(f * 100 + n, f"body {n}") for n in range(70)] for f in range(40)}
    a = warc.keyed(archive(spark, files))
    files[33][1] = (3301, "BODY 1")
    b = warc.keyed(archive(spark, files))
    ta, tb = warc.tree(a, 4, "a"), warc.tree(b, 4, "b")
    assert ta[4].count() == 1
    assert [sorted(r.node for r in warc.differing(ta, tb, n).collect()) for n in (4, 3, 2, 1, 0)] == [[0], [1], [33], [33 * 32], [33 * 1024 + 1]]


def test_pages_with_nulls_repeats_and_extra_columns(spark):
    rows = [(i, f"http://x/{i}", "a" * (i % 50)) for i in range(3000)] + [(5, "http://x/5", "aaaaa")] * 3 + [(None, None, None), (None, "u", "a"), (13, "again", "é" * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x")).withColumn("at", F.lit(1)).withColumn("p", F.lit(2))
    out = warc.pages_audit(df.repartition(5)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is not None and r.page_id % 5000 == 200:
            assert r.status == "missing"
        elif r.page_id is not None and r.page_id % 97 == 13:
            assert r.status == ("corrupt" if r.page_id % 50 and r.url != "again" else r.status)
        else:
            assert r.status in ("ok", "shifted")
    assert warc.pages_audit(df.limit(0)).count() == 0
