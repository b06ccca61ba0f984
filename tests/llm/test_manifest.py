"""The manifest's proofs against a Merkle tree in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from headway.llm import manifest as M

SCHEMA = "path string, doc_id long, rank int, text string, lang string, g string, source string, n_chars long, digest string, subroot int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelt(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def segments(tree, i):
    out = []
    for d in tree[:-1]:
        lo = i // 16 * 16
        out.append((d[lo:i], d[i + 1 : lo + 16]))
        i //= 16
    return out


def plain(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, t: H(*[spelt(v) for v in r[:4]], spelt(t))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            way = segments(trees[s], i) + segments(top, j)
            t = r[4]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = t.translate(str.maketrans(M.UPPER, M.LOWER))
            x = leaf(r, t)
            for left, right in way:
                x = H(*left, x, *right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], H(*[d for a, b in way for d in a + b]), x, x == top[-1][0]))
    return out


def audited(spark, rows, parts=5):
    full = [("x", r[0], 7, r[4], r[2], "other", r[1], r[3], "z", 1) for r in rows]
    df = M.manifest_audit(spark.createDataFrame(full, SCHEMA).repartition(parts))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_tree(spark):
    rows = [(i, "big", "en", i % 7, f"Text Nr {i}") for i in range(300)]  # three levels
    rows += [(1000 + i, f"s{i}", "de", 3, "Einzeln") for i in range(17)]  # single leaves; two levels above the sources
    rows += [(5, "big", "en", 5, "Text Nr 5")] * 20 + [(9, "copies", "en", 1, "SAME")] * 33  # repeated rows: equal subtrees
    rows += [(None, None, None, None, None), (None, "big", "en", 4, "NULL id"), (2001, None, "fr", None, "É à Ü"), (2002, "", "", 0, ""), (2003, "ünï", None, 2, None)]
    rows += [(3000, "long", "en", 1, "Wort " * 40000), (-5, "big", "en", -5, "Negative")]
    assert audited(spark, rows) == sorted(plain(rows), key=repr)


def test_one_row_and_no_row(spark):
    one = [(5, "a", "en", 1, "Abc")]
    got = audited(spark, one)
    assert got == plain(one) and got[0][4] == hashlib.sha256(b"").hexdigest()
    assert audited(spark, []) == []


def test_some_requests_descend_alone(spark):
    docs = spark.createDataFrame([("", i, 0, f"t{i}", "en", "", f"s{i % 3}", i, "", 0) for i in range(900)], SCHEMA)
    m = M.build(M.dataset_leaves(docs), "source", ["doc_id"])
    wanted = spark.createDataFrame([(0, 0, "first"), (0, 299, "last"), (2, 17, "mid"), (2, 300, "beyond"), (9, 0, "no group")], "g long, rank long, who string")
    got = M.proofs(m, wanted).withColumn("root", M.folded("path", F.col("digest"))).collect()
    assert {r.who for r in got} == {"first", "last", "mid"}
    assert {r.root for r in got} == {m.root.first().digest}
    assert {r.who: len(r.path) for r in got} == {"first": 4, "last": 4, "mid": 4}
    by = {r.who: r for r in got}
    leaf = {(r.g, r["rank"]): r.digest for r in m.leaves.collect()}
    assert by["mid"].digest == leaf[2, 17]
    wrong = M.proofs(m, wanted).select(M.folded("path", F.lit("0" * 64)).alias("x")).collect()
    assert m.root.first().digest not in {r.x for r in wrong}


@pytest.mark.parametrize("parts", [1, 9])
def test_partitioning_changes_nothing(spark, parts):
    rows = [(i % 40, f"s{i % 2}", "en", 1, f"X{i % 50}") for i in range(200)]
    assert audited(spark, rows, parts) == sorted(plain(rows), key=repr)
