"""Decontamination against the exact edit distance of every window."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import LOWER

from headway.llm import decontaminate
from headway.llm import textcore as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def least(item, text):
    d = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        n = [i + 1]
        for j, x in enumerate(text):
            n.append(min(d[j] + (x != c), d[j + 1] + 1, n[j] + 1))
        d = n
    return min(d)


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, b in items:
            w = words(b)
            if i is not None and w and (k := least(w, words(t))) <= int(0.2 * len(w)):
                out[d, i] = min(k, out.get((d, i), k))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def sample(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["señor", "straße"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(n)) + ".") for i, n in enumerate([2, 4, 5, 9, 12, 20, 35, 59] * 3)]
    docs = []
    for d in range(240):
        w = text(rng.randint(0, 60))
        if d % 3:
            item = list(words(items[rng.randrange(len(items))][1]))
            for _ in range(rng.randint(0, max(1, len(item) // 4)) if d % 3 == 2 else 0):
                at = rng.randrange(len(item))
                if rng.random() < 0.3 and len(item) > 1:
                    del item[at]
                elif rng.random() < 0.5:
                    item.insert(at, rng.choice(vocab))
                else:
                    item[at] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    return docs, items


def test_finds_what_the_edit_distance_finds(spark, docs):
    rows, items = sample()
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs(rows, 3), bench(spark, items)).collect()}
    expected = brute(rows, items)
    assert set(found) <= set(expected)
    exact = {k for k, v in expected.items() if v == 0}
    assert exact <= set(found)
    assert len(found) >= 0.97 * len(expected)
    assert sum(found[k] == expected[k] for k in found) >= 0.97 * len(found)


def test_blocks_and_null_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    items = [(1, a), (1, a), (2, b), (3, None), (4, ""), (None, a), (5, a)]
    rows = [(1, f"x {a} y"), (1, f"x {a} y"), (2, None), (3, ""), (None, b), (4, "word " * 5000 + b), (5, "one two three"), (6, f"{a} {b}")]
    df = docs(rows).withColumn("item_id", F.lit(0)).withColumn("i", F.lit("x")).withColumn("distance", F.lit(None).cast("int"))
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench(spark, items)).collect()), key=repr)
    assert found == sorted([(1, 1), (1, 1), (1, 5), (1, 5), (None, 2), (4, 2), (6, 1), (6, 2), (6, 5)], key=repr)
    kept = decontaminate.clean(df, bench(spark, items))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


def test_empty_tables(spark, docs):
    assert decontaminate.leaks(docs([]), bench(spark, [(1, "a b c")])).count() == 0
    assert decontaminate.leaks(docs({1: "a b c"}), bench(spark, [])).count() == 0
    assert decontaminate.clean(docs({1: "a b c"}), bench(spark, [])).count() == 1


@pytest.mark.parametrize("sizes", [[(1000, 10), (50, 200)], [(1000, 8), (50, 100), (20, 600)]])
def test_recall_holds_for_every_length(sizes):
    """Items of one length in a block do not set the number of tables for those of another."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(30000)}"
    items = [[word() for _ in range(n)] for many, n in sizes for _ in range(many)]
    block = decontaminate.build_block(np.arange(len(items)), pa.array([" ".join(w) for w in items]))
    texts, of = [], []
    for i, w in enumerate(items):
        for _ in range((i % 10 == 0) if len(w) < 50 else 2):
            t = list(w)
            for _ in range(len(w) // 5):
                at, kind = rng.randrange(len(t)), rng.randrange(3)
                if kind == 0:
                    t.insert(at, word())
                elif kind == 1:
                    del t[at]
                else:
                    t[at] = word()
            texts.append(" ".join([word() for _ in range(20)] + t + [word() for _ in range(20)]))
            of.append(i)
    found, tried = {}, {}
    for s in X.slices(pa.array(texts)):
        row, hit, _, _ = decontaminate.leaks_in(block, s)
        got = set(zip((s.lo + row).tolist(), hit.tolist()))
        for r in range(s.lo, s.hi):
            n = len(items[of[r]])
            tried[n] = tried.get(n, 0) + 1
            found[n] = found.get(n, 0) + ((r, of[r]) in got)
    assert all(found[n] >= 0.99 * tried[n] for n in tried), (found, tried, len(block.tables), block.direct.sum())
