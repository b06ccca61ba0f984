"""Spelling groups against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from headway.llm import spelling as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}
    rows_ = {}
    for w, n in words.items():
        close = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = close[0] if close and words[close[0]] >= 5 * n else None
        rows_[w] = (form, n, len(close), words[form] if form else None)
    out = []
    for w, (form, n, k, fn) in rows_.items():
        root = w
        while rows_[root][0]:
            root = rows_[root][0]
        out.append((w, form, root, n, k, fn))
    return sorted(out)


def grouped(df):
    return sorted(tuple(r) for r in M.spelling_groups(df).collect())


@pytest.mark.parametrize("long_,heavy", [(48, 20_000), (7, 3)])
def test_neighbours_against_all_pairs(spark, monkeypatch, long_, heavy):
    monkeypatch.setattr(M, "LONG", long_)
    monkeypatch.setattr(M, "HEAVY", heavy)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(260)}
    words |= {"a" * n for n in range(6, 13)} | {"letter", "letters", "better", "bettér", "lettter", "etter" + "s", "ÿtters".lower()}
    got = {(r.word, r.near) for r in M.neighbours(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_whole_query_against_plain(spark, docs):
    rng = random.Random(4)
    base = ["network", "Networks", "protocol", "straße", "garçon", "COMPUTER", "château", "alphabet", "sensor", "×÷×÷×÷×"]
    rows = []
    for i in range(500):
        t = " ".join(rng.choice(base) for _ in range(rng.randint(0, 40)))
        if i % 9 == 0:
            t += " netwrk networ5k compter, protocoll_protocoll" + " compuuter" * 3
        rows.append((i, t))
    rows += [(None, "network " * 30), (None, None), (7, ""), (7, rows[7][1]), (7, rows[7][1]), (600, "sensor" * 5000 + " tail"), (601, "ñ" * 8 + "Ñ" + "漢字network")]
    rows += [(700 + i, "networkk netwwork networkk") for i in range(30)] + [(800 + i, "networkkk") for i in range(2)] * 3
    df = docs(rows, 4).selectExpr("doc_id", "text", "'x' AS word", "1 AS n", "2 AS node", "3 AS salt")
    got = grouped(df)
    assert got == plain(rows)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)  # forms, and a chain of two


def test_long_runs_and_empty_tables(spark, docs):
    w = "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))
    other, shorter = w[:1500] + "z" + w[1501:], w[:700] + w[701:]
    rows = [(i, f"{w} {w} {w}") for i in range(10)] + [(20 + i, f"{other}-{shorter}") for i in range(5)]
    assert grouped(docs(rows)) == plain(rows)
    assert grouped(docs([])) == [] and grouped(docs([(1, None), (2, "a b c")])) == []
