"""The n-gram Jaccard join against all pairs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.conftest import LOWER, SPACE_WORDS

from headway.llm import jaccard


def shingle_set(text):
    w = SPACE_WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(size, smallest linked id) of each row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        named = [x for x in ids[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(named) if named and sets[i] else d))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, n = [], 0
    passage = text(40)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 40, 60, 90, 140, 200, 320, 600] * 2:
        base = text(size).split()
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.randint(0, 4)):  # near copies on both sides of the threshold
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.4:
                w += text(rng.randint(1, max(1, size // 5))).split()
            rows.append((n, "  ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            n += 1
        rows.append((n, text(size) + " " + passage))
        n += 1
    # a long chain: neighbours link, ends do not
    chain = text(60).split()
    for _ in range(12):
        chain = chain[2:] + text(2).split()
        rows.append((n, " ".join(chain)))
        n += 1
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components_equal_all_pairs(docs):
    rows = corpus()
    assert got(jaccard.jaccard_groups(docs(rows, 4))) == brute(rows)


def test_nulls_empties_repeats_and_extra_columns(docs):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x " * 3000), (7, "x " * 3000), (None, "a b c"), (None, None), (8, "a b c d e"), (8, "q r s t u v")]
    df = docs(rows).withColumn("node", F.lit(1)).withColumn("n", F.lit("z")).withColumn("key", F.lit(None).cast("int"))
    assert got(jaccard.jaccard_groups(df)) == brute(rows)


def test_empty_table(docs):
    df = docs([])
    assert jaccard.jaccard_groups(df).count() == 0
    assert jaccard.one_per_group(df).columns == df.columns
    assert jaccard.one_per_group(df).count() == 0


def test_one_per_group_keeps_one_row_of_each_group(docs):
    rows = corpus(5) + [(0, corpus(5)[0][1]), (900, None), (901, ""), (901, ""), (None, corpus(5)[0][1])]
    out = jaccard.one_per_group(docs(rows))
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    component = defaultdict(set)
    for d, n, c in brute(rows):
        component[c if n else ("none", d)].add(d)
    expected = {c for d, n, c in brute(rows) if n}
    assert sorted(d for d, t in kept if shingle_set(t)) == sorted(expected)
    assert sum(1 for d, t in kept if not shingle_set(t)) == 3
    assert out.columns == docs([]).columns


def test_group_of_near_copies_forms_no_pairs(docs):
    """A large group is joined by about one comparison a member."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert {c for _, _, c in got(jaccard.jaccard_groups(docs(rows, 4)))} == {0}


def test_boundary_is_the_cheapest_size():
    sizes = [(4, 100), (20, 50), (300, 10)]
    assert jaccard.boundary(sizes, 1.0) <= jaccard.boundary(sizes, 100.0)
    assert jaccard.boundary([], 5.0) == 3
