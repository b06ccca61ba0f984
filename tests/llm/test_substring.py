"""Substring deduplication against sets of all windows."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SPACE_WORDS

from headway.llm import substring
from headway.llm import textcore as X


def brute(rows, k=13):
    first = {}
    for d, t in rows:
        w = SPACE_WORDS.findall(t or "")
        if d is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = SPACE_WORDS.findall(t or "")
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(150)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(k) for k in (5, 12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += text(rng.randint(0, 40))
            if rng.random() < 0.7:
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed"
                w += p
        sep = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((i * 7 % n, sep.join(w) + rng.choice(["", " ", "\n"])))
    rows += [(n + i, rows[i][1].replace("\n", " ")) for i in range(20)]
    return rows


def test_equals_all_windows(docs):
    rows = corpus()
    assert got(substring.substring_dedup(docs(rows, 4))) == brute(rows)


def test_nulls_empties_ties_repeats_and_extra_columns(docs):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(5, p), (5, p), (5, "other " + p), (3, "x " + p + " y"), (None, p), (7, None), (8, ""), (9, " \n"), (10, "loop " * 5000), (11, "loop " * 40), (12, p[: len(p) // 2])]
    df = docs(rows).withColumn("node", F.lit(1)).withColumn("hits", F.lit("z")).withColumn("sha", F.lit(None).cast("int"))
    assert got(substring.substring_dedup(df)) == brute(rows)


def test_empty_table(docs):
    assert substring.substring_dedup(docs([])).count() == 0


def test_spans_follow_paths_and_know_their_source(docs):
    """A branch ends a path: the words after it go on in one of the later documents only."""
    w = [f"w{i}" for i in range(60)]
    rows = {1: " ".join(w), 2: "a b " + " ".join(w[5:45]), 3: " ".join(w[10:30]) + " z", 4: "q " + " ".join(w[50:])}
    spans, _ = substring.repeated_spans(docs(rows))
    got = sorted((r.doc_id, r.part, r.pos, r.n_words, r.path_doc, r.path_part, r.path_pos) for r in spans.collect())
    # windows 10 to 17 stand in three documents, 5 to 9 and 18 to 32 in two
    assert got == [(2, 0, 2, 17, 1, 0, 5), (2, 0, 7, 20, 1, 0, 10), (2, 0, 15, 27, 1, 0, 18), (3, 0, 0, 20, 1, 0, 10)]


def test_a_common_passage_is_one_stretch_at_its_source(docs):
    """A header in every document: its source is asked for it once, not once for each of them."""
    header = " ".join(f"h{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {header} " + " ".join(f"own{i}x{j}" for j in range(5))) for i in range(3000)]
    spans, _ = substring.repeated_spans(docs(rows, 6))
    assert spans.count() == 2999
    assert [(r.doc_id, [tuple(x) for x in r.wanted]) for r in substring.stretches(spans).collect()] == [(0, [(2, 30)])]
    assert {(r.doc_id > 0, r.n_removed) for r in substring.substring_dedup(docs(rows, 6)).collect()} == {(False, 0), (True, 30)}


def test_words_in_another_order_are_another_text(docs):
    s = next(X.slices(pa.array(["a b c", "c b a", "a b", "a b c ", "", None, "a b  c"])))
    w = X.split(s)
    n = substring.nodes_of(w, X.word_hashes(s.buf, w)).tolist()
    assert n[0] == n[3] == n[6] and n[4] == n[5] and len(set(n)) == 4


def test_a_span_unlike_its_source_ends_the_job(spark):
    text = " ".join(f"w{i}" for i in range(20))
    s = next(X.slices(pa.array([text])))
    w = X.split(s)
    node = int(substring.nodes_of(w, X.word_hashes(s.buf, w))[0])
    want = substring.hashlib.blake2b(" ".join(f"w{i}" for i in range(13)).encode(), digest_size=16).digest()
    shape = "doc_id long, node long, text string, spans array<struct<pos int, n_words long, want binary>>"
    run = lambda at: substring.kept(spark.createDataFrame([(1, node, text, [(at, 13, want)])], shape)).collect()
    assert run(0)[0].n_removed == 13
    with pytest.raises(Exception, match="not those at its source"):
        run(1)
