"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item of ``n`` words is leaked into a text if some stretch of the text is
within ``floor(0.2 n)`` word insertions, deletions and replacements of it.

The CGK random walk copies a word sequence into ``3 n`` places, advancing at
each step or not by a random bit of the step and the current word.  Sequences
at a small edit distance end up at a small Hamming distance, so tables keyed
by a few sampled places of the walk (bit sampling) let a window meet its item.
The number of tables is set so that perturbed copies of the items themselves
meet their item with the target recall.  What meets is verified by the exact
edit distance.

Walking every window of every text for every table would cost far more than
the scan, so windows are chosen by a test that loses none: ``k`` edits leave
one of ``k + 1`` disjoint parts of the item whole, and a part found in the
text (by hash, in one pass) says where the item-sized window starts.

The benchmark is sent to the tasks in blocks of bounded size, each a pass over
the texts, so it may grow as well.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .tables import lean, small_batches, stored, texts

EDITS = 0.2
RECALL = 0.99
SAMPLED = 6  # places of the walk in one table's key
WALKS = 8
MOST_TABLES = 512  # items of a length that needs more are compared at all windows a part of theirs points to
CALIBRATED = 128  # items of each length (by powers of two) that the tables are tried on
BLOCK_WORDS = 1 << 18
PAD = np.uint64(0)


class Block(NamedTuple):
    ids: np.ndarray
    words: np.ndarray  # items by places, PAD behind the end
    size: np.ndarray
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted hashes, item, place
    tables: list[tuple[int, np.ndarray]]  # walk, sampled fractions of its length
    keys: np.ndarray  # items by tables
    direct: np.ndarray  # whether an item is compared at all its windows, since no tables reach its length's recall


def words_of(s: X.Slice) -> tuple[X.Words, np.ndarray]:
    s = s._replace(buf=X.LOWER[s.buf])
    w = X.split(s, X.WORD_CHARS)
    return w, X.word_hashes(s.buf, w) | X.U64(1)  # never PAD


def walk(words: np.ndarray, size: np.ndarray, number: int) -> np.ndarray:
    """CGK embedding of rows of words; a row's walk is ``3 * size`` places, PAD where it ran out."""
    rows, width = words.shape
    out = np.zeros((rows, 3 * width), dtype=np.uint64)
    at = np.zeros(rows, dtype=np.int64)
    every = np.arange(rows)
    for step in range(3 * width):
        now = np.where(at < size, words[every, np.minimum(at, width - 1)], PAD)
        out[:, step] = now
        bit = X.mix(now + X.U64((number * 1_000_003 + step) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & X.U64(1)
        at = np.minimum(at + bit.astype(np.int64), size)
    return out


def keys_of(words: np.ndarray, size: np.ndarray, tables: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Key of each row in each table: a hash of the sampled places of the walk."""
    out = np.zeros((len(words), len(tables)), dtype=np.uint64)
    for number in sorted({n for n, _ in tables}):
        walked = walk(words, size, number)
        for t, (n, share) in enumerate(tables):
            if n == number:
                key = np.full(len(words), t, dtype=np.uint64)
                for f in share:
                    place = np.minimum((f * 3 * size).astype(np.int64), walked.shape[1] - 1)
                    key = X.mix(key ^ walked[np.arange(len(words)), place])
                out[:, t] = key
    return out


def edit_distance(items: np.ndarray, n: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each item to any stretch of its row of ``text`` (both padded)."""
    rows, width = text.shape
    ramp = np.arange(width + 1)
    d = np.zeros((rows, width + 1), dtype=np.int64)  # a stretch may start anywhere
    for i in range(items.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (text != items[:, i : i + 1]), d[:, 1:] + 1)
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        d = np.where((i < n)[:, None], new, d)
    return d.min(axis=1)  # and end anywhere


def perturbed(words: np.ndarray, size: np.ndarray, edits: np.ndarray, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros_like(words)
    n = np.zeros_like(size)
    for i in range(len(words)):
        w = words[i, : size[i]].tolist()
        for _ in range(edits[i]):
            at, kind = rng.randrange(len(w)) if w else 0, rng.randrange(3)
            if kind == 0 or not w:
                w.insert(at, rng.getrandbits(63) | 1)
            elif kind == 1:
                del w[at]
            else:
                w[at] = rng.getrandbits(63) | 1
        w = w[: size[i]]  # an item-sized window
        out[i, : len(w)], n[i] = w, len(w)
    return out, n


def build_block(ids: np.ndarray, texts: pa.Array, seed: int = 7) -> Block | None:
    rows = []
    for s in X.slices(texts):
        w, h = words_of(s)
        first = X.first_of_row(w.count)
        rows += [h[first[i] : first[i + 1]] for i in range(s.hi - s.lo)]
    keep = [i for i, r in enumerate(rows) if len(r)]
    if not keep:
        return None
    size = np.array([len(rows[i]) for i in keep])
    words = np.zeros((len(keep), size.max()), dtype=np.uint64)
    for j, i in enumerate(keep):
        words[j, : size[j]] = rows[i]
    edits = (size * EDITS).astype(np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for j in range(len(keep)):
        q = int(size[j] // (edits[j] + 1))
        g = X.rolling(words[j, : size[j]], q)
        found.setdefault(q, []).extend((int(g[p * q]), j, p * q) for p in range(int(edits[j]) + 1))
    seeds = {}
    for q, rows_ in found.items():
        rows_.sort()
        seeds[q] = (np.array([r[0] for r in rows_], dtype=np.uint64), np.array([r[1] for r in rows_]), np.array([r[2] for r in rows_]))
    # as many tables as the target recall takes on perturbed items of every length; half of what may be missed is left as a margin
    rng = random.Random(seed)
    kind = np.floor(np.log2(size)).astype(np.int64)
    some = np.concatenate([rng.sample(of.tolist(), min(len(of), CALIBRATED)) for of in (np.flatnonzero(kind == c) for c in np.unique(kind))]).astype(np.int64)
    copies = [perturbed(words[some], size[some], edits[some], rng) for _ in range(2)]
    tables: list[tuple[int, np.ndarray]] = []
    met = [np.zeros(len(some), dtype=bool) for _ in copies]
    missed = np.unique(kind)
    while len(missed) and len(tables) < MOST_TABLES:
        new = [(t % WALKS, np.array([rng.random() for _ in range(SAMPLED)])) for t in range(len(tables), len(tables) + 32)]
        tables += new
        own = keys_of(words[some], size[some], new)
        met = [m | (keys_of(c, size[some], new) == own).any(axis=1) for m, (c, _) in zip(met, copies, strict=True)]
        missed = np.array([c for c in np.unique(kind) if min(m[kind[some] == c].mean() for m in met) < 1 - (1 - RECALL) / 2], dtype=np.int64)
    return Block(ids[keep], words, size, edits, seeds, tables, keys_of(words, size, tables), np.isin(kind, missed))


def windows(block: Block, w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item and first word (number in the slice, may lie before the row) of the windows whose item has a part there."""
    items, starts, rows = [], [], []
    for q, (seed, item, place) in block.seeds.items():
        at = X.window_starts(w.row, q)
        if not len(at):
            continue
        g = X.rolling(h, q)[at]
        small = np.zeros(1 << 16, dtype=bool)
        small[(seed & X.U64(0xFFFF)).astype(np.int64)] = True
        near = small[(g & X.U64(0xFFFF)).astype(np.int64)]
        at, g = at[near], g[near]
        lo, hi = np.searchsorted(seed, g, "left"), np.searchsorted(seed, g, "right")
        many = hi - lo
        pick = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        items.append(item[pick])
        starts.append(at - place[pick])
        rows.append(w.row[at])
    if not items:
        z = np.zeros(0, np.int64)
        return z, z, z
    found = np.unique(np.stack([np.concatenate(rows), np.concatenate(items), np.concatenate(starts)]), axis=1)
    return found[0], found[1], found[2]


def cut(h: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Words ``start : start + width`` of the rows ``first : last``, PAD outside."""
    place = start[:, None] + np.arange(int(width.max()))
    ok = (place >= first[:, None]) & (place < last[:, None]) & (np.arange(int(width.max())) < width[:, None])
    return np.where(ok, h[np.clip(place, 0, len(h) - 1)], PAD)


def leaks_in(block: Block, s: X.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, first word in the text and edit distance of the best window of every leak in a slice."""
    w, h = words_of(s)
    row, item, start = windows(block, w, h)
    none = np.zeros(0, np.int64)
    if not len(row):
        return none, none, none, none
    first = X.first_of_row(w.count)
    out = []
    for lo in range(0, len(row), 4096):
        r, i, at = row[lo : lo + 4096], item[lo : lo + 4096], start[lo : lo + 4096]
        n, k = block.size[i], block.edits[i]
        own = cut(h, first[r], first[r + 1], at, n)
        same = (own == block.words[i][:, : own.shape[1]]).all(axis=1)
        distance = np.where(same, 0, np.iinfo(np.int64).max)
        todo = np.flatnonzero(~same & (k > 0))
        # windows at whose start an equal one stands need no second look
        if len(todo):
            exact = set(zip(r[same].tolist(), i[same].tolist(), strict=True))
            todo = todo[[(a, b) not in exact for a, b in zip(r[todo].tolist(), i[todo].tolist(), strict=True)]]
        if len(todo):
            met = (keys_of(own[todo], n[todo], block.tables) == block.keys[i[todo]]).any(axis=1)
            todo = todo[met | block.direct[i[todo]]]
        if len(todo):
            wide = cut(h, first[r[todo]], first[r[todo] + 1], at[todo] - k[todo], n[todo] + 2 * k[todo])
            distance[todo] = edit_distance(block.words[i[todo]], n[todo], wide)
        ok = distance <= k
        out.append((r[ok], i[ok], np.maximum(at[ok] - first[r[ok]], 0), distance[ok]))
    r, i, at, d = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((at, d, i, r))
    r, i, at, d = r[order], i[order], at[order], d[order]
    best = np.ones(len(r), dtype=bool)
    best[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    return r[best], i[best], at[best], d[best]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_WORDS words, by item id."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    rows = stored(rows.withColumn("n", F.size(F.split("t", r"\s+"))).distinct(), "benchmark")
    after, most = None, rows.agg(F.max("n")).first()[0]
    if most is None:
        return
    step = max(1, BLOCK_WORDS // max(1, most))
    while True:
        # ids may repeat: a block ends with all rows of its last id
        part = rows if after is None else rows.where(F.col("i") > after)
        last = part.select("i").distinct().orderBy("i").limit(step).agg(F.max("i")).first()[0]
        if last is None:
            return
        got = part.where(F.col("i") <= last).orderBy("i", "t").toArrow()
        block = build_block(got["i"].to_numpy(), got["t"].combine_chunks())
        if block is not None:
            yield block
        after = last


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, item_id, first_word, distance)``: every item leaked into every row of ``docs``, its best place.

    Words are runs of letters and digits in lower case.  Null texts and items
    count as empty and leak nothing, as do items without words; rows without an
    id are searched like others; equal rows give equal results each."""
    spark = docs.sparkSession
    names = ["doc_id", "item_id", "first_word", "distance"]
    schema = "doc_id long, item_id long, first_word long, distance long"
    rows = texts(docs, id_col, text_col)
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                for s in X.slices(b.column(1)):
                    r, i, at, d = leaks_in(block, s)
                    yield pa.record_batch([b.column(0).take(pa.array(s.lo + r)), pa.array(block.ids[i], pa.int64()), pa.array(at, pa.int64()), pa.array(d, pa.int64())], names=names)

        out = out.unionByName(rows.mapInArrow(lean(run), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item is leaked; every column stays."""
    at = docs.columns.index(text_col)
    spark = docs.sparkSession
    small_batches(spark)
    for block in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for s in X.slices(b.column(at)):
                    keep[s.lo + leaks_in(block, s)[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
