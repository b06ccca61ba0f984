"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (sizes, shares of kinds of characters and words, repeated
words, word pairs and lines) are computed for a slice of texts at a time.  The
trees are grown on a bounded sample of labelled rows (``SAMPLE`` rows, the
first by a hash of the id) on binned statistics, level by level from gradient
histograms.  A tree is a full binary tree in flat arrays; scoring moves all
rows through all trees one level at a time with numpy.

Inputs are the text alone; labels, language, source and ids are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textcore as X
from .tables import lean, small_batches, texts

SAMPLE = 20_000  # labelled rows the trees are grown on, at most
FOLDS = 5
CUT = 0.3
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 80, 4, 64, 0.15, 1.0, 5.0

CLASSES = ("upper", "lower", "digit", "blank", "newline", "high", "stop", "quote", "mark", "bar", "bang", "control")


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("control"), dtype=np.int64)
    for name, chars in (
        ("upper", bytes(range(0x41, 0x5B))),
        ("lower", bytes(range(0x61, 0x7B))),
        ("digit", bytes(range(0x30, 0x3A))),
        ("blank", b" \t"),
        ("newline", b"\n\r\x0b\x0c"),
        ("high", bytes(range(0x80, 0x100))),
        ("stop", b".,;:?"),
        ("quote", b"'\"()-"),
        ("mark", b"#$%&*+/<=>@[\\]^_`{}~"),
        ("bar", b"|"),
        ("bang", b"!"),
    ):
        t[np.frombuffer(chars, dtype=np.uint8)] = CLASSES.index(name)
    return t


_CLASS = _class_table()
_LINE = ~X.byte_set("0A-0A 0D-0D")
_LETTER = X.byte_set("41-5A 61-7A 80-FF")
_UPPER = X.byte_set("41-5A")
FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_deviation", "word_longest",
    *(f"share_{c}" for c in CLASSES),
    "words_capital", "words_upper", "words_end_mark", "words_no_letter",
    "words_distinct", "words_most", "pairs_distinct",
    "log_lines", "line_mean", "lines_distinct", "lines_most",
)


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, by row."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, row[at], runs)
    return np.bincount(row[at], minlength=rows).astype(float), most


def statistics(s: X.Slice) -> np.ndarray:
    """Rows by FEATURES; an empty text has zeros."""
    rows, c = len(s.off) - 1, len(CLASSES)
    size = np.diff(s.off)
    of = np.repeat(np.arange(rows) * c, size)
    share = np.bincount(of + _CLASS[s.buf], minlength=rows * c).reshape(rows, c) / np.maximum(size, 1)[:, None]
    w = X.split(s)
    n = np.maximum(w.count, 1)
    length = (w.end - w.start).astype(float)
    total = lambda x: np.bincount(w.row, weights=x, minlength=rows)
    mean = total(length) / n
    deviation = np.sqrt(np.maximum(total(length * length) / n - mean * mean, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, length)
    if len(w.row):
        upper = np.concatenate([[0], np.cumsum(_UPPER[s.buf])])
        letters = np.concatenate([[0], np.cumsum(_LETTER[s.buf])])
        n_upper, n_letters = upper[w.end] - upper[w.start], letters[w.end] - letters[w.start]
        last = _CLASS[s.buf[w.end - 1]]
        marks = (last == CLASSES.index("mark")) | (last == CLASSES.index("bar")) | (last == CLASSES.index("bang"))
        kinds = [_UPPER[s.buf[w.start]], (n_upper > 1) & (n_upper == n_letters), marks, n_letters == 0]
    else:
        kinds = [np.zeros(0)] * 4
    h = X.word_hashes(s.buf, w) if len(w.row) else np.zeros(0, np.uint64)
    distinct, most = _repeats(h, w.row, rows)
    at, pairs = X.window_hashes(h, w.row, 2)
    pair_distinct, _ = _repeats(pairs, w.row[at], rows)
    lines = X.split(s, _LINE)
    line_distinct, line_most = _repeats(X.word_hashes(s.buf, lines) if len(lines.row) else np.zeros(0, np.uint64), lines.row, rows)
    n_lines = np.maximum(lines.count, 1)
    return np.column_stack(
        [np.log1p(size), np.log1p(w.count), mean, deviation, np.log1p(longest), share]
        + [total(k.astype(float)) / n for k in kinds]
        + [distinct / n, most / n, pair_distinct / np.maximum(w.count - 1, 1)]
        + [np.log1p(lines.count), size / n_lines, line_distinct / n_lines, line_most / n_lines]
    )


class Trees(NamedTuple):
    """``feature`` and ``limit``: trees by inner nodes (children of i: 2 i + 1, and 2 i + 2 if above the limit); ``value``: trees by leaves."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for log loss on binned features."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    features = x.shape[1]
    flat = binned + np.arange(features) * BINS
    score = np.full(len(y), start)
    feature, limit, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        f_, l_ = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            base, width = (1 << depth) - 1, features * BINS
            at = ((node - base)[:, None] * width + flat).ravel()
            shape = (1 << depth, features, BINS)
            gs, hs = (np.bincount(at, weights=np.repeat(v, features), minlength=(1 << depth) * width).reshape(shape).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + LAMBDA) + (gt - gs) ** 2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(1 << depth, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, c = divmod(b, BINS)
                if gain[k, f, c] > 1e-9:
                    f_[base + k], l_[base + k] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_[node]] > l_[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + LAMBDA)
        score += v[leaf]
        feature.append(f_)
        limit.append(l_)
        value.append(v)
    return Trees(np.array(feature), np.array(limit), np.array(value), start)


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    if not len(trees.feature):
        return np.full(len(x), 1 / (1 + np.exp(-trees.start)))
    out = np.empty(len(x))
    number = np.arange(len(trees.feature))[None, :]
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        rows = np.arange(len(part))[:, None]
        node = np.zeros((len(part), number.shape[1]), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (part[rows, trees.feature[number, node]] > trees.limit[number, node])
        out[lo : lo + 4096] = trees.value[number, node - trees.feature.shape[1]].sum(axis=1)
    return 1 / (1 + np.exp(-(trees.start + out)))


def held_out(id_col: str) -> Column:
    """Whether a row is in the fold that is never learnt from; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Grow the trees on at most SAMPLE labelled rows outside the held-out fold.

    Null ids and labels are left out; of several labels or texts for one id the
    largest label and the least statistics count."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("double")).alias("y"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # a bounded table, so it may be broadcast
    text = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(2)):
                x = statistics(s)
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                n = s.hi - s.lo
                yield pa.record_batch([b.column(0).slice(s.lo, n), b.column(1).slice(s.lo, n), pa.ListArray.from_arrays(off, pa.array(x.ravel()))], names=["doc_id", "y", "x"])

    got = text.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text").mapInArrow(lean(run), "doc_id long, y double, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x").toArrow().sort_by("doc_id")
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return grow(x, got["y"].to_numpy())


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` and the score of each row's text; null counts as empty.  A column named like the score is replaced."""
    small_batches(docs.sparkSession)
    keep = docs.drop(score_col)
    at = keep.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [predict(sent.value, statistics(s)) for s in X.slices(b.column(at))]
            yield b.append_column(score_col, pa.array(np.concatenate(score) if score else np.zeros(0)))

    return keep.mapInArrow(lean(run), StructType(keep.schema.fields.copy()).add(score_col, "double"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; without labels every score is 0.5."""
    trees = fit(docs, labels, id_col, text_col)
    rows = texts(docs, id_col, text_col)
    out = scored(rows, trees, "text", "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
