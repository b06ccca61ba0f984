"""Substring deduplication on a compacted de Bruijn graph of words.

The edges of the graph are the windows (k-mers) of 13 words.  Only edges that
several documents share matter, and few windows are such, so the work goes in
steps that each shuffle only what is left:

1. Every window has an anchor, its least 4-gram by hash, the same wherever the
   window stands.  Anchors are about a sixth as many as windows.  An anchor
   seen in one text only proves its windows unshared.
2. Windows with a shared anchor become edge rows, keyed by 96 bits of hash,
   with source coordinates (document, word position).  A grouped minimum finds
   each edge's place in its smallest document, its source; an edge that has a
   larger document too is repeated.
3. Repeated edges that follow each other at the source and have equally many
   occurrences have no branch between them and compact into one path.
4. Joined back on the edge, every later occurrence knows its path.  Those that
   follow each other along one path are a span, with the place of its source.
5. A span's words are compared with those at its source, by digest, and then cut
   from the text at their own coordinates; a difference ends the job.  A source
   digests each of its stretches once, however many documents repeat it.

Texts with equal word sequences are one text up to step 2; a later copy is
removed whole without any edge row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as X
from .tables import discard, marked, stored, texts

K = 13
ANCHOR = 4
EMPTY = hashlib.sha256(b"").hexdigest()
_BASE2 = 0xA0761D6478BD642F | 1


def joined(s: X.Slice, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Words of the slice, those of one row joined by one space, and by word the length with its space."""
    delta = np.zeros(len(s.buf) + 2, dtype=np.int8)
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    stop = end + ~last  # the byte after a word that is not a row's last becomes the space
    np.add.at(delta, start, 1)
    np.add.at(delta, stop, -1)
    take = np.cumsum(delta[: len(s.buf)], dtype=np.int8) > 0
    buf = s.buf.copy()
    buf[end[~last]] = 0x20
    return memoryview(np.ascontiguousarray(buf[take])), stop - start


def joined_digests(s: X.Slice, w: X.Words, keep: np.ndarray | None = None) -> list[bytes]:
    """Per row: SHA-256 of its (kept) words joined by one space."""
    start, end, row = w.start, w.end, w.row
    if keep is not None:
        start, end, row = start[keep], end[keep], row[keep]
    rows = len(w.count)
    data, length = joined(s, start, end, row)
    size = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, weights=length, minlength=rows).astype(np.int64), out=size[1:])
    return [hashlib.sha256(data[size[i] : size[i + 1]]).digest() for i in range(rows)]


def span_digests(s: X.Slice, w: X.Words, word: np.ndarray, n: np.ndarray) -> list[bytes]:
    """128-bit digest of the ``n`` words from each word number ``word`` of the slice."""
    data, length = joined(s, w.start, w.end, w.row)
    at = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=at[1:])
    stop = at[word + n - 1] + (w.end - w.start)[word + n - 1]
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[word].tolist(), stop.tolist(), strict=True)]


def nodes_of(w: X.Words, h: np.ndarray) -> np.ndarray:
    """64-bit identity of each row's sequence of words, given by their hashes ``h``."""
    place = np.arange(len(h)) - X.first_of_row(w.count)[w.row]
    total = X.row_sums(X.mix(h ^ X.mix(place.astype(np.uint64) * X.U64(0x9E3779B97F4A7C15))), w.row, len(w.count))
    return X.signed(X.mix(total + w.count.astype(np.uint64)))


def least_anchor(h: np.ndarray, k: int) -> np.ndarray:
    """For each word number: the least 4-gram hash of the ``k`` words from there."""
    g = X.mix(X.rolling(h, ANCHOR) ^ X.U64(0x2545F4914F6CDD1D))
    width, have = k - ANCHOR + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                w = X.split(s)
                d = joined_digests(s, w)
                node = nodes_of(w, X.word_hashes(s.buf, w))
                yield pa.record_batch([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(w.count, pa.int64()), pa.array(node), pa.array([x.hex() for x in d], pa.string())], names=["doc_id", "n_words", "node", "sha"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, node long, sha string")


def anchors(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(anchor, node)`` for every anchor of every text with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(0)):
                w = X.split(s)
                at = X.window_starts(w.row, k)
                if not len(at):
                    continue
                h = X.word_hashes(s.buf, w)
                a = least_anchor(h, k)[at]
                row = w.row[at]
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                a, row = a[new], row[new]
                yield pa.record_batch([pa.array(X.signed(a)), pa.array(nodes_of(w, h)[row])], names=["anchor", "node"])

    rows = texts(docs, id_col, text_col).where("doc_id is not null").select("text")
    return rows.mapInArrow(run, "anchor long, node long")


def edges(texts_: DataFrame, k: int) -> DataFrame:
    """Edge rows ``(e1, e2, doc_id, part, pos)`` of the windows whose anchor is in the row's list ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, want, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for s in X.slices(b.column(3)):
                w = X.split(s)
                at = X.window_starts(w.row, k)
                if not len(at):
                    continue
                h = X.word_hashes(s.buf, w)
                node = nodes_of(w, h)
                lists = b.column(4).slice(s.lo, s.hi - s.lo)
                of = np.repeat(np.arange(s.hi - s.lo), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                shared = np.sort(X.mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + of.astype(np.uint64) * X.U64(0x9E3779B97F4A7C15)))
                row = w.row[at]
                mine = X.mix(least_anchor(h, k)[at] + row.astype(np.uint64) * X.U64(0x9E3779B97F4A7C15))
                hit = np.searchsorted(shared, mine)
                hit[hit == len(shared)] = 0
                ok = (shared[hit] == mine) & (node[row] == want[s.lo + row])
                at, row = at[ok], row[ok]
                first = X.first_of_row(w.count)
                check = (X.rolling(X.mix(h), k, _BASE2)[at] >> X.U64(32)).astype(np.uint32).view(np.int32)
                yield pa.record_batch(
                    [pa.array(X.signed(X.rolling(h, k)[at])), pa.array(check), pa.array(ids[s.lo + row], pa.int64()), pa.array(part[s.lo + row], pa.int32()), pa.array((at - first[row]).astype(np.int32))],
                    names=["e1", "e2", "doc_id", "part", "pos"],
                )

    return texts_.mapInArrow(run, "e1 long, e2 int, doc_id long, part int, pos int")


def listed(s: X.Slice, lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of the slice for each struct in its ``lists``, and the structs."""
    lists = lists.slice(s.lo, s.hi - s.lo)
    return np.repeat(np.arange(s.hi - s.lo), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def sources(texts_: DataFrame) -> DataFrame:
    """``(path_doc, path_part, path_pos, n_words, want)`` of rows ``(doc_id, part, node, text, wanted)``: the digest of each stretch (position, words) wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in X.slices(b.column(3)):
                w = X.split(s)
                own = nodes_of(w, X.word_hashes(s.buf, w)) == b.column(2).slice(s.lo, s.hi - s.lo).to_numpy(zero_copy_only=False)
                of, spans = listed(s, b.column(4))
                spans, of = spans.filter(pa.array(own[of])), of[own[of]]
                sha = span_digests(s, w, X.first_of_row(w.count)[of] + numbers(spans.field(0)), numbers(spans.field(1)))
                yield pa.record_batch(
                    [pa.array(ids[s.lo + of], pa.int64()), pa.array(part[s.lo + of], pa.int32()), spans.field(0), spans.field(1), pa.array(sha, pa.binary())],
                    names=["path_doc", "path_part", "path_pos", "n_words", "want"])

    return texts_.mapInArrow(run, "path_doc long, path_part int, path_pos int, n_words long, want binary")


def kept(texts_: DataFrame) -> DataFrame:
    """``(doc_id, node, n_removed, n_spans, sha)`` of rows ``(doc_id, node, text, spans)``; a span is (position, words, digest at its source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(2)):
                w = X.split(s)
                n = s.hi - s.lo
                own = nodes_of(w, X.word_hashes(s.buf, w)) == b.column(1).slice(s.lo, n).to_numpy(zero_copy_only=False)
                of, spans = listed(s, b.column(3))
                spans, of = spans.filter(pa.array(own[of])), of[own[of]]
                at, words = X.first_of_row(w.count)[of] + numbers(spans.field(0)), numbers(spans.field(1))
                if span_digests(s, w, at, words) != spans.field(2).to_pylist():
                    raise ValueError("the words of a span are not those at its source")
                cover = np.zeros(len(w.row) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + words, -1)
                gone = np.cumsum(cover[:-1]) > 0
                sha = joined_digests(s, w, ~gone)
                removed = np.bincount(w.row[gone], minlength=n)
                yield pa.record_batch(
                    [b.column(0).slice(s.lo, n), b.column(1).slice(s.lo, n), pa.array(removed, pa.int64()), pa.array(np.bincount(of, minlength=n), pa.int64()), pa.array([x.hex() for x in sha], pa.string())],
                    names=["doc_id", "node", "n_removed", "n_spans", "sha"],
                ).filter(pa.array(own))

    return texts_.mapInArrow(run, "doc_id long, node long, n_removed long, n_spans long, sha string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, part, pos, n_words, path_doc, path_part, path_pos, n_edges)``: the spans of each text (the first of equal
    ones) whose edges also start in a document with a smaller id, from word ``path_pos`` of part ``path_part`` of
    ``path_doc``; and ``(doc_id, part, node)`` of the texts."""
    rows = rows if rows is not None else profile(docs, id_col, text_col)
    a = anchors(docs, id_col, text_col, k)
    shared = a.groupBy("anchor").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("anchor")
    # rows with one id and different texts are parts of one document
    firsts = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"))
    firsts = firsts.select("doc_id", "node", (F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1).alias("part"))
    lists = a.join(shared, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("anchors"))
    lists = stored(firsts.join(lists, "node"), "anchors")

    text = texts(docs, id_col, text_col)
    e = stored(edges(marked(text, "doc_id", lists, "doc_id").join(lists, "doc_id").select("doc_id", "node", "part", "text", "anchors"), k), "edges")
    # the place (part and position in one number) in the smallest document, without a sort of the edges
    place = F.shiftleft(F.col("part").cast("long"), 32) + F.col("pos")
    r = e.groupBy("e1", "e2").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("last"), F.min_by(place, "doc_id").alias("p0"), F.count(F.lit(1)).alias("c"))
    r = r.where("d0 < last").drop("last")
    w = Window.partitionBy("d0").orderBy("p0")
    on = (F.lag("p0").over(w) + 1 == F.col("p0")) & (F.lag("c").over(w) == F.col("c"))
    start = F.max(F.when(~F.coalesce(on, F.lit(False)), F.col("p0"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    path = r.select("e1", "e2", F.col("d0").alias("path_doc"), start.alias("path"), F.col("p0").alias("at"))
    # stored, so that the join deals both sides out anew and Spark can split the rows of a very common edge
    path = stored(path, "paths")
    hit = e.join(path, ["e1", "e2"]).where("doc_id > path_doc").select("doc_id", "part", "pos", "path_doc", "path", "at")
    hit = stored(hit, "occurrences")  # so that the shuffled edges go before the occurrences are dealt out by document
    discard(e, path)
    v = Window.partitionBy("doc_id", "part").orderBy("pos")
    on = F.lit(True)
    for c, step in (("pos", 1), ("path_doc", 0), ("path", 0), ("at", 1)):
        on &= F.lag(c).over(v) + step == F.col(c)
    start = F.max(F.when(~F.coalesce(on, F.lit(False)), F.col("pos"))).over(v.rowsBetween(Window.unboundedPreceding, 0))
    spans = hit.withColumn("start", start).groupBy("doc_id", "part", F.col("start").alias("pos")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("path_doc").alias("path_doc"), F.min("at").alias("at"))
    spans = spans.select(
        "doc_id", "part", "pos", (F.col("n_edges") + k - 1).alias("n_words"), "path_doc",
        F.shiftright("at", 32).cast("int").alias("path_part"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("path_pos"), "n_edges")
    spans, parts = stored(spans, "spans"), stored(lists.select("doc_id", "part", "node"), "parts")
    discard(hit, lists)
    return spans, parts


PLACE = ["path_doc", "path_part", "path_pos", "n_words"]


def stretches(spans: DataFrame) -> DataFrame:
    """``(doc_id, part, wanted)``: by source text the different stretches (position, words) that spans repeat; how many documents repeat one makes no difference."""
    of = spans.select(*PLACE).distinct().groupBy(F.col("path_doc").alias("doc_id"), F.col("path_part").alias("part"))
    return of.agg(F.collect_list(F.struct("path_pos", "n_words")).alias("wanted"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, n_spans)`` for every row of ``docs``.

    A word goes if a window of ``k`` words that covers it also starts in a
    document with a smaller id.  Null texts have no words; a null id is
    neither smaller nor larger than others, so its row is kept whole and takes
    nothing from others; rows with one id are one document's."""
    rows = stored(profile(docs, id_col, text_col), "words")
    spans, parts = repeated_spans(docs, id_col, text_col, k, rows)
    text = texts(docs, id_col, text_col)
    wanted = stored(stretches(spans).join(parts, ["doc_id", "part"]), "wanted")
    want = sources(marked(text, "doc_id", wanted, "doc_id").join(wanted, "doc_id").select("doc_id", "part", "node", "text", "wanted"))
    want = stored(want.dropDuplicates(PLACE), "source-digests")
    # left: a span whose source was not found stays, without a digest, and ends the job
    cut = spans.select("doc_id", "part", "pos", *PLACE).join(want, PLACE, "left")
    cut = cut.groupBy("doc_id", "part").agg(F.collect_list(F.struct("pos", "n_words", "want")).alias("spans"))
    cut = stored(cut.join(parts, ["doc_id", "part"]).select("doc_id", "node", "spans"), "cut")
    text = marked(text, "doc_id", cut, "doc_id")
    new = kept(text.join(cut, "doc_id").select("doc_id", "node", "text", "spans")).dropDuplicates(["doc_id", "node"])
    first = rows.where("doc_id is not null").groupBy(F.col("sha").alias("k_sha")).agg(F.min("doc_id").alias("first"))
    out = rows.join(first, rows.sha == first.k_sha, "left").drop("k_sha")
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= k), F.lit(False))
    out = out.join(new.withColumnRenamed("sha", "new_sha"), ["doc_id", "node"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
    )
