"""N-gram Jaccard join: size-aware heavy-light set similarity join.

Every text becomes the set of its distinct 5-word shingles.  Two texts link
when their sets' Jaccard similarity is 0.8 or more.  The join never compares
all pairs:

* Shingles have one global order, rarest first (by a fixed-size count sketch
  over all texts, ties by hash).  Sets that overlap in ``o`` or more shingles
  share at least ``c`` of their first ``size - o + c`` ones.
* *Light* (small) sets enumerate all ``c = 2`` element subsets of that prefix;
  two of them are candidates if a subset is equal.
* *Heavy* (large) sets, and the light ones near enough in size to match them,
  put the single shingles of their ``c = 1`` prefix into inverted lists.
* The boundary is the size at which the summed cost (subsets against list
  entries times the expected list length) is least.

Copies of one set are one node.  Inside a list, members are first compared to
the nearest of a few leaders only; when these links join a whole list, as in
groups of copies, none of its pairs are formed.  Lists that still hold members of different
components then give the pairs across components, less those whose parity maps
(a small bit map of each set, tested inside the join) differ in more bits than
linked sets can differ in shingles.  So a group of n near copies costs about n
comparisons and every component is exact: each pair that was never compared
shares no list, lies inside one component already, or is proven apart.
Every candidate is verified on the full sets.

Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textcore as X
from .graph import components
from .tables import lean, marked, stored, texts

SHINGLE = 5
NUM, DEN = 80, 100  # link: DEN * intersection >= NUM * union
SKETCH_BITS = 20
CHUNKS = 64
MAP_WORDS = 16  # 64-bit words of a set's parity map
LEADERS = 8  # members of a list of as many or more that the others are compared with first
NEAREST = 3  # of them, for each member, that are verified
MAP = [f"m{i}" for i in range(MAP_WORDS)]


def need(s):
    """Least overlap of a set of size ``s`` with any set it can link to."""
    return -(-NUM * s // DEN)


def shingles(s: X.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row then hash; distinct count per row."""
    s = s._replace(buf=X.LOWER[s.buf])
    w = X.split(s)
    rows = len(w.count)
    h = X.word_hashes(s.buf, w)
    at, win = X.window_hashes(h, w.row, k)
    row = w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        first = X.first_of_row(w.count)
        extra = np.empty(len(short), dtype=np.uint64)
        for n in range(1, k):
            sel = w.count[short] == n
            at = first[short[sel]]
            total = np.full(len(at), n, dtype=np.uint64)
            for j in range(n):
                total = X.mix(total * X.U64(31) + h[at + j])
            extra[sel] = total
        row, win = np.concatenate([row, short]), np.concatenate([win, extra])
    order = np.argsort(win)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    row, win = row[order], win[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (win[1:] != win[:-1])
    row, win = row[keep], win[keep]
    return row, win, np.bincount(row, minlength=rows)


def set_hash(row: np.ndarray, win: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit identity of each row's set, independent of order."""
    one = X.row_sums(X.mix(win ^ X.U64(0x5851F42D4C957F2D)), row, len(count))
    two = X.row_sums(X.mix(win + X.U64(0x14057B7EF767814F)), row, len(count))
    return X.mix(one ^ X.mix(two + count.astype(np.uint64)))


def parity_maps(row: np.ndarray, win: np.ndarray, rows: int) -> list[np.ndarray]:
    """Per row MAP_WORDS words of bits: bit ``h % 1024`` of a set tells whether an odd number of its hashes fall there.

    Two maps differ in no more bits than the sets differ in elements."""
    bits = 64 * MAP_WORDS
    odd = np.bincount(row * bits + (win & X.U64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(rows, MAP_WORDS)
    return [np.ascontiguousarray(words[:, i]) for i in range(MAP_WORDS)]


# ---- passes over the texts ---------------------------------------------------------------


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, node (set hash) and parity map; and per task the count sketch in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in batches:
            for s in X.slices(b.column(1)):
                row, win, count = shingles(s)
                np.add.at(sketch, (win >> X.U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                node = X.signed(set_hash(row, win, count))
                n = s.hi - s.lo
                maps = [pa.array(m) for m in parity_maps(row, win, n)]
                yield pa.record_batch([b.column(0).slice(s.lo, n), pa.array(count, pa.int64()), pa.array(node, mask=count == 0), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *maps], names=names)
        parts = sketch.reshape(CHUNKS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        n = len(used)
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary()), *[pa.nulls(n, pa.int64())] * MAP_WORDS], names=names)

    names = ["doc_id", "n", "node", "chunk", "counts", *MAP]
    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n long, node long, chunk int, counts binary, " + ", ".join(f"{m} long" for m in MAP))


def sum_chunks(parts: DataFrame) -> DataFrame:
    """Sum sketch chunks: by chunk and salt, then by chunk; a group is read as a stream."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("counts"):
                v = np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.uint64)
                total = v if total is None else total + v
        out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "counts"])

    salted = parts.select("chunk", "counts", (F.spark_partition_id() % 32).alias("salt"))
    first = salted.groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    return first.groupBy("chunk").applyInArrow(add, "chunk int, counts binary")


def boundary(sizes: list[tuple[int, int]], list_length: float) -> int:
    """Light-heavy boundary: the size up to which enumerating pairs of prefix shingles costs least overall.

    ``sizes``: (set size, number of sets).  Cost unit: one row shuffled."""
    best, least = 3, None
    for cut in [3, *sorted({s for s, _ in sizes if s > 3})]:
        cost = 0.0
        for s, n in sizes:
            p = s - need(s) + 2
            if 3 < s <= cut:
                cost += n * p * (p - 1) / 2
            if s > 3 and s >= need(cut + 1):
                cost += n * (p - 1) * list_length
        if least is None or cost < least:
            best, least = cut, cost
    return best


def keys(docs: DataFrame, id_col: str, text_col: str, sketch, cut: int) -> DataFrame:
    """Subset keys of light sets and single-shingle keys of heavy ones: ``(key, node, n)``.

    Texts of three or fewer shingles link to equal sets alone, which are one node already, and need no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sketch.value, dtype=np.uint32)
        for b in batches:
            for s in X.slices(b.column(0)):
                row, win, count = shingles(s)
                node = set_hash(row, win, count)
                # copies of one set inside a slice give their keys once
                _, once = np.unique(node, return_index=True)
                keep = np.zeros(len(node), dtype=bool)
                keep[once] = True
                keep &= count > 3
                sel = keep[row]
                row, win = row[sel], win[sel]
                freq = table[(win >> X.U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((freq << X.U64(32)) | (win >> X.U64(32)), kind="stable")
                order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
                row, win = row[order], win[order]
                size = np.where(keep, count, 0)
                first = X.first_of_row(size)
                rank = np.arange(len(row)) - first[row]
                own = size[row]
                spare = own - need(own)
                out = []
                heavy = (own >= need(cut + 1)) & (rank <= spare)
                out.append((row[heavy], X.mix(win[heavy] + X.U64(1))))
                light = np.flatnonzero((own <= cut) & (rank <= spare + 1))
                if len(light):
                    lrow, lwin = row[light], win[light]
                    width = int((cut - need(cut)) + 2) + 1
                    for step in range(1, width):
                        a = np.flatnonzero(lrow[:-step] == lrow[step:]) if step < len(lrow) else np.zeros(0, np.int64)
                        if not len(a):
                            break
                        out.append((lrow[a], X.mix(X.mix(lwin[a]) + lwin[a + step])))
                r = np.concatenate([x[0] for x in out])
                k = np.concatenate([x[1] for x in out])
                yield pa.record_batch([pa.array(X.signed(k)), pa.array(X.signed(node)[r]), pa.array(count[r], pa.int32())], names=["key", "node", "n"])

    return texts(docs, id_col, text_col).select("text").mapInArrow(lean(run), "key long, node long, n int")


# ---- verification ------------------------------------------------------------------------


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose full sets link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.join(nodes, "node").select("node", "doc_id")

    def one_per_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                row, win, count = shingles(s)
                same = np.flatnonzero(X.signed(set_hash(row, win, count)) == b.column(0).slice(s.lo, s.hi - s.lo).to_numpy(zero_copy_only=False))
                first = X.first_of_row(count)
                raw = np.ascontiguousarray(win).tobytes()
                sets = [raw[8 * first[i] : 8 * first[i + 1]] for i in same]
                yield pa.record_batch([b.column(0).take(pa.array(s.lo + same)), pa.array(sets, pa.binary())], names=["node", "members"])

    text = texts(docs, id_col, text_col)
    wanted = stored(wanted, "wanted")
    text = marked(text, "doc_id", wanted, "doc_id")
    found = text.join(wanted, text.doc_id.eqNullSafe(wanted.doc_id)).select("node", "text")
    sets = stored(found.mapInArrow(lean(one_per_node), "node long, members binary").dropDuplicates(["node"]), "sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cols = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column(i)] for i in (2, 3)]
                size = [np.array([len(x) for x in c]) for c in cols]
                h = np.concatenate(cols[0] + cols[1])
                pair = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in size]).astype(np.int32)
                order = np.argsort(h, kind="stable")
                order = order[np.argsort(pair[order], kind="stable")]
                h, pair = h[order], pair[order]
                twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                both = np.bincount(pair[1:][twice], minlength=part.num_rows)
                ok = DEN * both >= NUM * (size[0] + size[1] - both)
                at = pa.array(np.flatnonzero(ok))
                yield pa.record_batch([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(lean(linked), "a long, b long")


def may_link(n: str, m: str, keys: str, cut: int):
    """Condition on two set sizes and the number of keys in common that every link meets.

    To link, sizes ``n`` and ``m`` need an overlap of ``o``.  Prefixes of ``size - o + c`` shingles then have ``c`` in
    common, so those that were indexed (``size - need(size) + 1``) have ``o - need(size) + 1`` for the larger size."""
    o = F.ceil((F.col(n) + F.col(m)) * NUM / (NUM + DEN) - 1e-9)
    large, small = F.greatest(n, m), F.least(n, m)
    c = o - F.ceil(large * NUM / DEN - 1e-9) + 1
    heavy = F.when(small >= need(cut + 1), c).otherwise(0)
    light = F.when(large <= cut, c * (c + 1) / 2).otherwise(0)
    return (small * DEN >= large * NUM) & (F.col(keys) >= heavy + light)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, node, component)`` for every row of ``docs``; component is a node hash shared by linked texts.

    Null or wordless texts: size 0, null node and component.  Fewer than five
    words: the whole sequence is the one shingle.  Repeated rows and ids are
    kept, one output row each.  Other columns are ignored."""
    spark = docs.sparkSession
    base = stored(profile(docs, id_col, text_col), "profile")
    rows = base.where("chunk is null").select("doc_id", "n", "node")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    # the sketch has a fixed size: CHUNKS rows, 4 * 2**SKETCH_BITS bytes in all
    table = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), dtype=np.uint32)
    for c in sum_chunks(base.where("chunk is not null")).collect():
        table[c.chunk] = np.frombuffer(c.counts, dtype=np.uint32)
    # set sizes, exact to 64 and then in steps of about 3 %: at most a few hundred rows
    step = F.when(F.col("n") <= 64, F.col("n").cast("double")).otherwise(F.floor(F.pow(F.lit(1.03), F.floor(F.log(1.03, "n")))).cast("double"))
    sizes = [(int(r.s), r.c) for r in rows.where("n > 0").groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()]
    # prefixes hold the rarest shingles, the share 1 - NUM / DEN of all: what their lists hold above the sketch's noise
    counts = np.sort(table.ravel()).astype(np.float64)
    mass = np.cumsum(counts)
    rare = counts[: int(np.searchsorted(mass, mass[-1] * (DEN - NUM) / DEN)) + 1]
    above = np.maximum(rare - np.median(counts), 0)
    cut = boundary(sizes, 2.0 + float((above * rare).sum() / max(rare.sum(), 1)))
    sketch = spark.sparkContext.broadcast(table.tobytes())

    k = keys(docs, id_col, text_col, sketch, cut)
    shared = k.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"), F.max("node").alias("other"), F.count("*").alias("size")).where("l.node != other")
    shared = shared.select("key", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"), "size")
    # stored, so that the join deals both sides out anew and Spark can split the rows of a very long list
    shared = stored(shared, "shared")
    lists = stored(k.join(shared, "key"), "lists")

    # a few comparisons a member: with the nearest, by parity map, of its lists' leaders.  A long list has several
    # leaders, the least members by different hashes, so that a large group does not hang on one member that few others link to.
    # Sets that link differ in at most a ninth of their summed sizes, and so do their maps.
    long_ = lists.where(F.col("size") >= LEADERS)
    leaders = long_.groupBy("key").agg(F.array(*[F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))) for i in range(1, LEADERS)]).alias("leaders"))
    more = long_.select("key", "node", "n").join(leaders, "key").select("node", "n", F.explode(F.array_distinct("leaders")).alias("l"))
    more = more.select("node", "n", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"))
    # sizes first, so that the maps are fetched for pairs that may link only
    near_size = (F.col("n") * DEN >= F.col("leader_n") * NUM) & (F.col("leader_n") * DEN >= F.col("n") * NUM)
    meet = lists.select("node", "n", "leader", "leader_n").unionByName(more).where((F.col("node") != F.col("leader")) & near_size).select("node", "leader").distinct()
    maps = base.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), *[F.first(m).alias(m) for m in MAP])
    apart = F.expr(" + ".join(f"bit_count(x{m} ^ y{m})" for m in MAP))
    near = apart * (NUM + DEN) <= (F.col("na") + F.col("nb")) * (DEN - NUM)
    sizes_ok = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    x = maps.select(F.col("node").alias("a"), F.col("n").alias("na"), *[F.col(m).alias(f"x{m}") for m in MAP])
    y = maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(m).alias(f"y{m}") for m in MAP])
    meet = meet.withColumnsRenamed({"node": "a", "leader": "b"}).join(x, "a").join(y, "b").where(sizes_ok & near)
    nearest = Window.partitionBy("a").orderBy(apart, "b")
    star = meet.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= NEAREST).select("a", "b")
    links = stored(verify(star, docs, nodes, id_col, text_col), "star")
    comp = components(links)

    # what is left: lists with members of different components
    of = lists.join(comp, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp")).distinct()
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    left = stored(of.join(mixed, "key", "left_semi").join(maps.drop("n"), "node"), "mixed")
    x = left.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *[F.col(m).alias(f"x{m}") for m in MAP])
    y = left.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), *[F.col(m).alias(f"y{m}") for m in MAP])
    cross = x.join(y, "key").where((F.col("ca") < F.col("cb")) & sizes_ok & near)
    cross = cross.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(may_link("na", "nb", "c", cut)).select("a", "b")
    cross = stored(cross.join(links, ["a", "b"], "left_anti"), "cross")
    final = components(links.unionByName(verify(cross, docs, nodes, id_col, text_col)))
    return rows.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("root", "node").alias("component"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: component_id is the smallest id reachable over links, the row's own if it links to nothing.

    Null ids never name a component unless all ids in it are null."""
    c = jaccard_components(docs, id_col, text_col)
    name = c.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return c.join(name, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts: that with the smallest id, all its columns as they are.

    Texts without words belong to no group and stay.  A null id counts as
    larger than any other; of equal rows one stays.  Only rows whose id may
    occur in a group are shuffled."""
    c = stored(jaccard_components(docs, id_col, text_col), "components").where("node is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "node")).alias("k")
    groups = c.groupBy("component").agg(first, F.count("*").alias("c")).where("c > 1")
    keep = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("node") == F.col("k.node"))
    members = stored(c.join(groups, "component").select("doc_id", "node", keep.alias("__keep")).distinct(), "members")

    alone = marked(docs, id_col, members, "doc_id", inverse=True)
    maybe = marked(docs, id_col, members, "doc_id")
    at = docs.columns.index(text_col)

    def add_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for s in X.slices(b.column(at).cast(pa.string())):
                row, win, count = shingles(s)
                parts.append(pa.array(X.signed(set_hash(row, win, count)), mask=count == 0))
            yield b.append_column("__node", pa.concat_arrays(parts) if parts else pa.nulls(0, pa.int64()))

    maybe = maybe.mapInArrow(lean(add_node), StructType(docs.schema.fields.copy()).add("__node", "long"))
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.col("__node") == F.col("m.node"))
    found = maybe.alias("d").join(members.alias("m"), same, "left").where("__keep or __keep is null")
    once = F.when(F.col("__keep"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    found = found.select("d.*", once.alias("__once"), F.col("m.doc_id").alias("__id")).dropDuplicates(["__id", "__node", "__once"])
    return alone.unionByName(found.select(docs.columns))
