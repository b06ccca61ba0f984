"""Spelling variants: words one edit apart, found by a frontier that descends a trie.

The words of the vocabulary make a trie, kept as a table: one record for each
node, with its children.  A state ``(word, pos, node, edits)`` says that
the first ``pos`` letters of ``word``, with so many edits, spell ``node``.  A
level of the frontier is one join of the states with the records of their
nodes, and gives the states one level deeper:

* the next letter is the child's: the state goes on;
* without an edit so far: the child's letter replaces the next one, or the next
  letter is left out and the one after it is the child's.

A state whose letters are used up with one edit, on a node that is a word, is a
pair of neighbours.  Two things keep the frontier narrow:

* The relation is symmetric, so each pair is sought in one direction: replaced
  letters only by later ones, left-out ones but not added ones (an added letter
  is one left out in the other word).
* There are two tries, of the words and of the words read backward.  An edit is
  allowed in the second half of a word only; one in its first half is in the
  second half backward.  So no word is edited near a root, where every node has
  many children: a word starts at its middle, and only if another word has the
  same first half.

A node below which there is one word only needs no further level: what is left
of both words is compared at once, so the levels are as many as two words have
first letters in common.

A node that many words share has many states.  A record tells how many words
lie below it, and where they are many its states and its copies are dealt out
by salt.

Words of more than ``LONG`` letters, which are rare, would need as many levels.
They leave out each letter in turn, and meet where what remains is the same;
every pair is compared exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .tables import stored, texts

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5  # a word's form occurs so many times as often
TYPO = 199
LONG = 48
HEAVY = 20_000  # words below a node for each copy of its record
FLUSH = 200_000  # counted words a task holds

_RUN = re.compile("[a-zÀ-ÿ]+")


def typo(doc_id: int | None, run: str) -> str:
    """The run as document ``doc_id`` spells it: with the planted typo, if it has one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of every spelling, of any length and number; a null id is spelt as nothing in the typo's seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            ids = b.column(0).to_pylist()
            for s in X.slices(b.column(1)):
                low, off = X.LOWER[s.buf].tobytes(), s.off.tolist()
                for i in range(s.hi - s.lo):
                    found = Counter(_RUN.findall(low[off[i] : off[i + 1]].decode("utf-8", "replace")))
                    for w, n in found.items():
                        total[typo(ids[s.lo + i], w)] += n
                if len(total) > FLUSH:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trie(words: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """The nodes from depth ``start``, ``(depth, node, words, only, is_word)`` (words below, the least of them), and the
    records ``(depth, node, salt, kids)`` of those with two words or more below; a child is (letter, node, words, only, is_word)."""
    at = words.select("word", F.explode(F.sequence(F.lit(start), F.length("word"))).alias("depth"))
    nodes = at.groupBy("depth", F.expr("substring(word, 1, depth)").alias("node")).agg(
        F.count(F.lit(1)).alias("words"), F.min("word").alias("only"), F.max(F.length("word") == F.col("depth")).alias("is_word"))
    nodes = stored(nodes, "trie")
    kid = F.struct(F.expr("substring(node, depth, 1)").alias("letter"), F.col("node").alias("child"), "words", "only", "is_word")
    up = nodes.where(F.col("depth") > start).select((F.col("depth") - 1).alias("depth"), F.expr("substring(node, 1, depth - 1)").alias("node"), kid.alias("kid"))
    up = up.join(nodes.where("words > 1").select("depth", "node", F.col("words").alias("n")), ["depth", "node"])
    up = up.groupBy("depth", "node").agg(F.collect_list("kid").alias("kids"), F.first("n").alias("n"))  # no more than there are letters
    return nodes, stored(up.select("depth", "node", F.explode(F.expr(f"sequence(0, cast(n div {HEAVY} as int))")).alias("salt"), "kids"), "records")


def _letter(word: str, pos: str):
    return F.expr(f"substring({word}, {pos} + 1, 1)")


def descended(words: DataFrame, half: str) -> DataFrame | None:
    """``(a, b)``: the pairs of ``words`` of which one edit of ``a`` at ``half`` (an SQL expression of ``word``) or later makes ``b``, by replacing letters with later ones or leaving one out."""
    least = words.agg(F.min(F.length("word"))).first()[0]
    if least is None:
        return None
    nodes, records = trie(words, least // 2 if least > 3 else max(least // 2 - 1, 0))
    # a word starts where its edits are allowed (short ones a letter before, to be left a letter there), and only if other words start so as well
    first = words.withColumn("pos", F.expr(f"if(length(word) > 3, {half}, greatest({half} - 1, 0))").cast("int")).withColumn("node", F.expr("substring(word, 1, pos)"))
    first = first.join(nodes.where("words > 1").select(F.col("depth").alias("pos"), "node", "words"), ["pos", "node"])
    first = stored(first.select("word", "pos", "node", F.lit(0).alias("edits"), "words"), "starts")
    depth, last = first.agg(F.min("pos"), F.max("pos")).first()
    if depth is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    salt = F.expr(f"pmod(xxhash64(word), words div {HEAVY} + 1)").cast("int")
    pairs, live_states = None, None
    while True:
        states = first.where(F.col("pos") == depth)
        states = states if live_states is None else states.unionByName(live_states)
        here = records.where(F.col("depth") == depth).drop("depth")
        at = states.withColumn("salt", salt).join(here, ["node", "salt"]).withColumns({"next": _letter("word", "pos"), "after": _letter("word", "pos + 1")})
        fresh = (F.col("edits") == 0) & (F.col("pos") >= F.expr(half)) & (F.col("next") != "")
        # of equal letters in a row, the last is the one left out
        may_leave = fresh & (F.col("next") != F.col("after"))
        some = F.filter("kids", lambda k: (k["letter"] == F.col("next")) | (fresh & (k["letter"] > F.col("next"))) | (may_leave & (k["letter"] == F.col("after"))))
        moved = at.select("word", "pos", "edits", "next", "after", F.explode(some).alias("kid")).select("word", "pos", "edits", "next", "after", "kid.*")
        step = lambda letters, edits: F.struct(F.lit(letters).alias("letters"), F.lit(edits).alias("edits"))
        same = F.when(F.col("letter") == F.col("next"), F.struct(F.lit(1).alias("letters"), F.col("edits").alias("edits")))
        replaced = F.when(fresh & (F.col("letter") > F.col("next")), step(1, 1))
        left_out = F.when(may_leave & (F.col("letter") == F.col("after")), step(2, 1))
        moved = moved.withColumn("step", F.explode(F.array_compact(F.array(same, replaced, left_out))))
        moved = moved.select("word", (F.col("pos") + F.col("step.letters")).alias("pos"), F.col("child").alias("node"), F.col("step.edits").alias("edits"), "words", "only", "is_word")
        rest = F.expr("length(word) - pos")
        found = (
            F.when((F.col("words") == 1) & (F.col("edits") == 1) & (F.expr("substring(word, pos + 1)") == F.expr("substring(only, length(node) + 1)")), F.col("only"))
            .when((F.col("words") > 1) & F.col("is_word") & (rest + F.col("edits") == 1), F.col("node"))
        )
        live = (F.col("words") > 1) & (rest > 0)
        moved = stored(moved.withColumns({"found": found, "live": live}).where("live or found is not null").drop("only", "is_word"), f"frontier-{depth}")
        new = moved.where("found is not null").select(F.col("word").alias("a"), F.col("found").alias("b"))
        pairs = new if pairs is None else pairs.unionByName(new)
        live_states = moved.where("live").select("word", "pos", "node", "edits", "words")
        depth += 1
        if depth > last and live_states.isEmpty():
            return pairs


def left_out(words: DataFrame) -> DataFrame:
    """``(a, b)``: the pairs of ``words`` one edit apart, each in one direction or both, by what remains without one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word in b.column(0).to_pylist():
                # letters of the vocabulary are code points under 256
                h = X.mix(np.frombuffer(word.encode("latin-1"), dtype=np.uint8).astype(np.uint64) + X.U64(1))
                n = len(h)
                up = X._powers(X._WBASE, n + 1)[0]
                head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
                tail = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[1:] * up[: n - 1], dtype=np.uint64)])
                without = X.mix(head[:n] + (tail[-1] - tail))  # of the letters but one
                whole = X.mix(head[n:])
                last = np.append(h[1:] != h[:-1], True)  # of equal letters in a row, the last
                size = 1 << 16
                for lo in range(0, n, size):
                    yield rows(word, without[lo : lo + size], np.arange(lo, min(n, lo + size)), last[lo : lo + size], n - 1)
                yield rows(word, whole, np.full(1, -1), np.zeros(1, dtype=bool), n)

    def rows(word: str, key: np.ndarray, at: np.ndarray, last: np.ndarray, n: int) -> pa.RecordBatch:
        # of the word itself a digest goes along, not its letters
        return pa.record_batch([pa.array(np.full(len(key), zlib.crc32(word.encode()))), pa.array(np.full(len(key), len(word))), pa.array(X.signed(key)), pa.array(at, pa.int64()), pa.array(last), pa.array(np.full(len(key), n))],
                               names=["crc", "letters", "key", "at", "last", "n"])

    keyed = stored(words.select("word").mapInArrow(run, "crc long, letters long, key long, at long, last boolean, n long"), "remains")
    word = words.select(F.crc32(F.col("word").cast("binary")).alias("crc"), F.length("word").cast("long").alias("letters"), "word")
    # one letter of a in the place of another one of b, or b without it; what meets under a key is no more than there are letters, by place
    x, y = (keyed.select(*[F.col(c).alias(f"{c}{i}") for c in keyed.columns]) for i in (1, 2))
    replaced = x.where("at1 >= 0").join(y.where("at2 >= 0"), (F.col("key1") == F.col("key2")) & (F.col("n1") == F.col("n2")) & (F.col("at1") == F.col("at2")) & (F.col("crc1") <= F.col("crc2")))
    shorter = x.where("last1").join(y.where("at2 < 0"), (F.col("key1") == F.col("key2")) & (F.col("n1") == F.col("n2")))
    pairs = replaced.select("crc1", "letters1", "crc2", "letters2").unionByName(shorter.select("crc1", "letters1", "crc2", "letters2")).distinct()
    a = word.select(*[F.col(c).alias(f"{c}1") for c in word.columns])
    b = word.select(*[F.col(c).alias(f"{c}2") for c in word.columns])
    pairs = pairs.join(a, ["crc1", "letters1"]).join(b, ["crc2", "letters2"])
    return pairs.where(F.levenshtein("word1", "word2", 1) == 1).select(F.col("word1").alias("a"), F.col("word2").alias("b"))


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near)``: all pairs of different ``words`` that one inserted, deleted or replaced letter parts, in both directions."""
    words = stored(words.select("word"), "vocabulary")
    short = words.where(F.length("word") <= LONG)
    pairs = descended(short, "length(word) div 2")
    if pairs is None:
        pairs = words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    else:
        back = descended(short.select(F.reverse("word").alias("word")), "length(word) - length(word) div 2")
        pairs = pairs.unionByName(back.select(F.reverse("a").alias("a"), F.reverse("b").alias("b")))
    long_ = words.where(F.length("word") >= LONG)  # those of just LONG letters may have neighbours of either kind
    if not long_.where(F.length("word") > LONG).isEmpty():
        pairs = pairs.unionByName(left_out(long_))
    pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.distinct().select(F.col("a").alias("word"), F.col("b").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last word that the forms lead to, in a logarithmic number of joins.

    Forms must not lead in a circle."""
    to = stored(forms.select("word", F.col("form").alias("root")), "to")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "to")
        to = new.drop("went")
        if new.where("went").isEmpty():
            return to


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences or more.

    Words are the runs of letters with their planted typos.  ``form`` is the
    neighbour of most occurrences (ties: the first by code point) if it has
    ``TIMES`` as many as the word, so forms never lead in a circle; ``root`` is
    where they end.  Null and empty texts have no words, and an empty table
    gives no rows; rows with one id are read one by one, and repeated rows count
    as often as they stand; other columns are ignored."""
    words = word_counts(docs, id_col, text_col).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))
    words = stored(words, "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left")
    formed = -F.col("best.less") >= TIMES * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    out = stored(out, "forms")
    root = roots(out.where("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS i, b::UBIGINT AS c FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
r AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
  GROUP BY ALL
), k AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r),
h AS (
  SELECT w, n, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT)),
                               lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS h
  FROM k, crc
), c AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1
), v AS (SELECT * FROM c WHERE n >= 5 AND length(word) >= 6),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut SEMI JOIN v ON rest = v.word
  UNION SELECT rest, word FROM cut SEMI JOIN v ON rest = v.word
), g AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = b GROUP BY a
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN g USING (word)
), way AS (
  SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN way ON way.word = f.word JOIN f e ON e.word = way.at AND e.form IS NULL
"""
