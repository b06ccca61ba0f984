"""Licence scan with a positional rare-token index.

The index holds postings: for each licence word, the templates and the places in
them where it stands.  Inverse document frequencies come from one counting pass
over all texts.

* A file's licence words of highest IDF are looked up: of every template so many
  of its rarest places (``rarest``) that a file with enough of the template
  cannot lack more than all but ``VOTES`` of them.  The choice is made for each
  template, so no licence crowds out another in a long file.
* Each posting met tells where the template would start (place in the file less
  place in the template).  Postings are intersected by this relative position:
  a template is a candidate where ``VOTES`` of its places agree, but for what
  insertions can shift them.
* In a candidate's stretch the key phrases are verified word by word, each at a
  shift of its own, and the template's other words are aligned in order, so
  words inserted between (a version number, a comment sign) lose nothing.

The three base phrases are reported at every place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .tables import texts

# Base phrases and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The label, telling sentences of the licence, and phrases that must all be there
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance")),
    ("apache", "licensed under the apache license version 2 0", ("licensed under the apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ("all rights reserved",)),
)

SHARE = 0.6  # of a template's words that must stand there in order
VOTES = 3  # rare places of a template that agree where it starts


class Index(NamedTuple):
    words: list[str]
    hashes: np.ndarray  # sorted; position is the word's number
    templates: list[np.ndarray]  # word numbers
    labels: list[str]
    phrases: list[list[tuple[int, int]]]  # (start, length) inside the template
    base: list[tuple[np.ndarray, str]]


def hash_words(text: str) -> tuple[np.ndarray, list[str]]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    s = X.Slice(0, 1, raw, np.array([0, len(raw)], dtype=np.int64))
    w = X.split(s, X.WORD_CHARS)
    return X.word_hashes(s.buf, w), [bytes(raw[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]


def build_index() -> Index:
    known: dict[int, str] = {}
    for text in [t for _, t, _ in TEMPLATES] + [p for p, _ in BASE]:
        known |= dict(zip(map(int, hash_words(text)[0]), hash_words(text)[1], strict=True))
    hashes = np.sort(np.array(list(known), dtype=np.uint64))
    number = lambda text: np.searchsorted(hashes, hash_words(text)[0])
    templates, labels, phrases = [], [], []
    for label, text, keys in TEMPLATES:
        t = number(text)
        spans = []
        for k in map(number, keys):
            at = next(i for i in range(len(t) - len(k) + 1) if (t[i : i + len(k)] == k).all())
            spans.append((at, len(k)))
        templates.append(t)
        labels.append(label)
        phrases.append(spans)
    return Index([known[int(h)] for h in hashes], hashes, templates, labels, phrases, [(number(p), label) for p, label in BASE])


INDEX = build_index()


def licence_words(s: X.Slice) -> tuple[X.Words, np.ndarray]:
    """The slice's words, and for each the number of the licence word it is, or -1."""
    s = s._replace(buf=X.LOWER[s.buf])
    w = X.split(s, X.WORD_CHARS)
    h = X.word_hashes(s.buf, w)
    at = np.searchsorted(INDEX.hashes, h)
    at[at == len(INDEX.hashes)] = 0
    return w, np.where(INDEX.hashes[at] == h, at, -1)


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each licence word: as many counts as the index has words."""
    n = len(INDEX.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(n, dtype=np.int64), 0
        for b in batches:
            seen += b.num_rows
            for s in X.slices(b.column(0)):
                w, v = licence_words(s)
                hit = np.flatnonzero(v >= 0)
                pairs = np.unique(w.row[hit] * n + v[hit])
                total += np.bincount(pairs % n, minlength=n)
        yield pa.record_batch([pa.array(range(-1, n), pa.int32()), pa.array([seen, *total.tolist()], pa.int64())], names=["word", "n"])

    rows = texts(docs, id_col, text_col).select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word: r.n for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(n)], dtype=np.int64)


def places(v: np.ndarray, row: np.ndarray, phrase: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Word numbers in the slice at which a phrase starts, found from every place of its rarest word."""
    k = int(np.argmin(rank[phrase]))
    at = np.flatnonzero(v == phrase[k]) - k
    at = at[(at >= 0) & (at + len(phrase) <= len(v))]
    ok = row[at] == row[at + len(phrase) - 1]
    for j, w in enumerate(phrase):
        ok &= v[at + j] == w
    return at[ok]


def in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            above = best[j]
            best[j] = diagonal + 1 if x == y else max(above, best[j - 1])
            diagonal = above
    return best[-1]


def standing(file: list[int], t: int, p: int, key: int = 0) -> int:
    """Most words of template ``t`` that stand in order in ``file``, its key phrase number ``key`` at ``p``.

    Each later key phrase may stand at a shift of its own, and words may be
    inserted, changed or missing between, up to half a template's length in one
    place; 0 if a key phrase is missing."""
    template, phrases = INDEX.templates[t].tolist(), INDEX.phrases[t]
    slack = len(template) // 2
    a, n = phrases[key]
    before = 0 if key else in_order(template[:a], file[max(0, p - a - slack) : p])
    if key + 1 == len(phrases):
        return before + n + in_order(template[a + n :], file[p + n : p + len(template) - a + slack])
    a2, n2 = phrases[key + 1]
    best = 0
    for q in range(p + n, min(p + a2 - a + slack, len(file) - n2) + 1):
        if file[q : q + n2] == template[a2 : a2 + n2]:
            rest = standing(file, t, q, key + 1)
            best = max(best, before + n + in_order(template[a + n : a2], file[p + n : q]) + rest)
    return best


def rarest(rank: np.ndarray) -> list[np.ndarray]:
    """For each template the places of its words that are looked up, rarest first.

    A file may lack ``1 - SHARE`` of a template's words.  Of these places and
    ``VOTES`` more, at least ``VOTES`` stand in it."""
    out = []
    for t in INDEX.templates:
        spare = len(t) - math.ceil(SHARE * len(t))
        out.append(np.argsort(rank[t], kind="stable")[: spare + VOTES])
    return out


def spread(t: int) -> int:
    """How far the start that the words of template ``t`` tell can differ where it stands: see ``standing``."""
    return (len(INDEX.templates[t]) // 2) * (len(INDEX.phrases[t]) + 1)


class Postings(NamedTuple):
    """By word number: ``at[word] : at[word + 1]`` are its postings' templates and places."""

    at: np.ndarray
    template: np.ndarray
    place: np.ndarray


def postings(looked_up: list[np.ndarray]) -> Postings:
    rows = sorted((int(INDEX.templates[t][p]), t, int(p)) for t, places_ in enumerate(looked_up) for p in places_)
    word, template, place = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
    return Postings(np.searchsorted(word, np.arange(len(INDEX.words) + 1)), template, place)


def candidates(v: np.ndarray, row: np.ndarray, index: Postings) -> Iterator[tuple[int, int, int, int]]:
    """``(template, row, lo, hi)``: stretches of the slice's words ``v`` in which a template's postings agree."""
    hit = np.flatnonzero(v >= 0)
    n = index.at[v[hit] + 1] - index.at[v[hit]]
    at = np.repeat(hit, n)
    if not len(at):
        return
    which = np.repeat(index.at[v[hit]], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    template, place = index.template[which], index.place[which]
    start = at - place
    order = np.lexsort((start, template, row[at]))
    at, template, place, start = at[order], template[order], place[order], start[order]
    key = row[at] * len(INDEX.templates) + template
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for lo, hi in zip(edge, np.append(edge[1:], len(key)), strict=True):
        if hi - lo < VOTES:
            continue
        t, i = int(template[lo]), int(row[at[lo]])
        s, p, f = start[lo:hi], place[lo:hi], at[lo:hi]
        far = np.searchsorted(s, s + spread(t), side="right")
        # places that agree with the posting, counted once each; a place that stands often may hide others no more than that
        enough = [a for a, z in enumerate(far.tolist()) if z - a >= VOTES and len(set(p[a:z].tolist())) >= VOTES]
        reach = len(INDEX.templates[t]) + spread(t)
        begin = end = None
        for a in enough:
            x, y = int(f[a : far[a]].min()) - reach, int(f[a : far[a]].max()) + reach
            if begin is None or x > end:
                if begin is not None:
                    yield t, i, begin, end
                begin, end = x, y
            begin, end = min(begin, x), max(end, y)
        if begin is not None:
            yield t, i, begin, end


def templates_in(v: np.ndarray, row: np.ndarray, first: np.ndarray, rank: np.ndarray, index: Postings) -> Iterator[tuple[int, str, float]]:
    """``(row, label, share)`` of every template that stands in the slice's words ``v``."""
    for t, i, x, y in candidates(v, row, index):
        template = INDEX.templates[t]
        a, n = INDEX.phrases[t][0]
        x, y = max(x, int(first[i])), min(y + 1, int(first[i + 1]))
        for p in (x + places(v[x:y], row[x:y], template[a : a + n], rank)).tolist():
            lo, hi = max(int(first[i]), p - 2 * len(template)), min(int(first[i + 1]), p + 3 * len(template))
            share = standing(v[lo:hi].tolist(), t, p - lo) / len(template)
            if share >= SHARE:
                yield i, INDEX.labels[t], share


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``; null texts count as empty: no words, no labels, score 0.

    ``score`` is the largest share of a licence template that stands in the
    text; a base phrase alone, that no template covers, counts 0.5."""
    n_texts, df = document_frequencies(docs, id_col, text_col)
    idf = np.array([math.log((1 + n_texts) / (1 + int(x))) for x in df])
    rank = np.argsort(np.argsort(-idf, kind="stable"), kind="stable")
    index = postings(rarest(rank))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                w, v = licence_words(s)
                rows = s.hi - s.lo
                first = X.first_of_row(w.count)
                n = np.zeros(rows, dtype=np.int64)
                lo, hi = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, dtype=np.int64)
                base = [set() for _ in range(rows)]
                for phrase, label in INDEX.base:
                    at = places(v, w.row, phrase, rank)
                    r = w.row[at]
                    n += np.bincount(r, minlength=rows)
                    np.minimum.at(lo, r, at - first[r])
                    np.maximum.at(hi, r, at - first[r])
                    for i in np.unique(r).tolist():
                        base[i].add(label)
                labels, score = [set(x) for x in base], np.where(n > 0, 0.5, 0.0)
                for i, label, share in templates_in(v, w.row, first, rank, index):
                    labels[i].add(label)
                    score[i] = max(score[i], share)
                yield pa.record_batch(
                    [b.column(0).slice(s.lo, rows), pa.array(w.count, pa.int64()), pa.array(n), pa.array(lo, mask=n == 0), pa.array(hi, mask=n == 0)]
                    + [pa.array([",".join(sorted(x)) for x in col], pa.string()) for col in (base, labels)]
                    + [pa.array(score)],
                    names=names,
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
