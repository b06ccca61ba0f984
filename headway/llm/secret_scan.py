"""Secret scan with a token-efficiency test.

Key words, access-key prefixes and long hex runs give the base spans.  The
test adds what no pattern names: runs of key characters that a public BPE
vocabulary can only spell in short pieces.  Text of any natural language, and
code, needs few tokens for its characters; random strings need about one for
every one and a half.  A run is tested as a whole, then, since words before or
behind a secret hide it, by its least efficient stretches of whole parts between
separators.  Before the test, known digests (by length or label), UUIDs, numbers
and dotted or worded identifiers are excluded; a long part of letters of one case
is left to the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .tables import lean, small_batches, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
Span = tuple[str, int, int]

MIN_RANDOM = 20  # characters
MAX_RATIO = 2.0  # characters a token; at or above, the run is language

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the shorter ones that fail need no match of their own
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_LABELLED = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|integrity|checksum|digest|etag|commit|rev)[\x20:=\"'-]{1,3}\Z", re.IGNORECASE)
_PREFIXED = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5)[-_=]", re.IGNORECASE)
_WORDED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
_LONG = re.compile(r"[A-Za-z]{%d,}" % MIN_RANDOM)
_PART = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]+")
_PUBLIC = re.compile(r"(?<![A-Za-z0-9])(?:%s|%s)(?![A-Za-z0-9])" % (_UUID.pattern, _DIGEST.pattern))
_KINDS_OF_CHARS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})


def known(text: str, start: int, end: int) -> bool:
    """Digests and identifiers that look random but are public."""
    s = text[start:end]
    if _DIGEST.fullmatch(s) or _UUID.fullmatch(s) or s.strip("=_-+/").isdigit() or _WORDED.fullmatch(s) and not _LONG.search(s):
        return True
    return bool(_LABELLED.search(text, max(0, start - 16), start) or _PREFIXED.match(s))


def random_looking(s: str, path: str) -> bool:
    if sum(bool(k.search(s)) for k in _KINDS_OF_CHARS) < 2 and not _LONG.search(s):
        return False
    return len(s) < MAX_RATIO * len(encoding(path).encode_ordinary(s))


def outside(spans: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """What sorted ``spans`` leave of ``start`` to ``end``."""
    for x, y in spans:
        if x < end and start < y:
            if start < x:
                yield start, x
            start = y
    if start < end:
        yield start, end


def stretches(text: str, start: int, end: int, path: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole parts, ``MIN_RANDOM`` characters or more, that the vocabulary spells worst; the worst first, then beside it.

    The encoding never joins letters, digits and separators, so the tokens of the parts add up."""
    parts = [m.span() for m in _PART.finditer(text, start, end)]
    worse = [0.0]  # by part: tokens above those of language, summed
    for a, b in parts:
        worse.append(worse[-1] + MAX_RATIO * len(encoding(path).encode_ordinary(text[a:b])) - (b - a))
    todo = [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        best, found, least, i = 0.0, None, None, lo
        for j in range(lo, hi):
            while i <= j and parts[j][1] - parts[i][0] >= MIN_RANDOM:
                if text[parts[i][0]].isalnum() and (least is None or worse[i] < worse[least]):
                    least = i
                i += 1
            if least is not None and text[parts[j][0]].isalnum() and worse[j + 1] - worse[least] > best:
                best, found = worse[j + 1] - worse[least], (least, j)
        if found:
            yield parts[found[0]][0], parts[found[1]][1]
            todo += [(lo, found[0]), (found[1] + 1, hi)]


def find(text: str, path: str) -> list[Span]:
    """All spans by start, then kind as listed (code points, end exclusive)."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in out)
    for m in _RUN.finditer(text):
        for a, b in outside(base, *m.span()):
            if b - a < MIN_RANDOM or known(text, a, b):
                continue
            if random_looking(text[a:b], path):
                out.append(("random", a, b))
                continue
            public = [p.span() for p in _PUBLIC.finditer(text, a, b)]
            for x, y in (s for c, d in outside(public, a, b) for s in stretches(text, c, d, path)):
                if not known(text, x, y) and random_looking(text[x:y], path):
                    out.append(("random", x, y))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, path: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked, and the length in ``chars_col`` set anew where a text changed.

    Null texts and all other columns stay as they are; no row goes."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [None if t is None else mask(t, find(t, path)) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if n_at is not None:
                n = [c if x == y else len(y) for c, x, y in zip(b.column(n_at).to_pylist(), old, new, strict=True)]
                b = b.set_column(n_at, b.schema.field(n_at), pa.array(n, b.schema.field(n_at).type))
            yield b

    return docs.mapInArrow(lean(run), docs.schema)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for every row of ``docs``: counts, digest and list of the spans.

    Null texts count as empty.  Repeated rows and null ids are kept."""
    path = path or default_path()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, spans = {k: [] for k in KINDS}, [], []
            for t in b.column(1):
                found = find(t.as_py() or "", path)
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in found))
                sha.append(hashlib.sha256(joined([s for s in found if s[0] in BASE]).encode()).hexdigest())
                spans.append(joined(found))
            counts = [pa.array(n[k], pa.int64()) for k in KINDS]
            yield pa.record_batch([b.column(0), *counts[:3], pa.array(sha, pa.string()), pa.array(spans, pa.string()), counts[3]], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
