"""Personal data by anchor expansion.

One Aho-Corasick pass over each text stops at anchors only: at-signs, scheme
marks, digits, plus signs before digits, and words that announce an account
or an address.  At an anchor a small local parser expands to the left and
right, finds the exact borders and validates: domains, octets, Luhn digits,
the length of a phone number, IBAN check digits, a street type after a house
number.  Text without anchors costs the one pass.

Kinds, in order: email, ip, card, phone (leftmost, not overlapping within a
kind), then url (a scheme with user data), account and address, which this
method adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import small_batches, texts

KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE = KINDS[:4]
Span = tuple[str, int, int]

# Words that announce an account number, and street types (lower case)
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "routing", "passport", "ssn")
STREET_TYPES = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "square", "straße", "strasse", "calle", "rue")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_USERINFO = re.compile(r"[^\s/@:?#<>\"']{1,64}:[^\s/@?#<>\"']{1,64}@[A-Za-z0-9.-]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
_NUMBER_AFTER = re.compile(r"[\s:#.]{0,4}(?:(?:no|number|nr|id)[.:\s]{1,3})?((?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)|[0-9][0-9-]{5,18}[0-9])(?![A-Za-z0-9])")
_HOUSE_BEFORE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[a-z]?,?\x20(?:[A-ZÄÖÜÉÈ][\w.'-]{0,30}\x20){0,3}\Z")
_HOUSE_AFTER = re.compile(r"(?:\x20[A-ZÄÖÜÉÈa-z][\w.'-]{0,30}){0,4}\x20[0-9]{1,5}(?![0-9])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for d in "0123456789":
        auto.add_word(d, ("digit", 1))
        auto.add_word("+" + d, ("phone", 2))
    auto.add_word("@", ("email", 1))
    auto.add_word("://", ("url", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("address", STREET_TYPES)):
        for w in cues:
            for form in {w, w.capitalize(), w.upper()}:
                auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[Span]:
    """All spans of ``text``, by kind and then start (code points, end exclusive)."""
    out: dict[str, list[Span]] = {}
    after = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    digit_end = 0

    def add(kind: str, start: int, end: int) -> None:
        out.setdefault(kind, []).append((kind, start, end))

    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at < digit_end:
                continue
            digit_end = _DIGITS.match(text, at).end()
            if at >= after["card"]:
                m = _CARD.match(text, at)
                after["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
            if at >= after["ip"]:
                m = _IP.match(text, at)
                after["ip"] = m.end() if m else digit_end
                # a part of more digits than int() takes is far over 255
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    add("ip", at, m.end())
        elif kind == "phone":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    add("phone", at, m.end())
        elif kind == "email":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
                after["email"] = m.end()
        elif kind == "url":
            if (s := _SCHEME.search(text, max(0, at - 16), at)) and (m := _USERINFO.match(text, at + 3)):
                add("url", s.start(), m.end())
        elif kind == "account":
            if at >= after["account"] and (m := _NUMBER_AFTER.match(text, last + 1)):
                if m[1][0].isdigit() or iban(m[1]):
                    add("account", m.start(1), m.end(1))
                    after["account"] = m.end(1)
        elif at >= after["address"]:
            b = _HOUSE_BEFORE.search(text, max(after["address"], at - 110), at)
            m = None if b else _HOUSE_AFTER.match(text, last + 1)
            if b or m:
                start, end = (b.start(), last + 1) if b else (at, m.end())
                add("address", start, end)
                after["address"] = end
    return [s for k in KINDS for s in out.get(k, ())]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``[kind]``."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` masked; null stays null, all other columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else mask(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: counts, digest and list of the spans, and the masked text's digest.

    Null texts count as empty: no spans, the digest of nothing.  Repeated rows and null ids are kept."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, spans, added = {k: [] for k in BASE}, [], [], []
            for t in b.column(1):
                found = find(t.as_py() or "")
                base = [s for s in found if s[0] in BASE]
                for k in BASE:
                    n[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                added.append(len(found) - len(base))
            yield pa.record_batch([b.column(0), *(pa.array(n[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
