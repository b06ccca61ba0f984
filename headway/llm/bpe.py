"""BPE encoding by backtracking and decoding by an offset table.

A piece of text is tokenised in one walk: an Aho-Corasick automaton over the
vocabulary gives every token that matches anywhere in the piece; from the
current place the longest one is tried first, and it is accepted if it is
compatible with the token before it.  Two tokens are compatible if merging
their concatenation never merges across the border, which a table remembers.
If no token fits, the walk steps back over one token and marks the place as
dead, so each place is left at most once.  A sequence of tokens is the result
of the merges exactly if all neighbours are compatible, so the outcome equals
that of applying the merges in order.

The vocabulary file is that of the ``tokenizers`` library (a path; nothing is
trained or copied).  Texts are normalised and cut into pieces here, as the
file describes: NFC, white space, lower case, the split pattern, bytes.
Special tokens in the raw text stand for themselves.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .tables import lean, small_batches, texts

CACHE_PIECES = 150_000  # pieces in each of the two generations a worker remembers; longer ones than CACHE_CHARS are never kept
CACHE_CHARS = 40
PAIRS = 300_000  # remembered compatibilities
NEVER = 1 << 60
END = 0x10000  # added to the code of a piece's last character: it stands for "character and end of word"

# Letters (hex ranges) of Unicode versions after the vocabulary library's 16.0, which it takes for symbols
NEWER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 "
    "A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Lower case of Unicode 16.0 and 17.0 letters that Python's older tables lack (first, last, distance)
NEWER_LOWER = (
    (0x1C89, 0x1C89, 1),
    (0xA7CB, 0xA7CB, 0x264 - 0xA7CB),
    (0xA7CC, 0xA7CC, 1),
    (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges, split pattern and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # rank of the merge that makes a token
        for r, (a, b) in enumerate(model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            self.rank.setdefault((left, right), r)
            if made not in self.parts:
                self.parts[made], self.born[made] = (left, right), r
        pattern = self._pattern(spec["pre_tokenizer"])
        newer = "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in (x.split("-") for x in NEWER_LETTERS.split()))
        self.lower = {c: chr(c + d) for a, b, d in NEWER_LOWER for c in range(a, b + 1)}
        self.newer = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in NEWER_LOWER) + "]")
        self.find_any = regex.compile(self._classes(pattern, rf"[\p{{L}}--[{newer}]]", r"\p{N}", r"\p{White_Space}", rf"[^\p{{White_Space}}\p{{N}}[\p{{L}}--[{newer}]]]"), regex.V1).findall
        # the same pattern on texts of Latin letters, for the faster engine
        of = {k: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        blank = "".join(f"\\x{c:02x}" for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0))
        self.find_latin = re.compile(self._classes(pattern, f"[{of['L']}]", f"[{of['N']}]", f"[{blank}]", f"[^{blank}{of['L']}{of['N']}]")).findall
        self.latin = re.compile("[\x00-\u017f]*").fullmatch
        self.stop = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        chars = byte_chars()
        self.to_chars = {i: c for i, c in enumerate(chars)}
        self._spine: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.auto = ahocorasick.Automaton()
        whole = self._reachable()
        for text, i in self.ids.items():
            if i in whole:
                self.auto.add_word(text, (len(text), i))
        self.auto.make_automaton()
        self.pieces = Pieces(self)
        # offset table for decoding: every token's text and the space after it
        raw = [t.encode() + b" " for t in self.names]
        self.at = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in raw], out=self.at[1:])
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    @staticmethod
    def _pattern(pre: dict) -> str:
        for p in pre.get("pretokenizers", [pre]):
            if p["type"] == "Split":
                return p["pattern"]["Regex"]
        raise ValueError("the vocabulary file has no split pattern")

    @staticmethod
    def _classes(pattern: str, letter: str, number: str, blank: str, other: str) -> str:
        """The split pattern with its character classes put in other words."""
        for old, new in ((r"[^\s\p{L}\p{N}]", other), (r"[\p{L}]", letter), (r"[\p{N}]", number), (r"\s", blank)):
            pattern = pattern.replace(old, new)
        return pattern

    def symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    # ---- pair compatibility

    def _spine_of(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The outermost tokens on one side while ``token`` is built, each with the rank of the merge that ends it."""
        out = self._spine.get((token, right))
        if out is None:
            out, ends = [], NEVER
            t = token
            while True:
                out.append((t, ends))
                if t not in self.parts:
                    break
                ends, t = self.born[t], self.parts[t][right]
            out.reverse()
            self._spine[token, right] = out
        return out

    def _crossing(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border when ``a`` and ``b`` are built side by side, if there is one."""
        left, right = self._spine_of(a, True), self._spine_of(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.rank.get((x, y))
            # of equal merges the leftmost goes first: x's own one stands left of the border, y's right of it
            if r is not None and r < x_ends and r <= y_ends:
                return r
            if x_ends == y_ends == NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _reachable(self) -> set[int]:
        """The tokens that the merges make of the token's own text."""
        out = {i for i in self.ids.values() if i not in self.parts}
        for n, (token, born) in enumerate(sorted(self.born.items(), key=lambda x: x[1])):
            a, b = self.parts[token]
            if a in out and b in out and self._crossing(a, b) == born == self.rank[a, b]:
                out.add(token)
            if n % 1000 == 0:
                self._spine.clear()  # few are asked for again, and all together are large
        self._spine.clear()
        return out

    def fits(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[a, b] = self._crossing(a, b) is None
        return known

    # ---- encoding

    def encode_symbols(self, text: str) -> list[int]:
        """Tokens of one piece given as symbols."""
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (n, token) in self.auto.iter(text):
            at[end - n + 1].append((n, token))  # shorter ones first
        out: list[tuple[int, int, int]] = []  # token, its length, which of its place's candidates it is
        dead = set()
        place, pick = 0, len(at[0]) - 1
        while place < len(text):
            while pick >= 0:
                n, token = at[place][pick]
                if place + n not in dead and (not out or self.fits(out[-1][0], token)):
                    break
                pick -= 1
            if pick >= 0:
                out.append((token, n, pick))
                place += n
                pick = len(at[place]) - 1 if place < len(text) else -1
            else:
                dead.add(place)
                _, n, pick = out.pop()
                place -= n
                pick -= 1
        return [t for t, _, _ in out]

    def encode_piece(self, piece: str) -> bytes:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        if self.suffix:
            text = text[:-1] + chr(ord(text[-1]) + END)
        ids = self.encode_symbols(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # lower case is by single character
        if self.latin(text):
            found = self.find_latin(text)
        else:
            found = self.find_any(text.translate(self.lower) if self.newer.search(text) else text)
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.stop is None or "<" not in text:
            return self._encode_plain(text)
        out, last = [], 0
        for m in self.stop.finditer(text):
            out.append(self._encode_plain(text[last : m.start()]))
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            last = m.end()
        return b"".join([*out, self._encode_plain(text[last:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' texts joined by one space, as the library gives for a file without a decoder."""
        i = np.frombuffer(ids, dtype="<u4")
        if not len(i):
            return b""
        size = self.at[i + 1] - self.at[i]
        total = np.zeros(len(i) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        where = np.repeat(self.at[i] - total[:-1], size) + np.arange(total[-1])
        return self.bytes[where[:-1]].tobytes()


class Pieces(dict):
    """Encoded pieces, in two generations: when the young one is full it becomes the old one, and that is forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece) or self.vocabulary.encode_piece(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` and the token ids of each text (and its decoded text).

    Null counts as empty and has no tokens.  Every other column stays; columns
    named like the new ones are replaced."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    new = [ids_col] + ([decoded_col] if decoded_col else [])
    keep = docs.drop(*new)
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [v.encode(t or "") for t in part.column(at).to_pylist()]
                size = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=size[1:])
                cols = [pa.ListArray.from_arrays(pa.array(size), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))]
                if decoded_col:
                    cols.append(pa.array([v.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
                yield pa.record_batch([*part.columns, *cols], names=[*part.schema.names, *new])
        # a worker serves the tasks of other stages as well: it does not keep what it remembered for this one
        v.pieces.clear()
        v.pieces.old = {}
        v._fits.clear()
        vocabulary.cache_clear()
        del v

    schema = StructType(keep.schema.fields.copy()).add(ids_col, ArrayType(IntegerType()))
    return keep.mapInArrow(lean(run), schema.add(decoded_col, "string") if decoded_col else schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; null texts count as empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n, one, two = [], [], []
                for t in part.column(1):
                    ids = v.encode(t.as_py() or "")
                    n.append(len(ids) // 4)
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(v.decode(ids)).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
