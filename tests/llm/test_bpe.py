"""The backtracking encoder against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    return bpe.vocabulary(path), tokenizers.Tokenizer.from_file(path)


def same(pair, text):
    own, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, text
    assert own.decode(got).decode() == library.decode(ids, skip_special_tokens=False), text


def test_equals_the_library_on_mixed_texts(pair):
    rng = random.Random(1)
    pools = ["abcdeth'sin ", "aAΣσςİıßéñÅ Å한글あ漢字1²½٣", "\u0085​ \x1c\x1f\t\n a", "😀👍🏽é́́'ll're 'S", "thinersation", "zzzaaaaaa"]
    for _ in range(3000):
        same(pair, "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else rng.choice(["<|endoftext|>", "<|startoftext|>", "<|"]) for _ in range(rng.randint(0, 60))))


def test_equals_the_library_on_every_kind_of_character(pair):
    for c in [*range(0xD800), *range(0xE000, 0x30000, 3), *NEW]:
        same(pair, f"a{chr(c)}b")


NEW = [0x558, 0x88F, 0x1C89, 0xA7CB, 0xA7DC, 0x10D50, 0x16EA0, 0x323B0, 0x3D000]


def test_equals_the_library_on_long_pieces(pair):
    rng = random.Random(2)
    for n in (1, 50, 500, 3000):
        same(pair, "".join(rng.choice("abe") for _ in range(n)))
        same(pair, "a" * n)
        same(pair, "!" * n)


def test_round_trip_of_words(pair):
    own, _ = pair
    text = "the reference implementation of tokenization"
    assert own.decode(own.encode(text)).replace(b"</w> ", b" ").replace(b"</w>", b"").decode().split(" ")[0] == "the"


ROWS = [(1, None), (2, ""), (3, "Hello <|endoftext|> World"), (3, "Hello <|endoftext|> World"), (None, "x y"), (4, "word " * 20000)]


def test_table(docs, pair):
    _, library = pair
    df = docs(ROWS).withColumn("n_tokens", F.lit("x")).withColumn("token_ids", F.lit(None).cast("int"))
    expected = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.digests(df).collect()), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(docs([])).count() == 0
    out = bpe.encoded(df, decoded_col="back")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "token_ids", "back"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.back == library.decode(ids, skip_special_tokens=False)
