"""Helpers of the training-data operators' tests."""

import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Build a documents table from ``{id: text}`` or ``[(id, text)]``; one row or more per partition."""

    def build(rows, parts=2):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)

    return build


SPACE_WORDS = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
