from __future__ import annotations

import os

import pytest

WIDE = "doc_id long, text string, lang string, spans string, score string, token string, _text string"


@pytest.fixture(scope="session")
def larger_dir(sf_dir) -> str:
    """Tables large enough to train on."""
    return os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")


@pytest.fixture(scope="session")
def odd_texts() -> list:
    """Null, empty, blank, short, repeated and very long texts."""
    passage = "The quick brown fox jumps over the lazy dog while seven wizards boil 99 onions daily. "
    return [None, "", "   \n\t", "One", "one two three", passage, passage, passage.upper(), passage * 3000, "\x00 ▁ á \U0001f600"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts, with null and repeated ids and with columns whose names clash with results."""
    rows = [(i, text, None if i % 2 else "en", "s", "x", "t", "u") for i, text in enumerate(odd_texts)]
    rows += [(None, "the same null id", "en", "s", "x", "t", "u"), rows[5]]
    return spark.createDataFrame(rows, WIDE).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], WIDE)
