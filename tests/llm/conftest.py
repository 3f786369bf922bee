from __future__ import annotations

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark):
    """A table of documents from texts; ids count from 0."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest test table."""
    pq = pytest.importorskip("pyarrow.parquet")
    try:
        return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
    except FileNotFoundError:
        pytest.skip("test tables absent")
