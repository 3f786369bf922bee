from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest_llm import ODD

from pulsegrid.llm import language_mixture as lm

EN = "the quick brown fox jumps over the lazy dog while the children were watching from their house on the other side of this river".split()
DE = "der schnelle braune fuchs springt über den faulen hund während die kinder von ihrem haus auf der anderen seite zuschauen".split()


def text(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def two(spark):
    rows = [(text(w, 80, s), g) for s in range(30) for g, w in (("en", EN), ("de", DE))] + [("no language", None), (None, "xx"), ("123", "yy")]
    return lm.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_learns_languages_with_letters_only(two):
    assert two.languages == ("de", "en")
    assert np.allclose(two.probabilities.sum(axis=1), 1)


def test_single_and_mixed(two):
    assert set(lm.mixture(two, text(EN, 60, 99))) == {1}
    assert set(lm.mixture(two, text(DE, 60, 99))) == {0}
    mixed = lm.mixture(two, text(EN, 120, 7) + ". " + text(DE, 60, 8))
    assert set(mixed) == {0, 1} and mixed[1] == pytest.approx(2 / 3, abs=0.1)
    assert sum(mixed.values()) == pytest.approx(1)


def test_em_never_loses_likelihood():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3)
    counts = rng.integers(1, 9, 50).astype(float)
    values = []
    for steps in range(1, 15):
        share = np.full(3, 1 / 3)
        for _ in range(steps):
            share = share * (p @ (counts / (share @ p))) / counts.sum()
        values.append(counts @ np.log(share @ p))
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))
    share, value = lm._proportions(p, counts, np.full(3, 1 / 3))
    assert share.sum() == pytest.approx(1) and value == pytest.approx(values[lm.STEPS - 1])


def test_odd_rows(corpus, two):
    rows = {r.doc_id: r for r in lm.identify(corpus(ODD), two).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        letters = t is not None and any(c.isalpha() for c in t)
        assert (rows[i].lang_pred == "und") == (not letters)
        assert 0 <= rows[i].score <= 1
    assert lm.identify_held_out(corpus([])).count() == 0
    assert {r.lang_pred for r in lm.identify_held_out(corpus(ODD)).collect()} == {"und"}  # nothing learned


def test_held_out_accuracy(corpus, sample):
    docs = corpus(list(sample.text), list(sample.doc_id), list(sample.lang))
    truth = dict(zip(sample.doc_id, sample.lang))
    rows = lm.identify_held_out(docs).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_predictions_read_the_text_alone(corpus, sample):
    """Held-out rows' language has no influence, nor have ids and sources."""
    ids = list(sample.doc_id)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
    langs = ["zz" if h else g for h, g in zip(held, sample.lang)]
    a = lm.identify_held_out(corpus(list(sample.text), ids, list(sample.lang))).collect()
    b = lm.identify_held_out(corpus(list(sample.text), ids, langs)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
