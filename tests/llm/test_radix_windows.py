from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD

from pulsegrid.llm import radix_windows as rw


def by_hand(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats():
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, texts = [line(n) for n in (40, 70, 90, 200)], []
    for _ in range(60):
        texts.append(line(rng.randint(0, 120)) + rng.choice(shared)[rng.randint(0, 9):] + line(rng.randint(0, 120)) + rng.choice(shared))
    near = list(texts[0] * 2)
    for _ in range(40):
        near[rng.randrange(len(near))] = rng.choice("xyz")
        texts.append("".join(near))
    return [*texts, texts[1], texts[1], "ab" * 300, "q" * 500]


@pytest.mark.parametrize("part", [1 << 18, 64])
def test_against_brute_force(corpus, monkeypatch, part):
    monkeypatch.setattr(rw, "PART", part)
    texts = [*texts_with_repeats(), *(t for t in ODD if len(t or "") < 100)]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    got = sorted(tuple(r) for r in rw.repeat_digests(corpus(texts, ids), width=60, gram=8).collect())
    assert got == sorted((i, *row) for i, row in zip(ids, by_hand(texts, 60)))


def test_production_width(corpus, sample):
    texts = [*ODD[:6], *sample.text, ODD[7]]
    got = sorted(tuple(r) for r in rw.repeat_digests(corpus(texts)).collect())
    assert got == [(i, *row) for i, row in enumerate(by_hand(texts, rw.WIDTH))]


def test_kept_bytes_and_spans(corpus):
    passage = "".join(chr(97 + i * i % 23) for i in range(500))
    rows = sorted(rw.remove_repeats(corpus(["before " + passage + " after", passage, None], ids=[None, 1, 2])).collect(), key=str)
    found = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in rows}
    assert found == {None: ([(7, 507)], b"before  after"), 1: ([(0, 500)], b""), 2: ([], b"")}
    assert rw.remove_repeats(corpus([])).count() == 0
