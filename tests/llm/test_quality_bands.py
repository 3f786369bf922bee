from __future__ import annotations

import base64
import random
import re
import string
from collections import Counter

import pytest
import zstandard
from conftest_llm import ODD

import corpus_pipeline
from pulsegrid.llm import quality_bands as qb


def by_hand(text):
    text = text or ""
    data, words = text.encode(), re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    ratio = len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed, ratio)


def test_counts(corpus, sample):
    texts = [*ODD, *sample.text]
    got = sorted(qb.quality_report(corpus(texts)).collect())
    for row, text in zip(got, texts):
        assert tuple(row)[1:7] == by_hand(text)[:6]
        assert row.ratio == pytest.approx(by_hand(text)[6])
        assert not (row.kept and row.base_failed)


def test_verdict(corpus):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(1500))
    noise = " ".join("".join(rng.choice([chr(c) for c in range(0x4E00, 0x9FFF)]) for _ in range(6)) for _ in range(1500))
    codes = "".join(rng.choice(string.ascii_letters + string.digits) + (" " if rng.random() < .1 else "") for _ in range(1 << 14))
    loop = " ".join(f"row {i % 7} of many and so on" for i in range(1200))
    half_loop = prose + " " + " ".join(rng.choice(["aa", "bb"]) for _ in range(6000))
    kept = {r.doc_id: r.kept for r in qb.quality_report(corpus([prose, noise, codes, loop, half_loop])).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_stage_keeps_clean_documents(spark, corpus):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    docs = corpus([prose, prose, *ODD]).withColumnRenamed("source", "verdict_").withColumnRenamed("lang", "kept")
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()] == [prose, prose]
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), "").count() == 0


def test_base64_tail_is_outside(corpus):
    """Encoded bytes at the end of a clean text count, though they fill no whole chunk."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(3000))
    tail = base64.b64encode(rng.randbytes(6000)).decode()
    texts = [prose[:4150] + tail[:3900], prose[:4096] + tail[:4096], prose[:8050], prose[:4097], prose[:4096]]
    rows = {r.doc_id: r for r in qb.quality_report(corpus(texts)).collect()}
    assert [rows[i].kept for i in range(5)] == [False, False, True, True, True]
    assert [rows[i].n_chunks for i in range(5)] == [2, 2, 2, 2, 1]
