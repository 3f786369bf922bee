from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest_llm import ODD

from pulsegrid.llm import seekable_frames as sf


def expected(doc_id, text):
    """The definition, on whole strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(12)
    made = [*ODD, "\n", "\n\n", "a\n", "\na", "<", "<P", "P>", "<S>", "a<M>b", "<P<S", "x" * (sf.FRAME - 1) + "<P>", "é😀" * sf.FRAME, "\n" * (2 * sf.FRAME + 1),
            "line\n" * 9000, "y" * sf.FRAME + "\n" + "z" * sf.FRAME]
    for _ in range(200):
        made.append("".join(rng.choice("ab\n<>PSM é😀") for _ in range(rng.randrange(60))))
    made.append("".join(rng.choice("ab\n <é😀") for _ in range(400_000)))
    return made


def test_against_whole_strings(spark, corpus):
    values = texts()
    docs = corpus(values).union(corpus(["one\ntwo\n", None], ids=[None, None])).union(corpus(["a\nb\nc"] * 3, ids=[7, 7, 7]))
    rows = docs.withColumnRenamed("source", "output").collect()
    want = sorted((str((r.doc_id, *expected(r.doc_id, r.text))) for r in rows))
    assert sorted(str(tuple(r)) for r in sf.fill_in_middle(docs.withColumnRenamed("source", "output")).collect()) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(str((r.doc_id, *e[:4], sha(e[4]), sha(r.text or ""))) for r in rows for e in [expected(r.doc_id, r.text)])
    assert sorted(str(tuple(r)) for r in sf.fill_in_middle_digests(docs).collect()) == want
    assert {e[1] for r in rows for e in [expected(r.doc_id, r.text)]} == {"plain", "psm", "spm"}


def test_ids_beyond_doubles_and_strings(spark):
    docs = spark.createDataFrame([(2**62 + 1, "a\nb"), (None, "a\nb")], "frames long, h string")
    got = {r.doc_id: r for r in sf.fill_in_middle(docs, "frames", "h").collect()}
    assert set(got) == {2**62 + 1, None} and got[2**62 + 1].output == expected(2**62 + 1, "a\nb")[4]
    named = sf.fill_in_middle(spark.createDataFrame([("k", "a\nb")], "doc_id string, text string")).collect()
    assert [r.doc_id for r in named] == ["k"] and named[0].output == expected("k", "a\nb")[4]


def test_empty_table(corpus):
    assert sf.fill_in_middle_digests(corpus([])).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_frames_of_any_size(monkeypatch, size):
    """Cuts and restoring are the same however frames fall, and a cut opens one frame."""
    monkeypatch.setattr(sf, "FRAME", size)
    rng = random.Random(size)
    for _ in range(300):
        text = "".join(rng.choice("ab\n<>PSMé") for _ in range(rng.randrange(25)))
        frames = sf.Frames.stored(sf.Frames.of(text).rows())
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert frames.n_units() == len(units) and "".join(frames.pieces(0, frames.size)) == text
        opened = []
        plain = frames.frame
        frames.frame = lambda i: opened.append(i) or plain(i)
        for k in range(len(units) + 1):
            opened.clear()
            assert frames.cut(k) == len("".join(units[:k])) and len(opened) <= 1
        frames.frame = plain
        for h in ([rng.randrange(99), rng.randrange(99), 0, 0], [rng.randrange(99), rng.randrange(99), 0, 99]):
            cut = sf.Cut(frames, h, 100, 50)
            assert (cut.form == "plain") == (not text or any(m in text for m in sf.MARKERS))
            assert "".join(sf.restored(cut.output_frames(), cut.form)) == text


def test_rate_leaves_texts_plain(corpus):
    forms = [r.form for r in sf.fill_in_middle(corpus([f"a\nb{i}" for i in range(200)]), rate=30).collect()]
    assert 100 < forms.count("plain") < 180
