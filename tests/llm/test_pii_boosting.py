from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from conftest_llm import ODD

from pulsegrid.llm import pii_boosting as pb
from pulsegrid.llm.boosting import fit, threshold

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def by_hand(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), number, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y a.b+c@d-e.co.uk.", "😀 mail me: é jo@x.org, 1.2.3.4.5 and 256.1.1.1 or 007.08.0255.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559x", "+1 (743) 555-3824 +12 +1234567890123456 +1 2 3 4 5 6 7 8 9)",
    "1 " * 6000 + "5105105105105100", "9" * 30000, "a" * 30000 + "@", "x@y.z" * 500, "call +49 30 1234567 or (030) 123-456-7890.",
]


def test_base_spans(corpus, sample):
    texts = [*ODD, *TRICKY, *sample.text]
    got = sorted(pb.find_personal_data(corpus(texts)).collect(), key=lambda r: r.doc_id)
    for row, text in zip(got, texts):
        base, spans = [tuple(s) for s in row.base], [tuple(s) for s in row.spans]
        assert base == by_hand(text)
        assert set(base) <= set(spans) and spans == sorted(spans)
    assert pb.find_personal_data(corpus([])).count() == 0


def test_trees_add_secrets_and_leave_prose(corpus):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'some words then token = "{key(i)}" and a thoroughlyinterconnectedword{"x" * (i % 5)} here {i}' for i in range(200)]
    texts += [f"password: {key(1000 + i)} mail a{i}@b.com" for i in range(40)]
    rows = pb.find_personal_data(corpus(texts)).collect()
    for r in rows:
        text = texts[r.doc_id]
        found = {(text[s.start:s.end], pb.KINDS[s.kind]) for s in r.spans}
        assert {(x, "secret") for x in re.findall("[0-9a-f]{40}", text)} <= found
        assert not any("word" in t for t, _ in found)


def test_addresses_written_out_in_a_small_clean_table(corpus):
    """No address is refuted here, and still the written out one is found; what has no domain isn't one."""
    texts = [f"some words, mail ann{i}.b@host{i}.org and more of it" for i in range(30)]
    texts += ["please mail jo [at] example [dot] org today", "we meet [at] noon (at) nine"]
    rows = {r.doc_id: [(texts[r.doc_id][s.start:s.end], pb.KINDS[s.kind]) for s in r.spans] for r in pb.find_personal_data(corpus(texts)).collect()}
    assert rows[30] == [("jo [at] example [dot] org", "email")]
    assert rows[31] == []
    clean = [*texts[:30], texts[30]]
    rows = {r.doc_id: [clean[r.doc_id][s.start:s.end] for s in r.spans] for r in pb.find_personal_data(corpus(clean)).collect()}
    assert rows[30] == ["jo [at] example [dot] org"]


def test_redaction(corpus):
    docs = corpus(["to jo@x.org or 1.2.3.4, é +1 (743) 555-3824.", None, "", "nothing here"]).withColumnRenamed("source", "base_").withColumnRenamed("lang", "fold_")
    out = pb.redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "to [EMAIL] or [IP], é [PHONE].", 1: None, 2: "", 3: "nothing here"}
    assert pb.redact(docs.limit(0)).count() == 0


def test_boosting_learns_a_table():
    x = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)], float)
    truth = x[:, 0].astype(bool) & ~x[:, 1].astype(bool)
    yes, no = np.where(truth, 90.0, 3.0), np.where(truth, 2.0, 80.0)
    raw = fit(x, yes, no).raw(x)
    assert raw[truth].min() > 2 > -2 > raw[~truth].max()
    limit = threshold(raw, yes, no, 0.95)
    assert ((raw >= limit) == truth).all()
    assert threshold(raw, yes * 0, no, 0.95) == float("inf")


def test_column_equals_model(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (40, 6)).astype(float)
    model = fit(x, rng.integers(1, 9, 40).astype(float), rng.integers(1, 9, 40).astype(float))
    bits = (x @ (1 << np.arange(6))).astype(int)
    rows = spark.createDataFrame([(int(b),) for b in bits], "b int").select(model.column(F.col("b")).alias("v")).collect()
    assert [r.v for r in rows] == pytest.approx(model.raw(x).tolist())


def test_a_text_of_very_many_matches(corpus):
    """A log of tens of thousands of addresses: the work is in proportion, the spans and the redacted text whole."""
    import time

    def log(n):
        return "".join(f"user{k}@host.org 10.0.{k % 300}.7 ok\n" for k in range(n))

    def seconds(n):
        began = time.time()
        row = pb.find_personal_data(corpus([log(n)])).first()
        assert [tuple(s) for s in row.base] == by_hand(log(n))
        return time.time() - began

    seconds(10)
    few, many = seconds(5000), seconds(50000)
    assert many < 25 * few + 10
    done = pb.redact(corpus([log(20000)])).first().text
    assert done == re.sub(r"10\.0\.([01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])\.7", "[IP]", re.sub(r"user\d+@host\.org", "[EMAIL]", log(20000)))


def test_added_spans_by_hand(spark, monkeypatch):
    """Selection and merging against a list form: no base span holds them, none overlaps the one before."""
    import random

    rng = random.Random(7)
    monkeypatch.setattr(pb, "CHUNK", 4)
    rows = []
    for k in range(300):
        base = sorted((a, rng.randrange(4), a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(12))))
        picked = [(a, rng.randrange(5), a + rng.randrange(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randrange(14)))]
        rows.append((k, base, [(*c, rng.randrange(2) == 0) for c in picked]))
    schema = "k int, base array<struct<start:int,kind:int,end:int>>, c array<struct<start:int,kind:int,end:int,good:boolean>>"
    df = spark.createDataFrame(rows, schema)

    class Model:
        @staticmethod
        def column(packed):
            return packed.cast("double")

    from pyspark.sql import functions as F

    cands = F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast("int").alias("label"),
                                                F.when(x["good"], F.lit(0).cast("bigint")).otherwise(F.lit(-1 << 62)).alias("bits")))
    scorer = pb.Scorer(Model, (0.0,) * len(pb.KINDS))
    got = {r.k: [tuple(s) for s in r.x] for r in df.select("k", pb._selected(cands, F.col("base"), scorer).alias("x")).collect()}
    for k, base, c in rows:
        want = []
        for a, kind, b, good in sorted(c):
            if good and not any(x <= a and b <= y for x, _, y in base) and not (want and want[-1][2] > a):
                want.append((a, kind, b))
        assert got[k] == want
