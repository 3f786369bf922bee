from __future__ import annotations

import random
from bisect import bisect_left
from collections import Counter

import pytest

from pulsegrid.operators.line_order import line_added_in_order


def rising(pairs):
    ends, keys, before = [], [], []
    for k, (_, n) in enumerate(pairs):
        at = bisect_left(ends, n)
        before.append(keys[at - 1] if at else None)
        ends[at:at + 1], keys[at:at + 1] = [n], [k]
    out, k = [], keys[-1] if keys else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def added(old, new, depth=1):
    """The definition, on lists."""
    a, b = Counter(old), Counter(new)
    anchors = rising([(i, new.index(x)) for i, x in enumerate(old) if a[x] == 1 == b[x]])
    out = []
    for (o, n), (p, q) in zip([(-1, -1), *anchors], [*anchors, (len(old), len(new))]):
        o, n = o + 1, n + 1
        while o < p and n < q and old[o] == new[n]:
            o, n = o + 1, n + 1
        while o < p and n < q and old[p - 1] == new[q - 1]:
            p, q = p - 1, q - 1
        gap, rest = old[o:p], new[n:q]
        if depth and gap and rest:
            out += added(gap, rest, depth - 1)
            continue
        at = 0
        for x in rest:
            if x in gap[at:]:
                at = gap.index(x, at) + 1
            else:
                out.append(x)
    return out


def run(spark, pairs):
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return {r.k: r.d for r in df.select("k", line_added_in_order("a", "b").alias("d")).collect()}


def in_order(short, long):
    rest = iter(long)
    return all(any(x == y for y in rest) for x in short)


@pytest.mark.parametrize("letters, length", [("abcdefghijklmnopqrstuvwxyz", 14), ("abc", 10), ("abcdefgh", 25)])
def test_against_lists(spark, letters, length):
    rng = random.Random(length)
    pairs = []
    for _ in range(250):
        old = [rng.choice(letters) for _ in range(rng.randrange(1, length))]
        new = list(old)
        for _ in range(rng.randrange(5)):
            kind, at = rng.randrange(4), rng.randrange(len(new) + 1)
            if kind == 0:
                new.insert(at, rng.choice(letters + "XYZ"))
            elif kind == 1 and new:
                new.pop(at % len(new))
            elif kind == 2 and new:
                new.insert(rng.randrange(len(new)), new.pop(at % len(new)))
            elif new:
                new[at % len(new)] = rng.choice(letters)
        pairs.append((old, new or ["x"]))
    got = run(spark, pairs)
    for k, (old, new) in enumerate(pairs):
        want = added(old, new)
        assert got[k] == "\n".join(want), (old, new)
        rest = list(new)
        for x in want:
            rest.remove(x)
        assert Counter(rest) + Counter(want) == Counter(new)
        assert not Counter(x for x in new if x not in old) - Counter(want)


def test_moved_and_repeated_lines_count(spark):
    got = run(spark, [("abcd", "bcda"), ("ab", "aab"), ("abc", "abc"), ("", "ab"), ("ab", ""), ("axbxc", "axbxcx")])
    assert got == {0: "a", 1: "a", 2: "", 3: "a\nb", 4: "", 5: "x"}
    df = spark.createDataFrame([(None, "a\r\nb"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(line_added_in_order("a", "b")).collect()] == ["a\nb", ""]


def test_long_pages(spark):
    """Thousands of lines, many moved, end in seconds."""
    rng = random.Random(1)
    old = [f"line {k}" for k in range(4000)]
    new = list(old)
    for _ in range(200):
        new.insert(rng.randrange(len(new)), new.pop(rng.randrange(len(new))))
    new[1000:1000] = ["fresh"] * 3
    assert run(spark, [(old, new)])[0] == "\n".join(added(old, new))
