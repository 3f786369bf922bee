"""Added lines in order: two versions aligned natively on the lines that both have once.

Lines that stand once in each version are anchors; the longest series of anchors that keeps its order
in both is kept, so a line that was moved is one line gone and one added. From each anchor the match is
carried on as long as the lines beside it agree, which places repeated lines. What lies between
two matches is aligned in the same way once more, and what then is left is matched first come,
first served.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.common import ColumnOrName, col, let
from ..functions.text import lines

_PAIR = "struct<o:int,n:int>"
#: Steps of a binary search; enough for any number of lines.
_STEPS = 31


def _anchors(old: Column, new: Column) -> Column:
    """Places of the lines that both have once, by place in ``old``."""
    def tagged(text: Column, side: int) -> Column:
        return F.transform(text, lambda x, i: F.struct(x.alias("x"), F.lit(side).alias("side"), i.alias("i")))

    def once(all_lines: Column) -> Column:
        def of(item: Column, k: Column) -> Column:
            at = lambda d: F.get(all_lines, k + d)
            alone = ~F.coalesce(at(-1)["x"] == item["x"], F.lit(False)) & ~F.coalesce(at(2)["x"] == item["x"], F.lit(False))
            met = (item["side"] == 0) & F.coalesce((at(1)["x"] == item["x"]) & (at(1)["side"] == 1), F.lit(False))
            return F.when(alone & met, F.struct(item["i"].alias("o"), at(1)["i"].alias("n")))

        return F.array_sort(F.array_compact(F.transform(all_lines, of)))

    return let(F.array_sort(F.concat(tagged(old, 0), tagged(new, 1))), once)


def _longest_rising(pairs: Column) -> Column:
    """The longest series of ``pairs`` (by ``o``) in which ``n`` rises; ends of series by length, found by halving."""
    start = F.struct(F.array().cast("array<struct<n:int,k:int>>").alias("ends"), F.array().cast("array<int>").alias("before"))

    def step(acc: Column, k: Column, all_pairs: Column) -> Column:
        n = F.get(all_pairs, k)["n"]
        # How many ends lie below n: the first place whose end doesn't.
        low = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(F.lit(0).alias("a"), F.size(acc["ends"]).alias("b")), lambda s, _: let(
            F.floor((s["a"] + s["b"]) / 2).cast("int"), lambda m: F.when(s["a"] >= s["b"], s).when(
                F.get(acc["ends"], m)["n"] < n, F.struct((m + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b")))),
            lambda s: s["a"])
        return let(low, lambda at: F.struct(
            F.concat(F.slice(acc["ends"], F.lit(1), at), F.array(F.struct(n.alias("n"), k.alias("k"))),
                     F.slice(acc["ends"], at + 2, F.greatest(F.size(acc["ends"]) - at - 1, F.lit(0)))).alias("ends"),
            F.concat(acc["before"], F.array(F.when(at > 0, F.get(acc["ends"], at - 1)["k"]))).alias("before")))

    def of(all_pairs: Column) -> Column:
        numbers = F.when(F.size(all_pairs) > 0, F.sequence(F.lit(0), F.size(all_pairs) - 1)).otherwise(F.array().cast("array<int>"))
        grown = F.aggregate(numbers, start, lambda acc, k: step(acc, k, all_pairs))

        def back(g: Column) -> Column:
            first = F.struct(F.get(g["ends"], F.size(g["ends"]) - 1)["k"].alias("k"), F.array().cast("array<int>").alias("kept"))
            walked = F.aggregate(g["ends"], first, lambda s, _: F.struct(
                F.get(g["before"], s["k"]).alias("k"), F.concat(s["kept"], F.array(s["k"])).alias("kept")), lambda s: s["kept"])
            return F.transform(F.reverse(walked), lambda k: F.get(all_pairs, k))

        return let(grown, back)

    return let(pairs, of)


def _run(old: Column, new: Column, o: Column, n: Column, limit: Column, step: int) -> Column:
    """How many lines agree from ``o`` and ``n`` on, or before them, ``limit`` at most."""
    at = (lambda i: (o + i, n + i)) if step > 0 else (lambda i: (o - 1 - i, n - 1 - i))
    same = lambda i: F.get(old, at(i)[0]).eqNullSafe(F.get(new, at(i)[1]))
    numbers = F.when(limit > 0, F.sequence(F.lit(0), limit - 1)).otherwise(F.array().cast("array<int>"))
    # The first line that differs ends it.
    return F.coalesce(F.get(F.filter(numbers, lambda i: ~same(i)), F.lit(0)), F.greatest(limit, F.lit(0)))


def _gaps(old: Column, new: Column, kept: Column) -> Column:
    """``array<struct<o, n, olen, nlen>>``: what lies before, between and after the pairs, without lines that agree at either end."""
    edge = lambda o, n: F.array(F.struct(o.cast("int").alias("o"), n.cast("int").alias("n")))
    ends = F.concat(edge(F.lit(-1), F.lit(-1)), kept, edge(F.size(old), F.size(new)))

    def gap(pairs: Column, k: Column) -> Column:
        a, b = F.get(pairs, k), F.get(pairs, k + 1)
        space = F.least(b["o"] - a["o"], b["n"] - a["n"]) - 1
        return let(_run(old, new, a["o"] + 1, a["n"] + 1, space, 1), lambda head: let(
            _run(old, new, b["o"], b["n"], space - head, -1), lambda tail: F.struct(
                (a["o"] + 1 + head).alias("o"), (a["n"] + 1 + head).alias("n"),
                (b["o"] - a["o"] - 1 - head - tail).alias("olen"), (b["n"] - a["n"] - 1 - head - tail).alias("nlen"))))

    return let(ends, lambda pairs: F.filter(F.transform(F.sequence(F.lit(0), F.size(pairs) - 2), lambda k: gap(pairs, k)), lambda g: g["nlen"] > 0))


def _left(old: Column, new: Column) -> Column:
    """Lines of ``new`` that aren't matched when each takes the first equal one of ``old`` behind the last match."""
    def step(acc: Column, line: Column) -> Column:
        found = F.array_position(F.slice(old, acc["at"], F.greatest(F.size(old) - acc["at"] + 1, F.lit(0))), line).cast("int")
        return F.when(found > 0, F.struct((acc["at"] + found).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(acc["at"].alias("at"), F.concat(acc["out"], F.array(line)).alias("out")))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(new, start, step, lambda acc: acc["out"])


def _added(old: Column, new: Column, depth: int) -> Column:
    def of_gap(g: Column) -> Column:
        o = F.slice(old, g["o"] + 1, g["olen"])
        n = F.slice(new, g["n"] + 1, g["nlen"])
        return let(o, lambda a: let(n, lambda b: _left(a, b) if depth == 0 else F.when(F.size(a) == 0, b).otherwise(_added(a, b, depth - 1))))

    return F.flatten(F.transform(let(_longest_rising(_anchors(old, new)), lambda kept: _gaps(old, new, kept)), of_gap))


def line_added_in_order(old: ColumnOrName, new: ColumnOrName) -> Column:
    """Lines of ``new`` that the alignment with ``old`` doesn't match, in order, joined by newlines.

    Unlike ``line_added``, lines that were moved or stand more often than before count. NULL counts as
    empty. Nothing is left out that ``old`` doesn't have; without these lines ``new`` stands in ``old``
    in order.
    """
    before, after = (lines(F.coalesce(col(c), F.lit(""))) for c in (old, new))
    return F.array_join(let(before, lambda o: let(after, lambda n: _added(o, n, 1))), "\n")
