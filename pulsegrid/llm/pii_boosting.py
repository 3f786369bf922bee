"""Personal data by candidate spans and boosted trees, as column expressions from end to end.

Exact patterns give the base spans. Generators of high recall propose more (numbers in groups,
addresses written out, long mixed strings), overlapping or not. Each candidate has yes/no
features of its format and of the text around it. The trees learn from the candidates that the
exact patterns decide (valid or refuted ones), counted over all documents, and score the
undecided; a threshold per kind, calibrated on documents left out of the fitting, selects.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from .boosting import Model, fit, threshold
from .common import free_name, stored

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION, MIN_NEGATIVES = 0.95, 1

# A match starts where the characters before it can't belong to it, or where the last one ended:
# the same matches as without that, but no quadratic search in long runs. Repeated groups are
# possessive, which Java matches in a loop rather than by recursion.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The generators.
ADDRESS = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
           r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+")
NUMBERS = r"(?:(?<![0-9+(])|\G)[+(]{0,2}[0-9][\x20().0-9-]{5,}+"
MIXED = r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{20,}+"

#: Words before a candidate that speak for a kind.
NEARBY = {
    "mail": "mail|contact|write", "call": "call|tel|phone|fax|mobil|number", "pay": "card|visa|credit|pay|amex",
    "host": "host|server|addr|\\bip\\b", "secret": "token|key|secret|passw|pwd|credential", "version": "version|\\bv$|release|section",
}
REACH = 32


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digits' check sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
        d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _small_parts(s: Column) -> Column:
    """Every dotted part is at most 255, leading zeros aside."""
    return F.forall(F.split(s, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (
        F.coalesce(F.try_to_number(F.lpad(q, 3, "0"), F.lit("999")), F.lit(0)) <= 255)))


#: Entries of an array that are folded before they are put to the rest, so that a step copies few.
CHUNK = 256


def folded(items: Column, start: Column, kind: str, fields: list[str], step, before=None) -> Column:
    """The state after ``step(state, item)`` over all ``items``: ``fields`` from ``start`` on, and ``out``, of ``kind``.

    A step puts what it finds to ``out``; what chunks have found is put together at the end.
    ``before(state, items)`` may change the fields where a chunk begins.
    """
    def names(x: Column) -> list[Column]:
        return [x[f].alias(f) for f in fields]

    empty = F.array().cast(kind)

    def of(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / CHUNK).cast("int"))

        def chunk(acc: Column, k: Column) -> Column:
            def run(own: Column) -> Column:
                state = acc if before is None else before(acc, own)
                inner = F.aggregate(own, F.struct(*names(state), empty.alias("out")), step)
                return let(inner, lambda x: F.struct(*names(x), F.concat(acc["out"], F.array(x["out"])).alias("out")))

            return let(F.slice(all_items, k * CHUNK + 1, F.lit(CHUNK)), run)

        begin = F.struct(*names(start), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(all_items) > 0, F.aggregate(numbers, begin, chunk, lambda acc: F.struct(*names(acc), F.flatten(acc["out"]).alias("out")))).otherwise(
            F.struct(*names(start), empty.alias("out")))

    return let(items, of)


def located(text: Column, pattern: str) -> Column:
    """Matches as ``(s, start, end, before, after)``: code points from 0, and what surrounds them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("s"), F.slice(gaps, F.lit(1), F.greatest(F.size(found), F.lit(0))).alias("gap"),
                        F.slice(gaps, F.lit(2), F.greatest(F.size(found), F.lit(0))).alias("next"))
    kind = "array<struct<s:string,start:int,end:int,before:string,after:string>>"
    none = F.array().cast(kind)

    def add(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.length(row["s"])
        span = F.struct(row["s"].alias("s"), start.alias("start"), end.alias("end"),
                        F.lower(F.right(row["gap"], F.lit(REACH))).alias("before"), F.left(row["next"], F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, folded(rows, F.struct(F.lit(0).alias("at")), kind, ["at"], add)["out"]).otherwise(none)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return _small_parts(s)
    digits = F.length(_digits(s))
    if kind == "card":
        return digits.between(12, 19) & _luhn(_digits(s))
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """The spans of the exact patterns that pass their checks, as ``(start, kind number, end)`` in order."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.filter(located(text, pattern), lambda x: _valid(kind, x["s"])), lambda x: _span(kind, x))

    return F.array_sort(F.concat(of("email", EMAIL), of("ip", IP), of("card", CARD), of("phone", PHONE)))


class Feature(NamedTuple):
    name: str
    test: object


def _near(words: str):
    return lambda x: x["before"].rlike(words)


FEATURES = (
    *(Feature(f"near_{n}", _near(w)) for n, w in NEARBY.items()),
    Feature("glued_left", lambda x: x["before"].rlike("[a-z0-9]$")),
    Feature("glued_right", lambda x: x["after"].rlike("[A-Za-z0-9]")),
    Feature("has_digit", lambda x: x["s"].rlike("[0-9]")),
    Feature("has_letter", lambda x: x["s"].rlike("[A-Za-z]")),
    Feature("separated", lambda x: x["s"].rlike("[\\x20().-]")),
    Feature("digits_9_to_11", lambda x: F.length(_digits(x["s"])).between(9, 11)),
    Feature("digits_15_16", lambda x: F.length(_digits(x["s"])).between(15, 16)),
    Feature("in_groups", lambda x: x["s"].rlike("[0-9]{3}[\\x20.)-]+[0-9]{3}[\\x20.-][0-9]{4}$|^([0-9]{4}[\\x20-]){3}[0-9]{4}$")),
    Feature("hexadecimal", lambda x: x["s"].rlike("^[0-9a-f]+$")),
    Feature("several_digits", lambda x: F.length(_digits(x["s"])) >= 4),
    Feature("ends_like_domain", lambda x: x["s"].rlike("(\\.|dot[\\])]\\x20?)[A-Za-z]{2,8}$")),
)


def _candidates(text: Column) -> Column:
    """Proposed spans with packed features and what the exact patterns say: 1, 0 or NULL (undecided)."""
    row = lambda kind, x, start, end, label: F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), label.cast("int").alias("label"),
        sum((F.when(f.test(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FEATURES)), F.lit(0)).alias("bits"))
    decide = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(0))

    def address(x: Column) -> Column:
        """An address, written out or not, ends in a dot and a domain of letters; written out ones that do are undecided."""
        domain, plain = x["s"].rlike("(\\.|[\\[(]dot[\\])]\\x20?)[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]$"), x["s"].contains("@")
        return row("email", x, x["start"], x["end"], decide(domain & plain & ~x["s"].rlike("[\\[(]dot"), ~domain))

    def dotted(x: Column) -> Column:
        return row("ip", x, x["start"], x["end"], decide(_small_parts(x["s"]), ~_small_parts(x["s"])))

    def numbers(x: Column) -> Column:
        """Numbers end at their last digit."""
        kept = F.regexp_extract(x["s"], "^.*[0-9]", 0)
        digits, plus = F.length(_digits(kept)), kept.startswith("+")
        cut = F.struct(kept.alias("s"), x["before"].alias("before"), F.when(F.length(kept) < F.length(x["s"]), F.lit("")).otherwise(x["after"]).alias("after"))
        label = decide(plus & digits.between(9, 15), (digits < 7) | (digits > 15) | ~kept.rlike("[\\x20().-]"))
        return row("phone", cut, x["start"], x["start"] + F.length(kept), label)

    def card(x: Column) -> Column:
        return row("card", x, x["start"], x["end"], decide(_luhn(_digits(x["s"])), ~_luhn(_digits(x["s"]))))

    def mixed(x: Column) -> Column:
        both = x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")
        given = x["before"].rlike("(token|key|secret|passw|pwd|credential)[a-z_]*\\x20?[:=]\\x20?[\"']?$")
        return row("secret", x, x["start"], x["end"], decide(both & given, ~both))

    cards = F.filter(located(text, CARD), lambda x: F.length(_digits(x["s"])).between(12, 19))
    return F.concat(F.transform(located(text, ADDRESS), address), F.transform(located(text, IP), dotted),
                    F.transform(cards, card), F.transform(located(text, NUMBERS), numbers), F.transform(located(text, MIXED), mixed))


class Scorer(NamedTuple):
    model: Model
    #: By kind, the raw score from which a candidate is selected.
    thresholds: tuple[float, ...]


def _table(rows: list, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own = [r for r in rows if r.fold == fold]
    kinds = np.array([r.kind for r in own], int)
    bits = np.array([r.bits for r in own], np.int64)
    x = np.concatenate([(bits[:, None] >> np.arange(len(FEATURES))) & 1, kinds[:, None] == np.arange(len(KINDS))], axis=1) if own else np.zeros((0, len(FEATURES) + len(KINDS)))
    return kinds, x.astype(float), np.array([r.yes for r in own], float), np.array([r.no for r in own], float)


def fit_scorer(found: DataFrame, precision: float = PRECISION) -> Scorer:
    """Trees and thresholds from ``found(fold, candidates)``; fold 1 calibrates, fold 0 fits.

    The counts gathered have at most one row for each pattern of features that occurs, per kind
    and fold. A kind without a refuted candidate in fold 1 selects what the trees give a
    probability of ``precision`` or more, at every size of table.
    """
    decided = found.select("fold", F.inline("candidates")).where("label is not null")
    rows = decided.groupBy("fold", "kind", "bits").agg(
        F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).collect()
    rows.sort(key=lambda r: (r.fold, r.kind, r.bits))
    _, x, yes, no = _table(rows, 0)
    model = fit(x, yes, no)
    kinds, x, yes, no = _table(rows, 1)
    raw = model.raw(x)
    limits = []
    for k in range(len(KINDS)):
        own = kinds == k
        calibrated = no[own].sum() >= MIN_NEGATIVES
        limits.append(threshold(raw[own], yes[own], no[own], precision) if calibrated else float(np.log(precision / (1 - precision))))
    return Scorer(model, tuple(limits))


def _selected(candidates: Column, base: Column, scorer: Scorer) -> Column:
    """Candidates the trees select that no base span holds, as spans; of overlapping ones, those that begin first.

    What ends in no domain is no address, whatever its score.
    """
    def chosen(c: Column) -> Column:
        marks = F.array(*(F.lit(1 << (len(FEATURES) + k)) for k in range(len(KINDS))))
        packed = c["bits"].bitwiseOR(F.element_at(marks, c["kind"] + 1))
        enough = F.element_at(F.array(*(F.lit(float(t)) for t in scorer.thresholds)), c["kind"] + 1)
        refuted = (c["kind"] == KINDS.index("email")) & F.coalesce(c["label"] == 0, F.lit(False))
        return (scorer.model.column(packed) >= enough) & ~refuted

    def ordered(spans: Column, side: int) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(side).alias("side"), c["kind"].alias("kind"), c["end"].alias("end")))

    def step(acc: Column, c: Column) -> Column:
        # ``reach``: where the base spans so far end; ``last``: where the last candidate taken does.
        taken = (c["side"] == 1) & (c["end"] > acc["reach"]) & (c["start"] >= acc["last"])
        own = F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        return F.struct(
            F.when(c["side"] == 0, F.greatest(acc["reach"], c["end"])).otherwise(acc["reach"]).alias("reach"),
            F.when(taken, c["end"]).otherwise(acc["last"]).alias("last"), F.when(taken, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def merged(picked: Column) -> Column:
        both = F.array_sort(F.concat(ordered(base, 0), ordered(picked, 1)))
        start = F.struct(F.lit(-1).alias("reach"), F.lit(-1).alias("last"))
        found = folded(both, start, "array<struct<start:int,kind:int,end:int>>", ["reach", "last"], step)["out"]
        return F.when(F.size(picked) > 0, found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    return let(F.filter(candidates, chosen), merged)


def _with_spans(docs: DataFrame, text_col: str, base: str, added: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with arrays of base and added spans under the two names."""
    fold, raw = free_name(docs, "fold_"), free_name(docs, "candidates_")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each text's own hash deals it to a fold: copies stay together.
    others = [c for c in docs.columns if keep_text or c != text_col]
    found = stored(docs.select(*others, base_spans(text).alias(base), _candidates(text).alias(raw),
                               F.when(F.pmod(F.xxhash64(text), F.lit(3)) == 0, 1).otherwise(0).alias(fold)))
    scorer = fit_scorer(found.select(F.col(fold).alias("fold"), F.col(raw).alias("candidates")))
    return found.withColumn(added, _selected(F.col(raw), F.col(base), scorer)).drop(fold, raw)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: the base spans and all spans of each text, as ``(start, kind, end)``.

    ``kind`` numbers ``KINDS``; positions are code points, ends exclusive; ordered by start, then
    kind. NULL counts as empty: no spans. One row for each row of ``docs``; without rows the trees
    select nothing. Other columns aren't read.
    """
    found = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "base", "added", keep_text=False)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    The columns stay as they are. A NULL text stays NULL.
    """
    base, added = free_name(docs, "base_"), free_name(docs, "added_")
    found = _with_spans(docs, text_col, base, added)
    spans = F.array_sort(F.concat(base, added))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)

    def part(acc: Column, own: Column) -> Column:
        """The text from where the last chunk ended to the last span of this one, so that spans are cut from little."""
        end = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        return F.struct(acc["at"].alias("at"), acc["at"].alias("from"), F.substring(text, acc["at"] + 1, end - acc["at"]).alias("part"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(
            F.substring(acc["part"], acc["at"] - acc["from"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["from"].alias("from"), acc["part"].alias("part"),
                        F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit("").alias("part"))
    done = let(folded(spans, begin, "array<string>", ["at", "from", "part"], add, part), lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).select(*docs.columns)
