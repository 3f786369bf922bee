"""Fill-in-middle transformation over texts kept as independent zstandard frames.

A text is stored as frames of ``FRAME`` characters, each compressed on its own, with the number of
characters and of finished lines before it. Where a unit ends is found by those cumulative counts
and in one decompressed frame only; digests read the frames in order, one at a time. The rearranged
text is written as frames as well, so that its restoring is the same reading in another order.

Units are lines (with their newline; the last may have none). Form and cuts depend on the id alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of a frame, and the level of its compression.
FRAME, LEVEL = 1 << 14, 1
#: What stands before the prefix, the suffix and the middle of a rearranged text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts, how many are rearranged, and of those how many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Salt of the hash that decides on form and cuts.
SALT = "7:"

_FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"
_FRAMES_ARROW = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


class Frames:
    """A text in frames: ``units`` and ``chars`` are the lines ended and the characters before each frame, and at the end."""

    def __init__(self) -> None:
        self.units, self.chars, self.data = [0], [0], []
        self._open: list[str] = []
        self._held = 0

    @classmethod
    def of(cls, text: str) -> Frames:
        made = cls()
        made.write(text)
        return made.close()

    @classmethod
    def stored(cls, rows: list[dict]) -> Frames:
        """From the rows of a ``frames`` column, the last of which holds the totals and no data."""
        made = cls()
        made.units, made.chars = [r["units"] for r in rows], [r["chars"] for r in rows]
        made.data = [r["data"] for r in rows[:-1]]
        return made

    def rows(self) -> list[dict]:
        return [{"units": u, "chars": c, "data": d} for u, c, d in zip(self.units, self.chars, [*self.data, None])]

    def write(self, text: str) -> None:
        at = 0
        while at < len(text):
            part = text[at:at + FRAME - self._held]
            self._open.append(part)
            self._held += len(part)
            at += len(part)
            if self._held == FRAME:
                self._seal()

    def close(self) -> Frames:
        if self._held:
            self._seal()
        return self

    def _seal(self) -> None:
        text = "".join(self._open)
        self.data.append(_packer().compress(text.encode("utf-8", "surrogatepass")))
        self.units.append(self.units[-1] + text.count("\n"))
        self.chars.append(self.chars[-1] + len(text))
        self._open, self._held = [], 0

    @property
    def size(self) -> int:
        return self.chars[-1]

    def frame(self, i: int) -> str:
        return _opener().decompress(self.data[i]).decode("utf-8", "surrogatepass")

    def n_units(self) -> int:
        """Lines, the last one counted also if nothing ends it."""
        return self.units[-1] + (bool(self.data) and not self.frame(len(self.data) - 1).endswith("\n"))

    def cut(self, k: int) -> int:
        """Characters of the first ``k`` units; one frame at most is decompressed."""
        if k <= 0:
            return 0
        if k > self.units[-1]:
            return self.size
        i = bisect_left(self.units, k) - 1
        text, at = self.frame(i), -1
        for _ in range(k - self.units[i]):
            at = text.index("\n", at + 1)
        return self.chars[i] + at + 1

    def pieces(self, start: int, end: int) -> Iterator[str]:
        """The characters from ``start`` to ``end``, frame by frame."""
        i = max(bisect_right(self.chars, start) - 1, 0)
        while i < len(self.data) and self.chars[i] < end:
            yield self.frame(i)[max(start - self.chars[i], 0):end - self.chars[i]]
            i += 1

    def find(self, marks: tuple[str, ...]) -> dict[str, int]:
        """Where each of ``marks`` stands first, also across the ends of frames."""
        found: dict[str, int] = {}
        kept, reach = "", max(map(len, marks)) - 1
        for i in range(len(self.data)):
            text = kept + self.frame(i)
            for m in marks:
                if m not in found and (at := text.find(m)) >= 0:
                    found[m] = self.chars[i] - len(kept) + at
            if len(found) == len(marks):
                break
            kept = text[-reach:] if reach else ""
        return found


_TOOLS: dict[str, object] = {}


def _packer() -> zstandard.ZstdCompressor:
    return _TOOLS.setdefault("packer", zstandard.ZstdCompressor(level=LEVEL))


def _opener() -> zstandard.ZstdDecompressor:
    return _TOOLS.setdefault("opener", zstandard.ZstdDecompressor())


def _ordered(form: str, prefix: tuple, middle: tuple, suffix: tuple) -> list[tuple[str, tuple]]:
    """Markers and ranges in the order of ``form``."""
    parts = [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
    return parts if form == "psm" else [parts[1], parts[0], parts[2]]


def rearranged(text: Frames, form: str, start: int, end: int) -> Iterator[str]:
    """The output for a text whose middle is ``start`` to ``end``, in pieces of a frame at most."""
    if form == "plain":
        yield from text.pieces(0, text.size)
        return
    for marker, (a, b) in _ordered(form, (0, start), (start, end), (end, text.size)):
        yield marker
        yield from text.pieces(a, b)


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text that ``output`` was made from, in pieces, from the output and its form alone.

    A marker in an output that isn't plain is the only one of its kind: the text holds none, and
    none can come about where text and marker meet.
    """
    if form == "plain":
        yield from output.pieces(0, output.size)
        return
    at = output.find(MARKERS)
    ends = sorted([*at.values(), output.size])
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from output.pieces(at[marker] + len(marker), ends[ends.index(at[marker]) + 1])


def _digest(pieces: Iterator[str]) -> str:
    made = hashlib.sha256()
    for p in pieces:
        made.update(p.encode("utf-8", "surrogatepass"))
    return made.hexdigest()


class Cut:
    """How one stored text is rearranged, by the four numbers of its id."""

    def __init__(self, text: Frames, h: list[int], rate: int, suffix_first: int) -> None:
        self.text, self.n = text, text.n_units()
        a, b = sorted((h[0] % (self.n + 1), h[1] % (self.n + 1)))
        if not text.data or h[2] % 100 >= rate or text.find(MARKERS):
            self.form, self.start, self.end = "plain", None, None
        else:
            self.form = "spm" if h[3] % 100 < suffix_first else "psm"
            self.start, self.end = text.cut(a), text.cut(b)

    def output(self) -> Iterator[str]:
        return rearranged(self.text, self.form, self.start, self.end)

    def output_frames(self) -> Frames:
        made = Frames()
        for piece in self.output():
            made.write(piece)
        return made.close()

    def head(self) -> tuple:
        plain = self.form == "plain"
        return self.n, self.form, self.start, None if plain else self.end - self.start


def _frame_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a row a batch: one text's frames at a time
            row = batch.slice(i, 1)
            frames = Frames.of(row.column(2)[0].as_py() or "").rows()
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([frames], _FRAMES_ARROW)], ["doc_id", "h", "frames"])


def _cut_batches(batches: Iterator[pa.RecordBatch], rate: int, suffix_first: int, last: Callable, kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            cut = Cut(Frames.stored(batch.column(2)[i].as_py()), batch.column(1)[i].as_py(), rate, suffix_first)
            rows.append((*cut.head(), *last(cut)))
        made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(name for name, _ in kinds)])


def _digests(cut: Cut) -> tuple[str, str]:
    output = cut.output_frames()
    return _digest(output.pieces(0, output.size)), _digest(restored(output, cut.form))


def _text(cut: Cut) -> tuple[str]:
    return ("".join(cut.output()),)


def id_numbers(doc_id: Column) -> Column:
    """Four numbers of 32 bits from the id; a missing id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)))


def seekable_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, frames`` for each row: the numbers of its id, and its text as frames.

    ``frames`` has ``units``, ``chars`` (lines ended and characters before the frame) and ``data``
    (zstandard); its last entry holds the totals. NULL counts as empty, which has that entry alone.
    One row for each row of ``docs``, repeated ones included; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), id_numbers(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_frame_batches, f"doc_id {kind}, h array<bigint>, frames {_FRAMES}")


_HEAD = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _cuts(docs: DataFrame, id_col: str, text_col: str, rate: int, suffix_first: int, last: Callable, names: list[str]) -> DataFrame:
    kinds = [*_HEAD, *((n, pa.string()) for n in names)]
    fields = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in kinds)
    kind = docs.schema[id_col].dataType.simpleString()
    return seekable_frames(docs, id_col, text_col).mapInArrow(
        partial(_cut_batches, rate=rate, suffix_first=suffix_first, last=last, kinds=kinds), f"doc_id {kind}, {fields}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row.

    ``form`` is ``psm`` (markers and prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain``: the text as it stands, if it is NULL, empty, holds a marker, or by ``rate``; lengths
    are NULL then. One row for each row of ``docs``; no rows for an empty table.
    """
    return _cuts(docs, id_col, text_col, rate, suffix_first, _text, ["output"])


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``: what
    ``fill_in_middle`` gives and what is restored from it, as digests; nothing is held whole."""
    return _cuts(docs, id_col, text_col, rate, suffix_first, _digests, ["output_sha256", "restored_sha256"])


def fill_in_middle_sql() -> str:
    """DuckDB SQL for the rows of ``fill_in_middle_digests`` over ``documents``."""
    h = lambda i: f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)"
    head = lambda k: f"CASE WHEN {k} = 0 THEN '' WHEN {k} = n THEN t ELSE array_to_string(parts[1:{k}], chr(10)) || chr(10) END"
    marked = " OR ".join(f"contains(t, '{m}')" for m in MARKERS)
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
b AS (SELECT *, string_split(t, chr(10)) AS parts,
      length(t) - length(replace(t, chr(10), '')) + (CASE WHEN t = '' OR suffix(t, chr(10)) THEN 0 ELSE 1 END) AS n FROM a),
c AS (SELECT *, least({h(0)} % (n + 1), {h(1)} % (n + 1)) AS k1, greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) AS k2,
      CASE WHEN t = '' OR {marked} OR {h(2)} % 100 >= {RATE} THEN 'plain' WHEN {h(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, {head("k1")} AS p, {head("k2")} AS pm FROM c),
f AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM f"""
