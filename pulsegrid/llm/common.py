"""What the operators of this subpackage share: reading, storing, and hashes of byte runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


#: Bytes of an Arrow batch, so that a task's Python side holds little of long texts at once.
_BATCH, _BATCH_SETTING = "2MB", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches where the session still has Spark's own, larger default."""
    if spark.conf.get(_BATCH_SETTING) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH_SETTING, _BATCH)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder all executors share, and read again.

    Cuts the lineage: what follows neither repeats the work nor depends on the executors that
    did it.
    """
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*frames: DataFrame | None) -> None:
    """Deletes what ``stored`` wrote for ``frames``, from which nothing is read any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


# ---- runs of bytes or words as 64-bit hashes ------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of the two bases, kept up to a length.
_KEPT, _KEPT_LENGTH = {}, 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    kept = _KEPT.get(base)
    if kept is not None and n <= len(kept):
        return kept[:n]
    size = max(n, _KEPT_LENGTH)
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if size == _KEPT_LENGTH:
        _KEPT[base] = out
    return out[:n]


class Runs:
    """Hashes of any run of ``values`` (uint64), each from two entries of a running sum."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_ODD, n), out=self.total[1:])
        self.back = _powers(_INVERSE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` values."""
        n = len(self.total) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return self.hashes(at, at + k)


def byte_runs(data: np.ndarray) -> Runs:
    return Runs(_VALUE[data])


def bytes_of(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of each text, of none for a missing one."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def packs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes, so that arrays stay small; a longer text is one range."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts laid end to end.

    ``is_word`` tells for each byte value whether it belongs to a word. ``starts`` and ``ends``
    are byte positions, ``first[i]`` the number of words before text ``i``.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = np.concatenate([[0], is_word[self.data].astype(np.int8), [0]])
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return byte_runs(self.data).hashes(self.starts, self.ends)


def byte_class(keep) -> np.ndarray:
    return np.fromiter((bool(keep(b)) for b in range(256)), bool, 256)


#: Bytes of words between white space, and of words of letters and digits (of lower-cased text).
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LETTER_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


# ---- filters of a fixed size ----------------------------------------------------------------

#: Bits of a filter, whatever it holds. It only spares work: what passes it is joined exactly, and
#: a fuller one lets more through.
FILTER_BITS = 1 << 24


def filter_slots(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``size`` bits for each 64-bit value."""
    size = np.uint64(size)
    return (values % size).astype(np.int64), ((values >> np.uint64(32)) % size).astype(np.int64)


def seed_filter(values: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A filter of the long column ``seed`` of ``values``, for the tasks of a scan: ``size`` flags.

    What comes to the driver are bitmaps of ``size`` bits together, not values.
    """
    seed = F.col("seed")
    # Unsigned remainders: the low bits of the two halves.
    low, high = seed.bitwiseAND(size - 1), F.shiftrightunsigned(seed, 32).bitwiseAND(size - 1)
    places = values.select(F.explode(F.array(low, high)).alias("place"))
    maps = places.groupBy(F.floor(F.col("place") / 32768).alias("n")).agg(
        F.bitmap_construct_agg(F.pmod("place", F.lit(32768))).alias("bits")).collect()
    flags = np.zeros(max(size, 32768), bool)
    for row in maps:
        flags[row.n * 32768:(row.n + 1) * 32768] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little").astype(bool)
    return flags[:size]
