"""Change detection on a stream in event time: versions wait in keyed state until their turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.keywords import Term
from ..operators.changes import HOMEPAGE, Policy, change_records
from ..session import cut_lineage, shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that are put into a key's state in one call.
ROWS_AT_ONCE = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VersionPairs(StatefulProcessor):
    """A pair of versions for every version of a key but its first, in order of time and id.

    A version waits until the watermark has passed it; the timer of the first one waiting then takes all
    up to the watermark in order of time and id, pairs each with the one before, and sets itself for the
    next one. So a key is gone through once for every time the watermark moves, not once for each
    version. State is what waits and the last version of each key, without page texts.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str], version: StructType) -> None:
        self.keys, self.columns, self.version = list(keys), list(columns), version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.version)
        self.waiting = handle.getListState("waiting", StructType([StructField("__at", LongType()), *self.version]))
        self.due = handle.getValueState("due", "at bigint")

    def _wait_for(self, at: int) -> None:
        """The one timer of the key is that of its first version waiting."""
        before = self.due.get()[0] if self.due.exists() else None
        if before is not None and before <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while part := [(int(r["__at"]), *(r[c] for c in self.columns)) for r in islice(rows, ROWS_AT_ONCE)]:
            self.waiting.appendList(part)
            first = min([row[0] for row in part] + ([] if first is None else [first]))
        if first is not None:
            self._wait_for(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        place = 1 + self.columns.index("id")
        # A version that came again replaces itself.
        ready, later = {}, {}
        for row in self.waiting.get():
            (ready if row[0] // 1000 <= until else later)[row[0], row[place]] = tuple(row)
        self.due.clear()
        if later:
            self.waiting.put(list(later.values()))
            self._wait_for(min(later)[0] // 1000)
        else:
            self.waiting.clear()
        before = tuple(self.last.get()) if self.last.exists() else None
        names = [*self.keys, *(f"old_{c}" for c in self.columns), *(f"new_{c}" for c in self.columns)]
        for at in sorted(ready):
            now = ready[at][1:]
            if before is not None:
                yield Row(**dict(zip(names, (*key, *before, *now))))
            before = now
        if ready:
            self.last.update(before)

    def close(self) -> None:
        pass


def version_pairs(snapshots: DataFrame, keys: Sequence[str], carry: Sequence[str], delay: str = "1 day") -> DataFrame:
    """The pairs of ``snapshot_pairs(mode="all")`` for a stream: ``<keys>, old_<c>, new_<c>`` for id, time and ``carry``.

    Versions may come in any order within ``delay``; ones that come later than that get no pair
    (Spark counts them as dropped by the watermark). A pair is given once the watermark passes its
    newer version.
    """
    columns = list(dict.fromkeys(["id", "captured_at", *carry]))
    at = F.col("captured_at").cast("timestamp")
    timed = snapshots.select(*keys, *columns, at.alias("__event"), F.unix_micros(at).alias("__at")).withWatermark("__event", delay)
    version = StructType([snapshots.schema[c] if c in snapshots.columns else timed.schema[c] for c in columns])
    shape = StructType([*(snapshots.schema[k] for k in keys), *(StructField(f"{side}_{f.name}", f.dataType) for side in ("old", "new") for f in version)])
    return timed.groupBy(*keys).transformWithState(VersionPairs(keys, columns, version), shape, "Append", "EventTime")


class KeyedChangeFeed:
    """A change record for every version against the one before it, in event time.

    Pairs come from keyed state with timers (``version_pairs``), so nothing is kept in folders but the
    records of each batch; texts are fetched from ``archive`` for changed pairs. A batch that is run again
    replaces its records. ``partitions`` is the number of state partitions of a new checkpoint (that of
    shuffles if not given). Starting anew with the same ``checkpoint`` goes on where the last run stopped.
    """

    def __init__(
        self, spark: SparkSession, records_dir: str, archive: Callable[[], DataFrame], policy: Policy = HOMEPAGE,
        terms: Sequence[Term] | None = None, delay: str = "1 day", partitions: int | None = None,
    ) -> None:
        self.spark, self.records_dir, self.archive, self.policy, self.terms, self.delay, self.partitions = (
            spark, records_dir, archive, policy, terms, delay, partitions)

    def process(self, pairs: DataFrame, batch_id: int) -> None:
        pairs = cut_lineage(pairs)  # the state is read once, however often the pairs are
        if pairs.isEmpty():
            return
        records = change_records(self.archive(), F.lit(None), policy=self.policy, terms=self.terms, pairing="all", pairs=pairs)
        times = pairs.select(F.col("new_id").alias("snapshot_id_new"), F.col("new_captured_at").alias("detected_at"))
        records.drop("detected_at").join(times, "snapshot_id_new").write.mode("overwrite").parquet(f"{self.records_dir}/batch={batch_id}")

    def start(self, snapshots: DataFrame, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        marked = snapshots.withColumn("has_content", F.col("content_markdown").isNotNull())
        carry = ("content_checksum", "error_message", "has_content", *self.policy.carried)
        # Timers need this store; a query keeps what holds at its start, the number of state partitions too.
        wanted = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(self.partitions)} if self.partitions else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            pairs = version_pairs(marked, list(self.policy.keys), carry, self.delay)
            writer = pairs.writeStream.outputMode("append").foreachBatch(self.process).option(
                "checkpointLocation", checkpoint or f"{shared_dir(self.spark)}/keyed_change_feed")
            return (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
