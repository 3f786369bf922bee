"""Change detection and news de-duplication on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType

from ..functions.keywords import Term
from ..operators.changes import HOMEPAGE, Policy, change_records
from ..operators.latest import latest_per_key, snapshot_pairs
from ..session import cut_lineage, shared_dir


def with_bucket(rows: DataFrame, buckets: int, key: str = "company_id") -> DataFrame:
    """``rows`` with the column ``bucket`` by which an archive is to be partitioned."""
    return rows.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))


class ChangeFeed:
    """A change record for every new snapshot against the one before it, batch by batch.

    The state is the newest version per key, as ids and checksums only: page texts stay in
    the ``archive`` table and are fetched for changed pairs. Each batch writes its records
    and state into folders of its own number, so a batch that is run again replaces what
    it wrote. Snapshots not newer than their key's state are late: they get no record, and go to
    the folder ``<records_dir>-late`` with the time of the state they came after.

    With ``buckets`` the archive is partitioned by ``with_bucket`` of that many, and so is the
    state: a batch then reads the buckets of its own companies only.
    """

    def __init__(
        self, spark: SparkSession, records_dir: str, state_dir: str, archive: Callable[[], DataFrame],
        policy: Policy = HOMEPAGE, terms: Sequence[Term] | None = None, compact_every: int = 100,
        buckets: int | None = None,
    ) -> None:
        self.spark, self.records_dir, self.state_dir = spark, records_dir, state_dir
        self.archive, self.policy, self.terms = archive, policy, terms
        self.compact_every, self.buckets = compact_every, buckets

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def state_before(self, batch_id: int) -> DataFrame | None:
        """The newest version per key as of the batches before ``batch_id``."""
        base = (batch_id - 1) // self.compact_every * self.compact_every if batch_id > 0 else 0
        parts = [f"{self.state_dir}/full={base}"] + [f"{self.state_dir}/batch={n}" for n in range(base, batch_id)]
        present = [p for p in parts if self._exists(p)]
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(p) for p in present)) if present else None

    def _own_buckets(self, rows: DataFrame, wanted: list[int]) -> DataFrame:
        return rows.filter(F.col("bucket").isin(wanted)).drop("bucket") if self.buckets else rows

    def _write_state(self, rows: DataFrame, path: str) -> None:
        if self.buckets:
            with_bucket(rows, self.buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        wanted: list[int] = []
        if self.buckets:  # at most as many numbers as there are buckets
            batch = with_bucket(batch, self.buckets)
            wanted = [r.bucket for r in batch.select("bucket").distinct().collect()]
        keys = list(self.policy.keys)
        slim = batch.select(*keys, *self.policy.carried, "id", "captured_at", "content_checksum", "error_message",
                            F.col("content_markdown").isNotNull().alias("has_content"))
        history = self.state_before(batch_id)
        rows = slim
        if history is not None:
            touched = self._own_buckets(history, wanted).join(slim.select(*keys).distinct(), keys, "left_semi")
            last = latest_per_key(touched, keys, ["captured_at", "id"])
            mark = last.select(*keys, F.struct("captured_at", "id").alias("__last"))
            marked = slim.join(mark, keys, "left")
            is_fresh = F.col("__last").isNull() | (F.struct("captured_at", "id") > F.col("__last"))
            fresh = marked.filter(is_fresh).drop("__last")
            marked.filter(~is_fresh).withColumn("state_at", F.col("__last.captured_at")).drop("__last").write.mode(
                "overwrite").parquet(f"{self.records_dir}-late/batch={batch_id}")
            rows = fresh.unionByName(last.select(*fresh.columns))
        pairs = snapshot_pairs(
            rows, keys, "all", carry=("content_checksum", "error_message", "has_content", *self.policy.carried))
        source = self._own_buckets(self.archive(), wanted)
        records = change_records(
            source, F.lit(None), policy=self.policy, terms=self.terms, pairing="all", pairs=pairs)
        times = rows.select(F.col("id").alias("snapshot_id_new"), F.col("captured_at").alias("detected_at"))
        stamped = records.drop("detected_at").join(times, "snapshot_id_new")
        stamped.write.mode("overwrite").parquet(f"{self.records_dir}/batch={batch_id}")
        newest = latest_per_key(rows, keys, ["captured_at", "id"])
        self._write_state(newest, f"{self.state_dir}/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            everything = self.state_before(batch_id + 1)
            everything = everything.drop("bucket") if self.buckets else everything
            self._write_state(latest_per_key(everything, keys, ["captured_at", "id"]), f"{self.state_dir}/full={batch_id + 1}")

    def start(self, snapshots: DataFrame, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        writer = snapshots.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint or f"{shared_dir(self.spark)}/change_feed")
        return (writer.trigger(**trigger) if trigger else writer).start()


class UrlMemory:
    """URLs known for ever, and filters that tell which of them need not be looked up.

    URLs lie by bucket of their hash and batch; next to them lies, for each bucket, a filter of ``bits``
    bits with two places for every URL. A batch tests its URLs on the filters and opens only buckets
    where one may be known; an URL that is new is one on its filter but for rare cases, so what
    a batch reads is level while the memory grows, as long as the filters aren't full (take more buckets
    then). Everything a batch writes is in folders of its number; running it again replaces that.
    """

    def __init__(self, spark: SparkSession, path: str, url: str = "content_url", buckets: int = 64, bits: int = 1 << 20, compact_every: int = 100) -> None:
        self.spark, self.path, self.url, self.buckets, self.bits, self.compact_every = spark, path, url, buckets, bits, compact_every
        self.opened: list[str] = []

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """``url, bucket``, a row for each of ``rows``."""
        return rows.select(self.url, F.pmod(F.xxhash64(F.col(self.url)), F.lit(self.buckets)).cast("int").alias("bucket"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """``url, bucket, place`` for both places of each URL; places count bits, in chunks of 32768."""
        places = F.array(*(F.pmod(F.xxhash64(F.col(self.url), F.lit(k)), F.lit(self.bits)) for k in (1, 2)))
        return self.bucketed(rows).withColumn("place", F.explode(places))

    def _filters(self, batch_id: int) -> DataFrame | None:
        """``bucket, chunk, bits`` as of the batches before ``batch_id``."""
        base = (batch_id - 1) // self.compact_every * self.compact_every if batch_id > 0 else 0
        parts = [f"{self.path}/filters/full={base}"] + [f"{self.path}/filters/batch={n}" for n in range(base, batch_id)]
        present = [p for p in parts if self._exists(p)]
        if not present:
            return None
        return self.spark.read.schema("bucket int, chunk bigint, bits binary").parquet(*present).groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))

    def known(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """Those of the URLs in ``rows`` that a batch before ``batch_id`` has brought; None if there can be none."""
        self.opened = []
        filters = self._filters(batch_id)
        if filters is None:
            return None
        placed = self.placed(rows).withColumn("chunk", F.floor(F.col("place") / 32768))
        at = F.pmod("place", F.lit(32768)).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # Chunks that a batch doesn't touch are pruned by the join's keys, or by their statistics.
        tested = placed.join(filters, ["bucket", "chunk"], "left").select(
            self.url, "bucket", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)).alias("set"))
        maybe = cut_lineage(tested.groupBy(self.url, "bucket").agg(F.bool_and("set").alias("maybe")).where("maybe").select(self.url, "bucket"))
        wanted = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most as many as there are buckets
        self.opened = [p for p in (f"{self.path}/urls/bucket={b}" for b in sorted(wanted)) if self._exists(p)]
        if not self.opened:
            return None
        kept = self.spark.read.schema(rows.select(self.url).schema.add("batch", IntegerType())).option("basePath", f"{self.path}/urls").parquet(*self.opened)
        return kept.where(F.col("batch") < batch_id).select(self.url).join(maybe.select(self.url), self.url, "left_semi")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Remembers the URLs of ``rows`` as brought by ``batch_id``."""
        placed = self.placed(rows)
        urls = self.bucketed(rows).distinct().withColumn("batch", F.lit(batch_id)).hint("rebalance", "bucket")
        urls.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/urls")
        made = placed.groupBy("bucket", F.floor(F.col("place") / 32768).alias("chunk")).agg(
            F.bitmap_construct_agg(F.pmod("place", F.lit(32768))).alias("bits"))
        made.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self._filters(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/filters/full={batch_id + 1}")


def stream_dedupe_news(
    articles: DataFrame, out_dir: str, checkpoint: str | None = None, url: str = "content_url", time: str = "discovered_at",
    memory: UrlMemory | None = None, **trigger,
) -> StreamingQuery:
    """Writes the first article of each URL to ``out_dir``; a URL is known for ever, however late it comes again.

    Each batch is matched with ``memory`` (``<out_dir>-known`` if not given), of which it opens only what
    may hold its URLs, and written into a folder of its own number, so a batch that is run again
    replaces what it wrote.
    """
    spark = articles.sparkSession
    memory = memory or UrlMemory(spark, f"{out_dir}-known", url)

    def process(batch: DataFrame, batch_id: int) -> None:
        order = F.struct(*[F.col(c) for c in dict.fromkeys((time, *batch.columns))])
        first = batch.filter(F.col(url).isNotNull()).groupBy(url).agg(F.min(order).alias("__first")).select(
            *[F.col("__first")[c].alias(c) for c in batch.columns])
        known = memory.known(first.select(url), batch_id)
        if known is not None:
            first = first.join(known, url, "left_anti").select(*batch.columns)
        first.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        memory.add(spark.read.schema(batch.select(url).schema).parquet(f"{out_dir}/batch={batch_id}"), batch_id)

    writer = articles.writeStream.foreachBatch(process).option(
        "checkpointLocation", checkpoint or f"{shared_dir(spark)}/news_feed")
    return (writer.trigger(**trigger) if trigger else writer).start()
