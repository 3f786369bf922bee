from __future__ import annotations

import datetime as dt
import random

from pulsegrid.operators.changes import change_records
from pulsegrid.streaming.keyed import KeyedChangeFeed

NOW = dt.datetime(2024, 2, 1)
SNAPSHOT = "id long, company_id long, captured_at timestamp_ntz, content_markdown string, content_checksum string, error_message string"
COLUMNS = ["company_id", "snapshot_id_old", "snapshot_id_new", "has_changed", "change_magnitude", "significance_classification", "detected_at"]


def test_stream_out_of_order_with_restarts_equals_batch(spark, tmp_path):
    place = f"file:{tmp_path}"
    rng = random.Random(4)
    data = [(i, i % 5, NOW + dt.timedelta(hours=i // 2), f"text {i % 7} lawsuit" * (i % 3), str(i % 7), None) for i in range(80)]
    archive = spark.createDataFrame(data, SNAPSHOT)
    # Each part holds versions up to ten hours away from their place, newer ones before older ones.
    arrival = sorted(data, key=lambda r: r[0] + rng.randrange(20))
    end = [(1000, 77, NOW + dt.timedelta(days=30), "x", "x", None), (1001, 77, NOW + dt.timedelta(days=60), "x", "x", None)]
    feed = KeyedChangeFeed(spark, f"{place}/records", lambda: archive, delay="12 hours")
    for part in (arrival[:30], arrival[30:55], arrival[55:], end[:1], end[1:]):
        rng.shuffle(part)
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{place}/inbox")
        stream = spark.readStream.schema(SNAPSHOT).parquet(f"{place}/inbox")
        feed.start(stream, f"{place}/progress", availableNow=True).awaitTermination()  # begins anew where the last one stopped
    got = [tuple(r) for r in spark.read.parquet(f"{place}/records").where("snapshot_id_new < 1000").select(*COLUMNS).collect()]
    want = change_records(archive, NOW, pairing="all").drop("detected_at").join(archive.selectExpr("id AS snapshot_id_new", "captured_at AS detected_at"), "snapshot_id_new")
    assert len(got) == len(set(got)) == 75 and set(got) == {tuple(r) for r in want.select(*COLUMNS).collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
