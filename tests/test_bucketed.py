from __future__ import annotations

import datetime as dt
import random

import pytest

from pulsegrid.operators import tables as A
from pulsegrid.sources.bucketed import BUCKET, BucketedTable, delete_companies

LINK = "id long, company_id long, profile_url string, platform string"
NOW = dt.datetime(2024, 2, 1)


@pytest.fixture
def place(tmp_path):
    return f"file:{tmp_path}"


def links(spark, rows):
    return spark.createDataFrame(rows, LINK)


def got(table, *columns):
    return sorted(tuple(r) for r in table.read().select(*columns).collect())


def files(table):
    return {b: {f"{folder}/{n}" for folder in own for n in table._names(folder)} for b, own in table.log()["buckets"].items()}


def bucket(spark, table, company):
    return str(spark.range(1).select(table.bucket_of(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(company))).first()[0])


def test_a_batch_changes_only_buckets_with_a_hit(spark, place):
    t = BucketedTable(spark, f"{place}/links", "social_media_links", 16)
    assert t.read().count() == 0 and t.version() == 0
    t.append("start", links(spark, [(k, k % 40, f"u{k}", "x") for k in range(200)]))
    before = files(t)
    said = t.update_by_key("patch", spark.createDataFrame([(7, "y"), (47, "y"), (9999, "y")], "id long, platform string"), ["id"], ["platform"])
    after = files(t)
    own = bucket(spark, t, 7)
    assert said["rewritten"] == [int(own)] and said["added"] == []
    assert {b for b in before if before[b] != after[b]} == {own}
    assert [r.platform for r in t.read().where("id in (7, 47)").collect()] == ["y", "y"] and t.read().count() == 200
    # The same batch again: nothing is written.
    assert t.update_by_key("patch", spark.createDataFrame([(8, "z")], "id long, platform string"), ["id"], ["platform"]) == said
    assert files(t) == after and t.version() == 2
    # Older versions stay readable until they are swept out.
    assert t.read(version=1).where("platform = 'y'").count() == 0
    assert t.vacuum() == [] and t.delete("all-of-7", spark.createDataFrame([(7,)], "company_id long"))["rewritten"] == [int(own)]
    assert t.read().where("company_id = 7").count() == 0


def test_inserts_add_and_repeat_nothing(spark, place):
    t = BucketedTable(spark, f"{place}/links", "social_media_links", 8)
    t.append("start", links(spark, [(1, 1, "a", "x"), (2, 2, "b", "x")]))
    incoming = spark.createDataFrame([(1, "a"), (1, "c"), (3, "d"), (3, "d")], "company_id long, profile_url string")
    keys = ["company_id", "profile_url"]
    t.insert_ignore("more", incoming, keys, ["profile_url"])
    want = [(1, "a"), (1, "c"), (2, "b"), (3, "d")]
    assert got(t, *keys) == want and sorted(r.id for r in t.read().collect()) == [1, 2, 3, 4]
    kept = files(t)
    said = t.insert_ignore("again", incoming, keys, ["profile_url"])
    assert got(t, *keys) == want and files(t) == kept and said["added"] == []
    # A key that spans companies is looked for in all of them.
    t.insert_ignore("by-url", spark.createDataFrame([(9, "a"), (9, "z")], "company_id long, profile_url string"), ["profile_url"], ["company_id"])
    assert got(t, *keys) == sorted([*want, (9, "z")])


def test_upserts(spark, place):
    t = BucketedTable(spark, f"{place}/companies", "companies", 8)
    t.append("start", spark.createDataFrame([(k, f"n{k}", None if k % 2 else f"h{k}", "old") for k in range(30)], "id long, name string, homepage_url string, source_sheet string"))
    incoming = spark.createDataFrame([(100, "n1", None, "new"), (101, "n2", "h2", "new"), (102, "n2", "other", "new"), (103, "n2", "other", "newer")], "id long, name string, homepage_url string, source_sheet string")
    before = files(t)
    said = t.upsert("feed", incoming, ["name", "homepage_url"], ["source_sheet"], ["id"])
    rows = {(r.name, r.homepage_url): (r.id, r.source_sheet) for r in t.read().collect()}
    assert rows[("n1", None)] == (1, "new") and rows[("n2", "h2")] == (2, "new") and rows[("n2", "other")] == (102, "new") and len(rows) == 31
    assert {int(b) for b, f in files(t).items() if b in before and not before[b] <= f} == set(said["rewritten"])
    assert set(said["rewritten"]) == {int(bucket(spark, t, 1)), int(bucket(spark, t, 2))}
    kept = files(t)
    assert t.upsert("feed", incoming, ["name", "homepage_url"], ["source_sheet"], ["id"]) == said and files(t) == kept


def test_random_batches_equal_frames(spark, place):
    """Batches in place give what the table operators give on whole frames."""
    rng = random.Random(6)
    t = BucketedTable(spark, f"{place}/links", "social_media_links", 5)
    rows = {}
    for n in range(6):
        kind = rng.choice(["insert", "update", "delete"]) if n else "insert"
        ids = rng.sample(range(40), 12)
        if kind == "insert":
            fresh = [(100 * n + k, k % 7, f"u{k}", f"p{n}") for k in ids]
            t.insert_ignore(f"b{n}", links(spark, fresh), ["company_id", "profile_url"], ["id"])
            for i, c, u, p in fresh:
                rows.setdefault((c, u), (i, p))
        elif kind == "update":
            t.update_by_key(f"b{n}", spark.createDataFrame([(k % 7, f"u{k}", f"q{n}") for k in ids], "company_id long, profile_url string, platform string"), ["company_id", "profile_url"], ["platform"])
            rows = {(c, u): (i, f"q{n}" if int(u[1:]) in ids else p) for (c, u), (i, p) in rows.items()}
        else:
            t.delete(f"b{n}", spark.createDataFrame([(f"u{k}",) for k in ids], "profile_url string"))
            rows = {k: v for k, v in rows.items() if int(k[1][1:]) not in ids}
        assert got(t, "company_id", "profile_url", "id", "platform") == sorted((c, u, i, p) for (c, u), (i, p) in rows.items())
    t.compact("small", 1)
    assert all(len(own) == 1 for own in t.log()["buckets"].values())
    assert got(t, "company_id", "profile_url", "id", "platform") == sorted((c, u, i, p) for (c, u), (i, p) in rows.items())
    t.vacuum()
    assert t.read().count() == len(rows)


def test_a_lost_batch_leaves_no_trace(spark, place, monkeypatch):
    t = BucketedTable(spark, f"{place}/links", "social_media_links", 4)
    t.append("start", links(spark, [(1, 1, "a", "x")]))
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.append("more", links(spark, [(2, 1, "b", "x")]))
    assert t.read().count() == 1 and t.done("more") is None
    t.append("more", links(spark, [(2, 1, "b", "x")]))
    assert t.read().count() == 2
    with pytest.raises(RuntimeError):  # a second writer that began from an older version
        t._commit("late", 1, [], {}, {})


def test_companies_go_with_their_rows(spark, place):
    tables = {n: BucketedTable(spark, f"{place}/{n}", n, 4) for n in ("companies", "social_media_links", "processing_errors")}
    tables["companies"].append("start", spark.createDataFrame([(k, f"n{k}") for k in range(6)], "id long, name string"))
    tables["social_media_links"].append("start", links(spark, [(k, k % 6, f"u{k}", "x") for k in range(24)]))
    tables["processing_errors"].append("start", spark.createDataFrame([(1, "company", 3)], "id long, entity_type string, entity_id long"))
    delete_companies(tables, "gone", spark.createDataFrame([(3,), (4,)], "id long"))
    assert [r[0] for r in got(tables["companies"], "id")] == [0, 1, 2, 5] and tables["processing_errors"].read().count() == 1
    assert {r[0] for r in got(tables["social_media_links"], "company_id")} == {0, 1, 2, 5} and tables["social_media_links"].read().count() == 16


def test_rows_without_owner(spark, place):
    t = BucketedTable(spark, f"{place}/links", "social_media_links", 4)
    t.append("start", links(spark, [(1, None, "a", None), (2, 5, None, "x")]))
    t.update_by_key("p", spark.createDataFrame([(1, "y")], "id long, platform string"), ["id"], ["platform"])
    assert got(t.read().na.fill("-").na.fill(-1) and t, "id") == [(1,), (2,)] and t.read().where("id = 1").first().platform == "y"
    assert BUCKET not in t.read().columns and A.CHILD_TABLES
