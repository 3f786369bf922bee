"""Tables in place: Parquet in buckets by owner, changed a batch at a time.

A batch writes the buckets that it changes into a folder of its own and then one small file that
names, for every bucket, the folders it consists of now. Readers see the table as of the last such
file, so a batch is there whole or not at all; buckets without a hit keep their files. A batch that
is run again finds its name and does nothing. One writer at a time: of two, the second one to
finish fails and can be run again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import first_per_key, new_rows, update_by_key, with_ids
from ..schemas import schema
from ..session import cut_lineage

BUCKET = "__bucket"


class BucketedTable:
    """The table ``table`` (its columns as declared in ``schemas``) in the folder ``path``.

    Rows lie in buckets by their company, or by id where they have none.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, buckets: int = 200) -> None:
        self.spark, self.path, self.table, self.buckets = spark, path.rstrip("/"), table, buckets
        self.schema = schema(table)
        self.owner = "company_id" if "company_id" in self.schema.names else "id"

    # ---- the file system, as Spark reaches it ---------------------------------------------

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._at(name)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def version(self) -> int:
        """How many batches made the table what it is; 0 before the first."""
        return max((int(n[:-5]) for n in self._names("log") if re.fullmatch(r"\d+\.json", n)), default=0)

    def log(self, version: int | None = None) -> dict:
        """``buckets`` (folders by bucket) and ``done`` (what each batch said of itself) as of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {"buckets": {}, "done": {}}
        path, files = self._at(f"log/{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def done(self, batch: str) -> dict | None:
        """What a finished batch said of itself: ``version``, ``rewritten`` and ``added`` buckets, and its notes."""
        return self.log()["done"].get(batch)

    def _commit(self, batch: str, base: int, replaced: Collection[int], folders: Mapping[int, str], notes: Mapping | None) -> dict:
        log = self.log(base)
        for b in replaced:
            log["buckets"].pop(str(b), None)
        for b, folder in folders.items():
            log["buckets"].setdefault(str(b), []).append(folder)
        entry = {"version": base + 1, "rewritten": sorted(replaced), "added": sorted(set(folders) - set(replaced)), **(notes or {})}
        log["done"][batch] = entry
        path, files = self._at(f"log/{base + 1:012d}.json")
        draft, _ = self._at(f"log/draft-{batch}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(log).encode()))
        stream.close()
        if files.exists(path) or not files.rename(draft, path):
            raise RuntimeError(f"{self.table}: another batch was written meanwhile; run {batch} again")
        return entry

    def _stage(self, batch: str, base: int, rows: DataFrame, spread: bool = False) -> dict[int, str]:
        """``rows`` in a folder of the batch, by bucket. Splits buckets that are too large for a task; leaves ``spread`` rows in their tasks."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots and dashes")
        folder = f"data/{base + 1:012d}-{batch}"
        declared = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        dealt = rows.select(*declared, self.bucket_of(F.col(self.owner)).alias(BUCKET))
        if not spread:
            dealt = dealt.hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(folder) if n.startswith(f"{BUCKET}=")]
        return {int(n.partition("=")[2]): f"{folder}/{n}" for n in found}

    # ---- reading ----------------------------------------------------------------------------

    def bucket_of(self, owner: Column) -> Column:
        return F.pmod(F.hash(owner.cast(self.schema[self.owner].dataType)), F.lit(self.buckets))

    def read(self, buckets: Collection[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows as of a version (the last one by default), of some buckets or all."""
        parts = self.log(version)["buckets"]
        paths = [f"{self.path}/{p}" for b, own in parts.items() if buckets is None or int(b) in buckets for p in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of the owners in ``rows``; at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self.bucket_of(F.col(self.owner))).distinct().collect()]

    def _hit(self, base: int, keys: DataFrame) -> list[int]:
        """Buckets with a row that has the key of a row of ``keys``; only key columns are read."""
        near = self._buckets_of(keys) if self.owner in keys.columns else None
        names = list(dict.fromkeys([self.owner, *keys.columns]))
        return self._buckets_of(self.read(near, base).select(*names).join(keys.distinct(), keys.columns, "left_semi"))

    # ---- writing ----------------------------------------------------------------------------

    def append(self, batch: str, rows: DataFrame, notes: Mapping | None = None, kept: bool = False, spread: bool = False) -> dict:
        """Adds ``rows``; those that come without an id get one above all there are.

        ``kept`` rows have had their lineage cut. ``spread`` is for first loads of much: rows aren't
        shuffled by bucket, every task writes files of its own for each.
        """
        base, found = self.version(), self.done(batch)
        if found is not None:
            return found
        if "id" in self.schema.names and "id" not in rows.columns:
            rows = with_ids(self.read(version=base), rows, kept)
        return self._commit(batch, base, [], self._stage(batch, base, rows, spread), notes)

    def insert_ignore(self, batch: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column], notes: Mapping | None = None) -> dict:
        """Adds the rows whose key isn't there yet, the first of equal ones."""
        if (found := self.done(batch)) is not None:
            return found
        near = self._buckets_of(incoming) if self.owner in keys else None
        return self.append(batch, new_rows(self.read(near), incoming, keys, order), notes)

    def update_by_key(self, batch: str, patch: DataFrame, keys: Sequence[str], columns: Sequence[str], notes: Mapping | None = None) -> dict:
        """Sets ``columns`` from ``patch`` (one row per key) where its key is there."""
        base, found = self.version(), self.done(batch)
        if found is not None:
            return found
        hit = self._hit(base, patch.select(*keys))
        rows = update_by_key(self.read(hit, base), patch, keys, columns)
        return self._rewrite(batch, base, hit, rows, notes)

    def upsert(self, batch: str, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str | Column], notes: Mapping | None = None) -> dict:
        """Sets ``columns`` where the key is there (NULL equals NULL), else adds the row; of equal keys the first counts.

        Buckets with a hit are rewritten; the others only get the added rows.
        """
        base, found = self.version(), self.done(batch)
        if found is not None:
            return found
        newest = cut_lineage(first_per_key(incoming, keys, order))
        names = list(dict.fromkeys([self.owner, *keys]))
        known = self.read(version=base).select(*names)
        renamed = newest.select(*(F.col(k).alias(f"__{k}") for k in keys))
        hit = self._buckets_of(known.join(renamed, _all(known[k].eqNullSafe(F.col(f"__{k}")) for k in keys), "left_semi"))
        current = self.read(hit, base)
        patch = newest.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__v_{c}") for c in columns), F.lit(True).alias("__hit"))
        joined = current.join(patch, _all(current[k].eqNullSafe(F.col(f"__{k}")) for k in keys), "left")
        updated = joined.select(*(F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(current[c]).alias(c) if c in columns else current[c] for c in current.columns))
        there = known.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        added = newest.join(there, _all(newest[k].eqNullSafe(F.col(f"__{k}")) for k in keys), "left_anti")
        if "id" in self.schema.names and "id" not in added.columns:
            added = with_ids(self.read(version=base), added)
        return self._rewrite(batch, base, hit, updated.unionByName(added, allowMissingColumns=True), notes)

    def delete(self, batch: str, keys: DataFrame, notes: Mapping | None = None) -> dict:
        """Removes the rows that have the key of a row of ``keys``."""
        base, found = self.version(), self.done(batch)
        if found is not None:
            return found
        hit = self._hit(base, keys)
        rows = self.read(hit, base).join(keys.distinct(), keys.columns, "left_anti")
        return self._rewrite(batch, base, hit, rows, notes)

    def compact(self, batch: str, parts: int = 8) -> dict:
        """Rewrites the buckets that have come to lie in more than ``parts`` folders."""
        base, found = self.version(), self.done(batch)
        if found is not None:
            return found
        many = [int(b) for b, own in self.log(base)["buckets"].items() if len(own) > parts]
        return self._rewrite(batch, base, many, self.read(many, base), {})

    def _rewrite(self, batch: str, base: int, hit: Collection[int], rows: DataFrame, notes: Mapping | None) -> dict:
        return self._commit(batch, base, hit, self._stage(batch, base, rows), notes)

    def vacuum(self) -> list[str]:
        """Deletes the folders that the last version doesn't need; older versions can't be read any more."""
        needed = {p.split("/")[1] for own in self.log()["buckets"].values() for p in own}
        gone = [n for n in self._names("data") if n not in needed]
        for n in gone:
            path, files = self._at(f"data/{n}")
            files.delete(path, True)
        return gone


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def delete_companies(tables: Mapping[str, BucketedTable], batch: str, company_ids: DataFrame) -> dict[str, dict]:
    """Removes companies and, table by table, the rows that belong to them."""
    gone = cut_lineage(company_ids.select(F.col(company_ids.columns[0]).alias("id")))
    return {name: t.delete(batch, gone.select(F.col("id").alias(t.owner))) for name, t in tables.items()
            if t.owner == "company_id" or name == "companies"}
