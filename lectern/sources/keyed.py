"""A keyed store on plain Parquet: upserts that rewrite only the buckets they touch.

Rows lie in buckets by a hash of their key. An upsert reads the touched buckets, merges, writes them to a new folder and
then puts down a manifest that names the current folder of every bucket; the manifest of the greatest version is the store,
so readers see all of a batch or nothing, and what a crash leaves is never read. A batch whose number isn't above the last
one's changes nothing, so a stream may deliver it again. A look-up opens the buckets of its keys. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class KeyedStore:
    """merge: stored and new rows together -> one row for each key. It must have the schema of both."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path, keys, merge, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._jpath = jvm.Path
        self._fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[str]:
        found = self._fs.globStatus(self._jpath(f"{self.path}/manifest-*.json")) or []
        return sorted(f.getPath().getName() for f in found)

    def manifest(self) -> dict:
        """version, batch (the last one's number), schema and folders of buckets; of an empty store version 0."""
        names = self._manifests()
        if not names:
            return {"version": 0, "batch": -1, "schema": None, "buckets": {}}
        stream = self._fs.open(self._jpath(f"{self.path}/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        final = f"{self.path}/manifest-{manifest['version']:012d}.json"
        stream = self._fs.create(self._jpath(final + ".new"), True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(self._jpath(final + ".new"), self._jpath(final)):
            raise RuntimeError(f"another writer put {final}")

    def _read(self, folders: list[str], schema) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge rows into the store; whether this batch is new to it."""
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        rows = rows.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # numbers of buckets
            if touched:
                version, kept = now["version"] + 1, rows.drop("_bucket")
                old = self._read([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]], kept.schema)
                data = f"data-{version:012d}-{batch}"
                whole = self.merge(old.unionByName(kept)).select(*kept.columns).withColumn("_bucket", self._bucket())
                whole.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{data}")
                now = {"version": version, "batch": batch, "schema": kept.schema.json(), "buckets": now["buckets"] | {str(b): f"{data}/_bucket={b}" for b in touched}}
            else:
                now = now | {"version": now["version"] + 1, "batch": batch, "schema": now["schema"] or rows.drop("_bucket").schema.json()}
            self._put(now)
        finally:
            rows.unpersist()
        return True

    def _schema(self, now: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(now["schema"]))

    def table(self) -> DataFrame:
        now = self.manifest()
        return self._read([now["buckets"][k] for k in sorted(now["buckets"])], self._schema(now))

    def near(self, rows: DataFrame) -> DataFrame | None:
        """What lies in the buckets that the keys of rows fall into; None of an empty store."""
        now = self.manifest()
        if not now["schema"]:
            return None
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # numbers of buckets
        return self._read([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]], self._schema(now))

    def get(self, *key) -> DataFrame:
        """The row of one key: its bucket alone is opened."""
        now, schema = self.manifest(), None
        schema = self._schema(now)
        types = {f.name: f.dataType for f in schema}
        typed = self.spark.range(1).select(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(self.keys, key, strict=True)])
        b = str(typed.select(self._bucket()).first()[0])
        found = self._read([now["buckets"][b]] if b in now["buckets"] else [], schema)
        for k, v in zip(self.keys, key, strict=True):
            found = found.where(F.col(k).eqNullSafe(F.lit(v).cast(types[k])))
        return found

    def remove(self, path: str) -> None:
        """Delete a folder of the store's file system, if it is there."""
        self._fs.delete(self._jpath(path), True)

    def has(self, path: str) -> bool:
        return self._fs.exists(self._jpath(path))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders and manifests that the last `keep` versions don't name; the names deleted."""
        names = self._manifests()
        named = set()
        for name in names[-keep:]:
            stream = self._fs.open(self._jpath(f"{self.path}/{name}"))
            named |= {x.split("/")[0] for x in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"].values()}
            stream.close()
        folders = [f.getPath().getName() for f in self._fs.globStatus(self._jpath(f"{self.path}/data-*")) or []]
        gone = [x for x in folders if x not in named] + names[:-keep]
        for x in gone:
            self._fs.delete(self._jpath(f"{self.path}/{x}"), True)
        return gone


def latest_by(keys: list[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """Merge: of each key the row of the greatest order."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c not in order]
        return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*keys, "_x.*")

    return merge


def summed(keys: list[str], *counters: str) -> Callable[[DataFrame], DataFrame]:
    """Merge: counters of each key added up."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
