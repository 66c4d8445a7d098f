"""A table of one row a key that is changed in place by versions: rows lie in buckets by key, a change writes anew the buckets
that it touches, and a manifest for each version says where every bucket lies. Readers see one version as a whole."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracehound.operators import triage

BUCKET = "__bucket"


class ChangedMeanwhile(RuntimeError):
    """Another writer has made the version that this one was about to make; read again and repeat the change."""


@dataclass(frozen=True)
class Manifest:
    """A version: its schema, and the folder of each bucket that has rows."""

    version: int
    key: str
    buckets: int
    schema: StructType
    folders: dict[int, str]

    def text(self) -> str:
        return json.dumps({"version": self.version, "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": {str(k): v for k, v in self.folders.items()}})

    @staticmethod
    def of(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(x["version"], x["key"], x["buckets"], StructType.fromJson(x["schema"]), {int(k): v for k, v in x["folders"].items()})


class KeyedStore:
    """The table at a folder that all of the cluster shares.

    A change reads and writes the buckets of the changed keys only, so it costs what it changes: with B buckets of N rows, a
    change of few keys costs N / B rows for each. Versions are made one after the other: the manifest of a version is made by
    a rename that fails if it is there. Files are never changed; forget() deletes those of old versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def create(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 64) -> KeyedStore:
        """A store of rows, which have each key once and no null keys."""
        store = KeyedStore(spark, path)
        store._write(Manifest(0, key, buckets, rows.schema, {}), rows, list(range(buckets)))
        return store

    def versions(self) -> list[int]:
        folder = self._jpath(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/{version}").first()[0]
        return Manifest.of(text)

    def read(self, version: int | None = None, buckets: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a version, the latest if not given; of some buckets only, if given."""
        m = manifest or self.manifest(version)
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in sorted(m.folders.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*paths)

    def get(self, key) -> DataFrame:
        """The row of one key, from the files of its bucket."""
        m = self.manifest()
        bucket = self.spark.range(1).select(_bucket(F.lit(key).cast(m.schema[m.key].dataType), m.buckets)).first()[0]
        return self.read(buckets=[bucket], manifest=m).filter(F.col(m.key) == key)

    def upsert(self, new: DataFrame, updated: str = "updated_at", created: str | None = None, fill: tuple[str, ...] = ()) -> int:
        """Merges rows as triage.upsert does; gives the version made. New columns are taken up, null in other rows."""
        m = self.manifest()
        return self._change(m, new.select(m.key), lambda old: triage.upsert(old, new, m.key, updated, created, fill), new.schema)

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of keys(key), of which those that are not there are no matter; gives the version made."""
        m = self.manifest()
        return self._change(m, keys.select(m.key), lambda old: triage.delete(old, keys, m.key), m.schema)

    def forget(self, keep: int = 1) -> list[str]:
        """Deletes the manifests before the last `keep`, and the buckets' folders that no later one names; gives these."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        needed = {(b, folder) for v in kept for b, folder in self.manifest(v).folders.items()}
        gone = sorted({f"{folder}/{BUCKET}={b}" for v in old for b, folder in self.manifest(v).folders.items() if (b, folder) not in needed})
        for path in [*gone, *[f"manifests/{v}" for v in old]]:
            self._fs.delete(self._jpath(f"{self.path}/{path}"), True)
        return gone

    def _change(self, m: Manifest, keys: DataFrame, change: Callable[[DataFrame], DataFrame], schema: StructType) -> int:
        # At most one number for each bucket.
        touched = [r[0] for r in keys.select(_bucket(F.col(m.key), m.buckets).alias("b")).distinct().collect()]
        rows = change(self.read(buckets=touched, manifest=m))
        fields = [*m.schema.fields, *[f for f in schema.fields if f.name not in m.schema.names]]
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return self._write(Manifest(m.version, m.key, m.buckets, StructType(fields), m.folders), rows, touched)

    def _write(self, m: Manifest, rows: DataFrame, touched: list[int]) -> int:
        """The next version: rows are all of the touched buckets; the others stay where they lie."""
        import uuid

        folder = f"data/{m.version + 1}-{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, _bucket(F.col(m.key), m.buckets))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._jpath(f"{self.path}/{folder}")) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in m.folders.items() if b not in touched} | {b: folder for b in written}
        made = Manifest(m.version + 1, m.key, m.buckets, m.schema, folders)
        self._publish(made)
        return made.version

    def _publish(self, m: Manifest) -> None:
        import uuid

        target, draft = self._jpath(f"{self.path}/manifests/{m.version}"), self._jpath(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(m.text().encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise ChangedMeanwhile(f"version {m.version} of {self.path} is there already")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
