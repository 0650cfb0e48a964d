"""A keyed table that a stream upserts into, batch by batch, once each.

Rows lie in buckets by their key.  A batch writes the buckets that it changes to new folders and then puts up a new manifest: a file that names the folder of every
bucket and the last batch of each stream.  A manifest is put in its place by one rename that fails if its number is taken, so a reader sees a whole version or the one
before, two writers never both win, and a batch that is delivered again finds itself named and changes nothing.  The rename has to fail where the name is taken, as that
of HDFS does; in a store whose renames copy, one writer at a time is needed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.staging import file_system

#: Manifests that stay, with the folders that they name, when old ones are cleared.
KEPT = 3


class KeyedTable:
    """A table of ``schema`` in ``path`` with unique ``keys``, in ``buckets`` folders."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    # -- manifests ------------------------------------------------------------------------------------------

    def _files(self) -> list[str]:
        system, own = file_system(self.spark, f"{self.path}/manifests")
        return sorted(f.getPath().getName() for f in system.listStatus(own) if f.getPath().getName().endswith(".json")) if system.exists(own) else []

    def manifest(self, version: int | None = None) -> dict:
        """The named version's manifest, or the latest: version, buckets (bucket to folder), batches (stream to its last batch)."""
        names = self._files()
        if not names:
            return {"version": 0, "buckets": {}, "batches": {}}
        name = names[-1] if version is None else f"{version:012d}.json"
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first()[0])

    def _put(self, manifest: dict) -> None:
        """Put up a manifest; fails if another writer was first."""
        name, part = f"{self.path}/manifests/{manifest['version']:012d}.json", f"{self.path}/manifests/.{uuid.uuid4().hex}"
        system, own = file_system(self.spark, part)
        system.mkdirs(own.getParent())
        out = system.create(own, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to = file_system(self.spark, name)[1]
        if system.exists(to) or not system.rename(own, to):
            system.delete(own, False)
            raise RuntimeError(f"version {manifest['version']} is there already")

    # -- rows -----------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; later batches do not change what is read."""
        return self._rows(list(self.manifest(version)["buckets"].values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str, batch: int) -> bool:
        """Put ``merge(old rows, changes)`` in the place of the buckets that the changes' keys are in; whether it was done, and not before.

        ``merge`` is one of ``operators.mutation``, for instance an upsert or a replacement by key; it must leave rows of other keys alone.
        """
        now = self.manifest()
        if batch <= now["batches"].get(stream, -1):
            return False
        changes = changes.withColumn("__bucket", self._bucket()).persist()
        try:
            # Numbers of buckets, of which there are as many as the table has.
            touched = [r[0] for r in changes.select("__bucket").distinct().collect()]
            if touched:
                old = self._rows([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]])
                folder = f"{self.path}/data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
                merged = merge(old, changes.drop("__bucket")).select(*self.schema.names).withColumn("__bucket", self._bucket())
                merged.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
                written = self.spark.read.schema(StructType([*self.schema.fields, StructField("__bucket", IntegerType())])).parquet(folder)
                left = {r[0] for r in written.select("__bucket").distinct().collect()}
                now["buckets"] = {b: f for b, f in now["buckets"].items() if int(b) not in touched} | {str(b): f"{folder}/__bucket={b}" for b in sorted(left)}
            now["batches"][stream] = batch
            self._put(now | {"version": now["version"] + 1})
        finally:
            changes.unpersist()
        return True

    def clear(self, kept: int = KEPT) -> None:
        """Delete manifests but for the latest ``kept``, and data that none of these names."""
        names = self._files()
        stay = [self.manifest(int(n[:-5])) for n in names[-kept:]]
        folders = {f.rsplit("/", 2)[1] for m in stay for f in m["buckets"].values()}
        for n in names[:-kept]:
            system, own = file_system(self.spark, f"{self.path}/manifests/{n}")
            system.delete(own, False)
        system, data = file_system(self.spark, f"{self.path}/data")
        for f in system.listStatus(data) if system.exists(data) else []:
            # What a writer is still at has a number above the latest version's.
            if f.getPath().getName() not in folders and int(f.getPath().getName()[:12]) <= stay[-1]["version"]:
                system.delete(f.getPath(), True)


def upserting(table: KeyedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch once, however often it is delivered."""

    def run(batch: DataFrame, n: int) -> None:
        table.apply(batch, merge, stream, n)

    return run
