"""A keyed table that a stream updates exactly once.

Rows lie in buckets by the hash of their key. A micro-batch rewrites only the buckets that
it touches, into a folder of its own, and then publishes a manifest that names the folder
of every bucket and the batch. The manifest appears by one rename; readers see the table
before or after it and nothing between. A batch that was published is skipped when it comes
again; one that failed before leaves files that no manifest names, and is written anew.
One stream writes to a table at a time. The rename must be atomic, as in HDFS and local file
systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import latest_per_key


class Manifests:
    """What has been published below ``path``: one JSON file for each batch, the newest of which counts."""

    empty: dict = {"batch": -1}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        """Names of the manifests, oldest first."""
        folder = self._at("manifests")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def manifest(self, name: str | None = None) -> dict:
        """The newest manifest, or the one named."""
        name = name or next(reversed(self.versions()), None)
        if name is None:
            return json.loads(json.dumps(self.empty))
        stream = self.fs.open(self._at(f"manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Make the manifest the newest one, by a rename."""
        self.fs.mkdirs(self._at("manifests"))
        temporary = self._at(f"unpublished-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(temporary, self._at(f"manifests/{manifest['batch']:020d}.json")):
            raise OSError(f"batch {manifest['batch']} of {self.path} was published by another writer")


class KeyedTable(Manifests):
    """The table at ``path`` with one row for each key; its manifests name the folder of every bucket."""

    empty = {"batch": -1, "buckets": {}}

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 16) -> None:
        super().__init__(spark, path)
        self.schema, self.keys, self.order, self.buckets = schema, keys, order, buckets

    def rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of these."""
        places = [f"{self.path}/{folder}/__bucket={b}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as the newest manifest has it."""
        return self.rows(self.manifest())

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Upsert one micro-batch: of its rows of a key the newest by ``order``, in place of the stored one."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = latest_per_key(batch.select(*self.schema.names), self.keys, [F.desc(c) for c in self.order])
        batch.persist()
        try:
            touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]
            if touched:
                folder = f"data-{uuid.uuid4().hex}"
                kept = self.rows(now, touched).join(newest.select(*self.keys), self.keys, "left_anti")
                full = kept.select(*self.schema.names).unionByName(newest).withColumn("__bucket", bucket)
                full.repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
                now["buckets"] |= {str(b): folder for b in touched}
        finally:
            batch.unpersist()
        self.publish({"batch": batch_id, "buckets": now["buckets"]})

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and folders that none of these names; returns how many folders."""
        names = self.versions()
        used = {f for n in names[-keep:] for f in self.manifest(n)["buckets"].values()}
        for n in names[:-keep]:
            self.fs.delete(self._at(f"manifests/{n}"), False)
        stale = [f.getPath() for f in self.fs.listStatus(self.root) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used]
        for p in stale:
            self.fs.delete(p, True)
        return len(stale)


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Run a stream over all that is there into the table; again after a failure, it goes on where it stopped."""
    q = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
