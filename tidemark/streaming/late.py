"""Late rows split off and counted, before windows would drop them without a word.

The watermark of a micro-batch is the newest time of all batches before it, less the delay
that is allowed. Rows behind it go to a table of late rows, the others to the table of
rows in time. The newest time and the counts are published with the batch, so that a batch
that comes again changes nothing and one that failed is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.upserts import Manifests


class LateSplit(Manifests):
    """Tables ``on_time`` and ``late`` below ``path``. Rows without a time are late."""

    empty = {"batch": -1, "seen": None, "on_time": 0, "late": 0}

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, ts: str, delay: int) -> None:
        super().__init__(spark, path)
        self.schema, self.ts, self.delay = schema, ts, delay
        self.stored = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Split one micro-batch."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return
        at = F.unix_micros(self.ts)
        edge = None if now["seen"] is None else now["seen"] - self.delay * 1_000_000
        behind = at.isNull() if edge is None else at.isNull() | (at < edge)
        rows = batch.select(*self.schema.names).withColumn("__late", behind).persist()
        try:
            n = rows.agg(F.max(at).alias("seen"), F.count_if("__late").alias("late"), F.count_if(~F.col("__late")).alias("on_time")).first()
            for name, wanted in (("on_time", ~F.col("__late")), ("late", F.col("__late"))):
                if n[name]:
                    rows.where(wanted).drop("__late").write.mode("overwrite").parquet(f"{self.path}/{name}/__batch={batch_id}")
        finally:
            rows.unpersist()
        seen = max((t for t in (now["seen"], n.seen) if t is not None), default=None)
        self.publish({"batch": batch_id, "seen": seen, "on_time": now["on_time"] + n.on_time, "late": now["late"] + n.late})

    def counts(self) -> dict[str, int]:
        """Rows in time and late so far."""
        now = self.manifest()
        return {"on_time": now["on_time"], "late": now["late"]}

    def _table(self, name: str) -> DataFrame:
        if not self.counts()[name]:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(f"{self.path}/{name}")
        return rows.where(F.col("__batch") <= self.manifest()["batch"]).select(*self.schema.names)

    def on_time(self) -> DataFrame:
        return self._table("on_time")

    def late(self) -> DataFrame:
        return self._table("late")


def split_stream(stream: DataFrame, split: LateSplit, checkpoint: str) -> None:
    """Run a stream over all that is there into the two tables."""
    q = stream.writeStream.foreachBatch(split.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
