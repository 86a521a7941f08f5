"""Content-addressed memo of costly answers, and signals folded from them.

A request is known by a digest of its method and its parameters as canonical JSON (names in
order, nulls kept). Requests are joined to the memo; only distinct requests without an
answer are computed, and their answers are added. A stored answer that is not valid counts
as none. A request that fails has no answer and is asked again the next time.

Requests are evaluated once and written beside the memo, in a folder of each call: a mean whose
sum depends on the order of its rows could else have one digest when it is asked and another one
when its answer is looked up. What was asked is counted over these rows, not by tasks, which can run twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.upserts import KeyedTable

ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("body", T.StringType())])


def request_key(method: str, columns: list[str]) -> Column:
    """The first 24 hex digits of the SHA-256 of ``method|parameters``."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(F.concat_ws("|", F.lit(method), body), 256), 1, 24)


class Memo:
    """Answers stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.table = KeyedTable(spark, path, ENTRY, ["key"], ["body"], buckets)
        #: Number of requests that the last call gave to ``compute``.
        self.asked = 0

    def serve(self, requests: DataFrame, method: str, columns: list[str], compute: Callable[[DataFrame], DataFrame], valid: Column | None = None) -> DataFrame:
        """The requests with ``key`` and ``body``; ``compute`` takes (key, columns) of misses and gives (key, body).

        ``valid`` says of a stored ``body`` whether it still counts.
        """
        keyed, path = requests.withColumn("key", request_key(method, columns)), f"{self.table.path}/requests-{uuid.uuid4().hex}"
        keyed.write.parquet(path)
        keyed = self.table.spark.read.schema(keyed.schema).parquet(path)
        known = self.table.read() if valid is None else self.table.read().where(valid)
        misses = keyed.select("key", *columns).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        self.asked = misses.count()
        fresh = compute(misses).select("key", "body").where("body is not null")
        self.table.apply(fresh, self.table.manifest()["batch"] + 1)
        return keyed.join(self.table.read(), "key", "left")


def signal_of(body: Column, top: float = 100.0) -> tuple[Column, Column]:
    """(value, abstained) of an answer ``{"signal": ..., "confidence": ...}``.

    Bullish and bearish are plus and minus confidence / 100, neutral is 0. What cannot be
    read, names no known signal or has no confidence within 0 to 100 abstains, with 0.
    """
    read = F.from_json(body, "signal string, confidence double", {"mode": "PERMISSIVE"})
    name, conf = F.lower(F.trim(read["signal"])), read["confidence"]
    sign = F.when(name == "bullish", 1.0).when(name == "bearish", -1.0).when(name == "neutral", 0.0)
    value = F.when(conf.between(0, top), sign * conf / top)
    return F.coalesce(value, F.lit(0.0)), value.isNull()
