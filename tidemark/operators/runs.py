"""Stored runs (backtests, optimisations): saved, renamed, deleted and listed by page.

A run is a row of a keyed table; what happens to it is an upsert. Deleted runs stay as rows
that no list shows, so that a save that comes again does not bring them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.upserts import KeyedTable

RUN = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("created", T.TimestampType()),
    T.StructField("params", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())), T.StructField("deleted", T.BooleanType()),
])
#: The most rows of one page.
PAGE = 200


class RunStore:
    """The runs stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.table = KeyedTable(spark, path, RUN, ["run_id"], ["created"], buckets)

    def _put(self, rows: DataFrame) -> None:
        self.table.apply(rows.select(*RUN.names), self.table.manifest()["batch"] + 1)

    def save(self, runs: DataFrame) -> None:
        """Add (run_id, name, created, params, metrics); ids that are stored, also deleted ones, stay as they are."""
        fresh = runs.join(self.table.read().select("run_id"), "run_id", "left_anti")
        self._put(fresh.withColumn("deleted", F.lit(False)))

    def rename(self, names: DataFrame) -> None:
        """Give the runs of (run_id, name) these names; unknown ids and empty names change nothing."""
        wanted = names.where("trim(name) <> ''").select("run_id", F.trim("name").alias("__name"))
        self._put(self.table.read().join(wanted, "run_id").withColumn("name", F.col("__name")))

    def delete(self, ids: DataFrame) -> None:
        """Delete the runs of (run_id)."""
        self._put(self.table.read().join(ids.select("run_id").distinct(), "run_id").withColumn("deleted", F.lit(True)))

    def all(self) -> DataFrame:
        return self.table.read().where("not deleted").drop("deleted")

    def page(self, offset: int = 0, limit: int = 50) -> DataFrame:
        """Runs newest first, of equal times by id; a page has ``PAGE`` rows at most."""
        return self.all().orderBy(F.desc("created"), "run_id").offset(offset).limit(min(limit, PAGE))

    def get(self, run_id: str) -> DataFrame:
        """The run, or no row."""
        return self.all().where(F.col("run_id") == run_id)

    def compare(self, metrics: list[str]) -> DataFrame:
        """One row for each run with these metrics; null where a run has none of that name."""
        return self.all().select("run_id", "name", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])
