"""Keyed writes as set operations: last write wins, first write wins, trims and high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import latest_per_key


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows of the same key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest_per_key(both, keys, [F.desc("__new")]).drop("__new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of new keys only; of several new rows of a key the first one."""
    fresh = latest_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return latest_per_key(df, keys, [F.desc(order)], n)


def high_water(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest time and number of rows of each key."""
    return df.groupBy(*keys).agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))


def after_high_water(new: DataFrame, stored: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows newer than what is stored for their key."""
    mark = stored.groupBy(*keys).agg(F.max(ts).alias("__mark"))
    return new.join(mark, keys, "left").where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")
