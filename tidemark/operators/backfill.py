"""Coverage-triggered backfill: what a store lacks is found, fetched and merged, and nothing else.

A request (key, low, high) is served from the store if it holds ``enough`` of the points
that the range should have. Otherwise the gaps within it are fetched, in chunks that overlap
a little, and merged into the store, first writer wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals, joins, upsert

#: Beyond so many partitions of the source the fetch reads all of them.
MOST_PARTITIONS = 10_000


def coverage(stored: DataFrame, requests: DataFrame, key: str, at: str, low: str, high: str, step: int = 1, bucket: int = 4096) -> DataFrame:
    """Requests with ``n_rows`` (distinct stored points), ``expected`` and their ratio ``covered``."""
    points = stored.select(key, F.col(at).alias("__at")).distinct()
    keyed = requests.withColumn("__request", F.struct(key, low, high))
    n = joins.range_join(keyed, points, key, "__at", low, high, bucket).groupBy("__request").agg(F.count(F.lit(1)).alias("n_rows"))
    x = keyed.join(n, "__request", "left").drop("__request").fillna(0, ["n_rows"])
    expected = F.greatest(F.lit(1), F.floor((F.col(high) - F.col(low) + 1) / step)).cast("long")
    return x.withColumn("expected", expected).withColumn("covered", F.col("n_rows") / F.col("expected"))


def missing(stored: DataFrame, requests: DataFrame, key: str, at: str, low: str, high: str, enough: float = 0.95) -> DataFrame:
    """Ranges (key, gap_low, gap_high) to fetch: the gaps of requests that are covered too little, joined where they touch."""
    short = coverage(stored, requests, key, at, low, high).where(F.col("covered") < enough).select(key, low, high)
    return intervals.merged(intervals.gaps(stored, short, key, at, low, high), key, "gap_low", "gap_high")


def fetch(source: DataFrame, ranges: DataFrame, key: str, at: str, part: str | None = None, width: int = 32) -> DataFrame:
    """Rows of the source within the ranges.

    ``part`` names a column by which the source is stored, ``floor(at / width)``. Then only
    the partitions that ranges touch are read: their numbers, at most ``MOST_PARTITIONS``,
    become a filter of the scan.
    """
    if part:
        touched = ranges.select(F.explode(F.sequence(F.floor(F.col("gap_low") / width), F.floor(F.col("gap_high") / width))).alias("p")).distinct()
        numbers = [r.p for r in touched.limit(MOST_PARTITIONS + 1).collect()]
        if len(numbers) <= MOST_PARTITIONS:
            source = source.where(F.col(part).isin(numbers) if numbers else F.lit(False))
    found = joins.range_join(ranges, source, key, at, "gap_low", "gap_high", width)
    return found.select(*source.columns)


def backfill(stored: DataFrame, source: DataFrame, requests: DataFrame, key: str, at: str, low: str, high: str, enough: float = 0.95, part: str | None = None) -> DataFrame:
    """The store with what was missing; its own rows stay as they are."""
    ranges = missing(stored, requests, key, at, low, high, enough)
    fresh = fetch(source, ranges, key, at, part)
    return upsert.insert_ignore(stored, fresh, [key, at], [F.col(at)])
