"""As-of and range joins that plan as window or equi joins, never as Cartesian products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import time_bucket


def asof_join(probe: DataFrame, quote: DataFrame, by: str, on: str, values: list[str], direction: str = "backward", strict: bool = False, span: int | None = None) -> DataFrame:
    """Each probe row with the nearest quote row of the same key before (after) it.

    A key's time is cut into spans (``span`` days for dates, default 64; seconds for
    timestamps, default one day; units of a whole number, default 86,400), so that a hot key is many groups of rows. Probes and quotes
    are one union, with one exchange and one sort on (key, span, time); the last (first)
    quote of each span is carried on over a table of one row for each key and span. At
    equal times a quote counts unless ``strict``; of quotes at one time the one with the
    greatest (smallest) values is taken. Adds the quote's ``values`` and its time as
    ``quote_<on>``; without a quote they are null.
    """
    back = direction == "backward"
    bucket = time_bucket(probe, on, span).alias("__span")
    # Which side comes first at equal times: a backward join looks at the rows up to the probe, a forward one at those from it on.
    quote_side = 0 if strict != back else 1
    q = quote.select(F.col(by), F.col(on), bucket, F.lit(quote_side).alias("__side"), F.struct(F.col(on).alias("__t"), *values).alias("__q"), F.lit(None).cast(probe.schema).alias("__p"))
    p = probe.select(F.col(by), F.col(on), bucket, F.lit(1 - quote_side).alias("__side"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.struct(*probe.columns).alias("__p"))
    both = q.unionByName(p)
    w = W.partitionBy(by, "__span").orderBy(F.col(on), F.col("__side"), F.col("__q"))
    spans = both.groupBy(by, "__span").agg((F.max if back else F.min)("__q").alias("__own"))
    ahead = W.partitionBy(by).orderBy("__span")
    if back:
        near = F.last("__q", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        carried = F.last("__own", ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, -1))
    else:
        near = F.first("__q", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
        carried = F.first("__own", ignorenulls=True).over(ahead.rowsBetween(1, W.unboundedFollowing))
    spans = spans.select(F.col(by).alias("__by"), F.col("__span").alias("__at"), carried.alias("__carried"))
    out = both.withColumn("__near", near).where("__p is not null")
    out = out.join(spans, (F.col(by) == F.col("__by")) & (F.col("__span") == F.col("__at")), "left")
    found = F.coalesce("__near", "__carried")
    out = out.select("__p", found.alias("__found"))
    return out.select("__p.*", F.col("__found.__t").alias(f"quote_{on}"), *[F.col(f"__found.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, low: str, high: str, bucket: int) -> DataFrame:
    """Rows of ``right`` (key, at) whose ``at`` lies in [low, high] of a row of ``left``.

    Times are cut into buckets of ``bucket`` units; left rows are repeated for the few
    buckets they touch, and the join is an equi join on key and bucket. ``at``, ``low``
    and ``high`` are whole numbers (days, seconds).
    """
    first, last = F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket)
    spread = left.withColumn("__b", F.explode(F.sequence(first, last)))
    r = right.withColumn("__rb", F.floor(F.col(at) / bucket)).withColumnRenamed(key, "__key")
    on = (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__rb")) & F.col(at).between(F.col(low), F.col(high))
    return spread.join(r, on).drop("__b", "__rb", "__key")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
