"""Ranges against ranges: overlap joins, gaps and what is covered.

Ranges are closed, [low, high], of whole numbers (days, seconds, milliseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bucket widths of the levels, in multiples of the smallest one.
GROWTH = (1, 16, 256, 4096, 65_536, 1_048_576)


def levels_of(low: Column, high: Column, base: int) -> Column:
    """The first level whose buckets are as long as the range: it touches two of them at most."""
    level = F.lit(len(GROWTH) - 1)
    for i in reversed(range(len(GROWTH) - 1)):
        level = F.when(high - low < base * GROWTH[i], i).otherwise(level)
    return level


def spread(df: DataFrame, low: str, high: str, base: int, right: bool) -> DataFrame:
    """A row for each bucket that a range can meet a partner in.

    A pair meets at the level of its longer range. There a range is either the longer one
    (its own level) or the other (any higher level). In role 0 the left range is at its own
    level and the right one at that or a lower one; in role 1 the right range is longer by
    a level or more.
    """
    own = levels_of(F.col(low), F.col(high), base)
    width = F.element_at(F.array(*[F.lit(base * g) for g in GROWTH]), F.col("__level") + 1)
    x = df.withColumn("__own", own).withColumn("__level", F.explode(F.sequence("__own", F.lit(len(GROWTH) - 1))))
    x = x.withColumn("__first", F.floor(F.col(low) / width)).withColumn("__bucket", F.explode(F.sequence("__first", F.floor(F.col(high) / width))))
    at_own = F.array(F.lit(0), F.lit(1)) if right else F.array(F.lit(0))
    return x.withColumn("__role", F.explode(F.when(F.col("__level") == F.col("__own"), at_own).otherwise(F.array(F.lit(0 if right else 1)))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], base: int) -> DataFrame:
    """All pairs of equal ``key`` whose ranges share a point, each once.

    An equi join on key, level and bucket. Buckets grow by level, and a pair is looked for
    at the level of its longer range only: a range over the whole time is one or two rows
    there, and short ranges are a row or two for each level. A pair is reported in the first
    bucket that both share. ``base`` is the width of the smallest buckets, about the length
    of a short range. Rows with a null key or bound, or with low above high, have no partner.
    Columns of the two sides must have different names, but for the key.
    """
    def fine(r: tuple[str, str]) -> Column:
        return F.col(key).isNotNull() & F.col(r[0]).isNotNull() & (F.col(r[0]) <= F.col(r[1]))

    a = spread(left.where(fine(left_range)), *left_range, base, False)
    b = spread(right.where(fine(right_range)), *right_range, base, True)
    b = b.select(*[F.col(c).alias(f"__r{c}" if c.startswith("__") or c == key else c) for c in b.columns])
    meet = (F.col(key) == F.col(f"__r{key}")) & (F.col("__level") == F.col("__r__level")) & (F.col("__bucket") == F.col("__r__bucket")) & (F.col("__role") == F.col("__r__role"))
    share = (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    first = F.col("__bucket") == F.greatest("__first", "__r__first")
    pairs = a.join(b, meet & share & first)
    return pairs.select(*left.columns, *[c for c in right.columns if c != key])


def gaps(stored: DataFrame, requests: DataFrame, key: str, at: str, low: str, high: str, span: int = 4096) -> DataFrame:
    """Parts of each request (key, low, high) in which nothing is stored (key, at), as gap_low to gap_high.

    Gaps between neighbours come from windows over (key, span of ``span`` points), those
    between spans from a table of one row for each span, so that a hot key is many groups.
    They are intersected with the requests by an overlap join.
    """
    wanted = requests.groupBy(key).agg(F.min(low).alias("__lo"), F.max(high).alias("__hi"))
    points = stored.select(key, F.col(at).alias("__at")).join(wanted, key).where(F.col("__at").between(F.col("__lo"), F.col("__hi")))
    points = points.withColumn("__span", F.floor(F.col("__at") / span))
    before = F.lag("__at").over(W.partitionBy(key, "__span").orderBy("__at"))
    inner = points.select(key, (before + 1).alias("g0"), (F.col("__at") - 1).alias("g1")).where("g0 <= g1")
    spans = points.groupBy(key, "__span").agg(F.min("__at").alias("a"), F.max("__at").alias("b"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    w = W.partitionBy(key).orderBy("__span")
    ahead = F.struct(F.coalesce(F.lag("b").over(w) + 1, F.col("__lo")).alias("g0"), (F.col("a") - 1).alias("g1"))
    last = F.struct((F.col("b") + 1).alias("g0"), F.when(F.lead("a").over(w).isNull(), F.col("__hi")).alias("g1"))
    outer = spans.select(key, F.array(ahead, last).alias("__holes")).select(key, F.inline("__holes")).where("g0 <= g1")
    none = wanted.join(spans.select(key).distinct(), key, "left_anti").select(key, F.col("__lo").alias("g0"), F.col("__hi").alias("g1"))
    holes = inner.unionByName(outer).unionByName(none)
    found = overlap_join(requests, holes, key, (low, high), ("g0", "g1"), 32)
    return found.withColumn("gap_low", F.greatest(low, "g0")).withColumn("gap_high", F.least(high, "g1")).drop("g0", "g1")


def merged(ranges: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Ranges of each key that touch or overlap, as one (islands)."""
    w = W.partitionBy(key).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = ranges.select(key, low, high).withColumn("__new", F.coalesce((F.col(low) > reach + 1).cast("int"), F.lit(1)))
    x = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def chunks(ranges: DataFrame, low: str, high: str, length: int, overlap: int) -> DataFrame:
    """Ranges cut into chunks of at most ``length`` points; each chunk but the first begins ``overlap`` points early."""
    start = F.explode(F.sequence(F.col(low), F.col(high), F.lit(length)))
    x = ranges.withColumn("chunk_start", start)
    return x.withColumn("chunk_low", F.greatest(F.col(low), F.col("chunk_start") - overlap)).withColumn("chunk_high", F.least(F.col(high), F.col("chunk_start") + length - 1)).drop("chunk_start")
