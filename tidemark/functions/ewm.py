"""Exponentially weighted means as an associative scan, in windows only.

A mean is a recursion y = q * y_before + b, and any stretch of rows is one pair (decay,
weighted sum): the pair of two stretches follows from theirs. So a series is cut into
blocks of rows; within a block the sums come from windows over it, a block's pair is one
row of a small table, and what goes on from one block to the next is composed over that
table. A series of any length is many groups. Blocks are short enough that powers of q
stay exact to about 1e-5 of the double's precision; blocks so far back that their weight
is below 1e-18 are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import time_bucket

#: Least power of q within a block, and least weight of a block that still counts, as exponents of e.
BLOCK, REACH = 23.0, 42.0


def ewm(df: DataFrame, specs: dict[str, tuple[str, int, bool]], by: str = "symbol", order: str = "d", span: int | None = None) -> DataFrame:
    """Add columns: name -> (source column, span of the mean, adjust).

    With ``adjust`` the mean has weights q^age over the values, ages counted in rows, also in
    rows without a value. Without, it is y = q * y + (1 - q) * x from the first value on, and
    rows without a value keep it. q is 1 - 2 / (span + 1). Before the first value a mean is null.
    ``span`` is the time of a stretch as in an as-of join; rows of one ``by`` at the same
    time have no order among themselves.
    """
    q = {name: max(1 - 2 / (n + 1), 1e-9) for name, (_, n, _) in specs.items()}
    rows = max(1, math.floor(BLOCK / -math.log(min(q.values()))))
    reach = math.ceil(REACH / -math.log(max(q.values())))
    x = df.withColumn("__bucket", time_bucket(df, order, span))
    x = x.withColumn("__n", F.row_number().over(W.partitionBy(by, "__bucket").orderBy(order)))
    x = x.withColumn("__block", F.floor((F.col("__n") - 1) / rows))
    block = W.partitionBy(by, "__bucket", "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("__j", F.row_number().over(W.partitionBy(by, "__bucket", "__block").orderBy(order)))
    x = x.withColumns({f"__c_{k}": F.count(F.col(c)).over(block) for k, (c, _, _) in specs.items()})
    own = {}
    for k, (c, _, adjust) in specs.items():
        at, value = F.col("__j" if adjust else f"__c_{k}"), F.col(c)
        grow, decay = F.pow(F.lit(1 / q[k]), at), F.pow(F.lit(q[k]), at)
        own[f"__a_{k}"] = decay
        own[f"__s_{k}"] = decay * F.coalesce(F.sum(value * grow * (1.0 if adjust else 1 - q[k])).over(block), F.lit(0.0))
        own[f"__w_{k}"] = decay * F.coalesce(F.sum(F.when(value.isNotNull(), grow)).over(block), F.lit(0.0))
        own[f"__f_{k}"] = F.first(value, ignorenulls=True).over(block)
    x = x.withColumns(own)
    key = [by, "__bucket", "__block"]
    ends = x.groupBy(*key).agg(F.max("__j").alias("rows"), *[F.max_by(F.struct(f"__a_{k}", f"__s_{k}", f"__w_{k}", f"__f_{k}", f"__c_{k}"), "__j").alias(k) for k in specs])
    line = W.partitionBy(by).orderBy("__bucket", "__block")
    so_far = line.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("upto", F.sum("rows").over(line.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("start", F.col("upto") - F.col("rows"))
    # Blocks that end within ``reach`` rows before this one begins; their ends are at most that far back.
    near = W.partitionBy(by).orderBy("upto").rangeBetween(-(reach + 2 * rows), -1)

    def composed(k: str, adjust: bool) -> Column:
        """(weighted sum, weight) that go into the block."""
        first = F.first(f"{k}.__f_{k}", ignorenulls=True).over(so_far)
        begin = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")) if adjust else F.struct(F.coalesce(first, F.lit(0.0)).alias("s"), F.lit(0.0).alias("w"))
        step = lambda acc, b: F.struct((acc.s * b[f"__a_{k}"] + b[f"__s_{k}"]).alias("s"), (acc.w * b[f"__a_{k}"] + b[f"__w_{k}"]).alias("w"))
        return F.aggregate(F.collect_list(k).over(near), begin, step)

    carried = ends.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(key)],
        *[F.coalesce(F.sum(f"{k}.__c_{k}").over(so_far), F.lit(0)).alias(f"__before_{k}") for k in specs],
        *[F.first(f"{k}.__f_{k}", ignorenulls=True).over(so_far).alias(f"__first_{k}") for k in specs],
        *[composed(k, adjust).alias(f"__in_{k}") for k, (_, _, adjust) in specs.items()],
    )
    same = F.col(by).eqNullSafe(F.col("__0")) & (F.col("__bucket") == F.col("__1")) & (F.col("__block") == F.col("__2"))
    x = x.join(carried, same)
    out = {}
    for k, (_, _, adjust) in specs.items():
        a, s, before = F.col(f"__a_{k}"), F.col(f"__in_{k}.s"), F.col(f"__before_{k}")
        if adjust:
            mean = (a * s + F.col(f"__s_{k}")) / (a * F.col(f"__in_{k}.w") + F.col(f"__w_{k}"))
        else:  # as if the first value had stood before the series
            mean = a * F.when(before > 0, s).otherwise(F.col(f"__f_{k}")) + F.col(f"__s_{k}")
        # The mean of one value is that value, to the last bit: means of different spans start out equal.
        seen, first = before + F.col(f"__c_{k}"), F.coalesce(f"__first_{k}", f"__f_{k}")
        out[k] = F.when(seen == 1, first).when(seen > 0, mean)
    return x.select(*df.columns, *[v.alias(k) for k, v in out.items()])
