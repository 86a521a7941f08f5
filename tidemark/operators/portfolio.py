"""From views to target books: blending, netting, risk limits and share targets, all set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blend(views: DataFrame, gross: float = 1.0, neutral: bool = False) -> DataFrame:
    """(strategy, d, ticker, conviction, weight): weighted mean of the views that did not abstain, scaled to ``gross``.

    All abstained gives 0. ``neutral`` takes the mean of the strategy's convictions off first.
    """
    says = ~F.col("abstained")
    c = views.groupBy("strategy", "d", "ticker").agg(F.coalesce(F.sum(F.when(says, F.col("weight") * F.col("value"))) / F.sum(F.when(says, F.col("weight"))), F.lit(0.0)).alias("conviction"))
    book = W.partitionBy("strategy", "d")
    x = F.col("conviction") - F.avg("conviction").over(book) if neutral else F.col("conviction")
    c = c.withColumn("x", x)
    total = F.sum(F.abs("x")).over(book)
    return c.withColumn("weight", F.when(total < 1e-9, 0.0).otherwise(F.col("x") / total * gross)).drop("x")


def net(sleeves: DataFrame, slices: dict[str, float]) -> DataFrame:
    """Sleeve weights added up by ticker, each strategy with its share of the slices."""
    whole = sum(slices.values())
    share = F.lit(0.0)
    for name, s in slices.items():
        share = F.when(F.col("strategy") == name, s / whole).otherwise(share)
    return sleeves.groupBy("d", "ticker").agg(F.sum(F.col("weight") * share).alias("weight"))


def limit(weights: DataFrame, position: float, gross: float) -> DataFrame:
    """Weights cut to +-``position``, then scaled so that their gross is at most ``gross``; with the audit columns."""
    cut = F.signum("weight") * F.least(F.abs("weight"), F.lit(position))
    w = weights.withColumn("capped", cut)
    total = F.sum(F.abs("capped")).over(W.partitionBy("d"))
    w = w.withColumn("scale", F.when(total > gross, gross / total).otherwise(1.0))
    return w.withColumn("final", F.col("capped") * F.col("scale"))


def target_shares(target: DataFrame, equity: float) -> DataFrame:
    """(d, ticker, shares): weights (``final``) of an equity in whole shares at the mark, cut toward zero."""
    return target.select("d", "ticker", (F.col("final") * equity / F.col("mark")).cast("long").alias("shares"))


def orders(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Signed share differences between wanted and held shares (d, ticker, shares); zero differences drop out.

    A held ticker that is no longer wanted is sold, a wanted one that is not held is bought.
    ``ordinal`` puts sells before buys, each by ticker.
    """
    w, h = wanted.withColumnRenamed("shares", "want"), held.withColumnRenamed("shares", "have")
    x = w.join(h, ["d", "ticker"], "full_outer").select("d", "ticker", (F.coalesce("want", F.lit(0)) - F.coalesce("have", F.lit(0))).alias("qty")).where("qty <> 0")
    x = x.withColumn("side", F.when(F.col("qty") > 0, "buy").otherwise("sell"))
    return x.withColumn("ordinal", F.row_number().over(W.partitionBy("d").orderBy(F.col("qty") > 0, "ticker")))
