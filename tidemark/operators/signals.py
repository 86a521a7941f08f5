"""Signals as row expressions: threshold ladders, lexicon sentiment, ensembles and point-in-time views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentiment words, and the substrings that mark a risk market.
BULLISH = ("moon", "bull", "bullish", "long", "buy", "up", "rally", "surge", "pump", "breakout", "all-time high", "ath", "undervalued", "growth", "strong")
BEARISH = ("bear", "bearish", "short", "sell", "down", "crash", "dump", "correction", "overvalued", "weak", "decline", "drop", "loss", "red")
RISK_WORDS = ("war", "conflict", "attack", "invasion", "nuke", "nuclear", "sanctions", "ban", "restrict", "default", "recession", "fed rate", "rate hike", "tariff", "crisis", "crash", "btc ban", "crypto ban", "sec", "regulation")
TECHNICAL_WEIGHTS = {"trend": 0.25, "mean_reversion": 0.20, "momentum": 0.25, "volatility": 0.15, "stat_arb": 0.15}
CRYPTO_WEIGHTS = {"trend": 0.30, "mean_reversion": 0.15, "momentum": 0.30, "volatility": 0.15, "stat_arb": 0.10}


def whole(x: Column) -> Column:
    """Cut to a whole number, after rounding away the noise of the last digits."""
    return F.floor(F.round(x, 6)).cast("long")


def nvt_proxy(nvt: Column) -> tuple[Column, Column]:
    """(signal, confidence) of the NVT proxy ladder."""
    signal = F.when(nvt > 150, "bearish").when(nvt < 40, "bullish").otherwise("neutral")
    grown = F.when(nvt > 150, F.least(whole((nvt - 150) / 150 * 50), F.lit(40))).when(nvt < 40, F.least(whole((40 - nvt) / 40 * 50), F.lit(40)))
    return signal.alias("signal"), F.coalesce(grown, F.lit(15)).alias("confidence")


def mvrv(value: Column) -> tuple[Column, Column]:
    """(signal, confidence) of the MVRV ladder; null gives neutral 0."""
    signal = F.when(value > 3.5, "bearish").when(value < 1, "bullish").otherwise("neutral")
    grown = F.when(value > 3.5, F.least(whole((value - 3.5) / 3.5 * 100), F.lit(90))).when(value < 1, F.least(whole((1 - value) * 100), F.lit(90))).when(value.isNotNull(), F.lit(30))
    return signal.alias("signal"), F.coalesce(grown, F.lit(0)).alias("confidence")


def ensemble(parts: dict[str, tuple[Column, Column]], weights: dict[str, float], limit: float = 0.2) -> tuple[Column, Column]:
    """(signal, score): signs weighted by weight x confidence; neutral parts dilute."""
    top = sum((s * weights[k] * c for k, (s, c) in parts.items()), F.lit(0.0))
    base = sum((weights[k] * c for k, (s, c) in parts.items()), F.lit(0.0))
    score = F.when(base > 0, top / base).otherwise(0.0)
    return F.when(score > limit, "bullish").when(score < -limit, "bearish").otherwise("neutral"), score


def weighted_votes(parts: dict[str, tuple[Column, Column]], weights: dict[str, float], limit: float) -> tuple[Column, Column, Column]:
    """(signal, confidence, score) of votes (sign, confidence): those without confidence have no weight; null score without any."""
    w = {k: F.when(F.coalesce(c, F.lit(0)) > 0, F.lit(float(weights[k]))).otherwise(0.0) for k, (_, c) in parts.items()}
    total = sum(w.values(), F.lit(0.0))
    score = F.round(F.try_divide(sum((s * w[k] for k, (s, _) in parts.items()), F.lit(0.0)), total), 9)
    confidence = whole(F.try_divide(sum((F.coalesce(c, F.lit(0)) * w[k] for k, (_, c) in parts.items()), F.lit(0.0)), total))
    signal = F.when(score > limit, "bullish").when(score < -limit, "bearish").otherwise("neutral")
    return signal, F.coalesce(confidence, F.lit(0)), score


def lexicon_sentiment(posts: DataFrame, text: str, bullish: list[str], bearish: list[str]) -> DataFrame:
    """Label and confidence from the distinct words of a text that are in either list."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))
    up = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in bullish])))
    down = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in bearish])))
    x = posts.withColumn("__u", up).withColumn("__d", down)
    label = F.when(F.col("__u") > F.col("__d"), "bullish").when(F.col("__u") < F.col("__d"), "bearish").otherwise("neutral")
    conf = F.when(F.col("__u") == F.col("__d"), 0.5).otherwise(F.least(0.5 + 0.1 * F.abs(F.col("__u") - F.col("__d")), F.lit(0.9)))
    return x.withColumn("label", label).withColumn("confidence", conf).drop("__u", "__d")


def aggregate_sentiment(scored: DataFrame, by: list[str]) -> DataFrame:
    """Confidence-weighted score, label counts and consensus of each group."""
    value = F.when(F.col("label") == "bullish", 1.0).when(F.col("label") == "bearish", -1.0).otherwise(0.0)
    g = scored.groupBy(*by).agg(
        (F.sum(value * F.col("confidence")) / F.sum("confidence")).alias("score"),
        *[F.sum((F.col("label") == k).cast("long")).alias(f"n_{k}") for k in ("bullish", "bearish", "neutral")],
        F.count(F.lit(1)).alias("n"),
    )
    label = F.when(F.col("score") > 0.1, "bullish").when(F.col("score") < -0.1, "bearish").otherwise("neutral")
    return g.withColumn("label", label).withColumn("consensus", F.greatest("n_bullish", "n_bearish", "n_neutral") / F.col("n"))
