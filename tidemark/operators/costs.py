"""Fees, slippage, margin tiers, liquidation prices and funding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fee rates (maker, taker) by market and VIP tier 0 to 3; margin tiers (notional below, rate).
FEES = {
    "spot": ((0.0010, 0.0010), (0.0009, 0.0010), (0.0008, 0.0010), (0.0007, 0.0009)),
    "perp": ((0.0002, 0.0005), (0.00016, 0.0004), (0.00010, 0.0003), (0.00008, 0.0002)),
}
MARGIN_TIERS = ((50_000, 0.005), (250_000, 0.010), (1_000_000, 0.015))
LAST_TIER = 0.025
ADV = 15e9


def fee(notional: Column, market: Column, tier: int, maker: bool, discount: float = 0.0) -> Column:
    """Trading fee of a notional by market type and VIP tier."""
    rate = F.lit(None).cast("double")
    for name, tiers in FEES.items():
        rate = F.when(market == name, tiers[tier][0 if maker else 1]).otherwise(rate)
    return notional * rate * (1 - discount)


def slippage(notional: Column, adv: float = ADV) -> Column:
    """Linear in participation: 2 bps plus the share of daily volume."""
    return notional * (2 + F.abs(notional) / adv * 1e4) / 1e4


def maintenance_rate(notional: Column) -> Column:
    rate = F.lit(LAST_TIER)
    for below, r in reversed(MARGIN_TIERS):
        rate = F.when(notional < below, r).otherwise(rate)
    return rate


def liquidation_price(entry: Column, leverage: Column, long: Column, rate: Column) -> Column:
    """Price at which the margin is used up to the maintenance rate."""
    return F.when(long, entry * (1 - 1 / leverage + rate)).otherwise(entry * (1 + 1 / leverage - rate))
