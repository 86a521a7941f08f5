"""Alpha models and price sources as plug-ins that work on whole tables.

A model is a function from a point in time to a DataFrame of views, for all tickers at
once. It sees tables through :class:`PointInTime`, which lets no row after the date through;
and before a model's plan runs, every leaf of it must lie below such a filter, so that a
model which reads a table past the guard is refused and not merely trusted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {"ticker": "string", "value": "double"}
PRICES = {"ticker": "string", "price": "double"}


class LookAhead(ValueError):
    """A plan that can see rows after its date."""


class PointInTime:
    """Named tables as they were known on a date: rows whose date column is not after it."""

    def __init__(self, spark: SparkSession, as_of: dt.date, tables: dict[str, tuple[DataFrame, str]]) -> None:
        self.spark, self.as_of, self._tables = spark, as_of, tables

    @property
    def mark(self) -> str:
        return f"as-of guard {self.as_of.isoformat()}"

    def table(self, name: str) -> DataFrame:
        df, date = self._tables[name]
        return df.where((F.to_date(date) <= F.lit(self.as_of)) & F.lit(self.mark).isNotNull())

    def check(self, name: str, df: DataFrame) -> None:
        """Refuse a plan with a leaf that no guard of this date is above."""
        open_ = list(unguarded(df._jdf.queryExecution().analyzed(), self.mark, False))
        if open_:
            raise LookAhead(f"{name} reads past {self.as_of}: {open_[0]}")


def unguarded(node, mark: str, below: bool):
    """Leaves of an analysed plan that read data and have no filter with the mark above them."""
    kind = node.getClass().getSimpleName()
    below = below or kind == "Filter" and mark in node.condition().toString()
    children, inner = node.children(), node.subqueries()
    if children.isEmpty() and not below and kind not in ("OneRowRelation", "Range"):
        yield node.simpleString(3)
    for part in (children, inner):
        for i in range(part.size()):
            yield from unguarded(part.apply(i), mark, below)


@dataclass
class Registry:
    """Models by name, with the strategy and weight that they have there, and price sources."""

    models: dict[str, tuple[Callable[[PointInTime], DataFrame], str, float]] = field(default_factory=dict)
    prices: dict[str, Callable[[PointInTime], DataFrame]] = field(default_factory=dict)

    def model(self, name: str, strategy: str, weight: float = 1.0):
        """Decorator that registers a model; a name can be taken once."""
        return self._add(self.models, name, lambda fn: (fn, strategy, weight))

    def price_source(self, name: str):
        return self._add(self.prices, name, lambda fn: fn)

    @staticmethod
    def _add(where: dict, name: str, entry):
        if name in where:
            raise ValueError(f"{name} is registered already")

        def add(fn):
            where[name] = entry(fn)
            return fn

        return add

    def views(self, pit: PointInTime, names: list[str] | None = None) -> DataFrame:
        """(strategy, model, weight, ticker, d, value, abstained) of the models, all as of the date.

        A value outside -1 to 1 fails the job; a null one abstains.
        """
        parts = []
        for name in names or list(self.models):
            fn, strategy, weight = self.models[name]
            x = checked(name, fn(pit), VIEWS)
            pit.check(name, x)
            bad = F.raise_error(F.concat(F.lit(f"{name}: conviction of "), F.col("ticker"), F.lit(" is not within -1 to 1")))
            value = F.when(F.abs("value") > 1, bad.cast("double")).otherwise(F.coalesce("value", F.lit(0.0)))
            parts.append(x.select(F.lit(strategy).alias("strategy"), F.lit(name).alias("model"), F.lit(float(weight)).alias("weight"), "ticker", F.lit(pit.as_of).alias("d"), value.alias("value"), F.col("value").isNull().alias("abstained")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def marks(self, pit: PointInTime, name: str) -> DataFrame:
        """(ticker, price) of a price source as of the date."""
        x = checked(name, self.prices[name](pit), PRICES)
        pit.check(name, x)
        return x


def checked(name: str, df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of the schema, which must be there with these types."""
    kinds = dict(df.dtypes)
    wrong = [f"{c} {t}" for c, t in schema.items() if kinds.get(c) != t]
    if wrong:
        raise TypeError(f"{name} must return {', '.join(wrong)}; it has {', '.join(f'{c} {t}' for c, t in df.dtypes)}")
    return df.select(*schema)
