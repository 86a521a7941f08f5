"""Alert rules as data: rules are rows, their conditions SQL expressions.

All conditions are columns of one projection over the snapshots, so that a further rule
adds no scan and no join; a snapshot is exploded once into the rules that it meets. The
cooldown is state for each (rule, key). Acknowledgements are an append-only log that is
folded to the current state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators import simulation

SEVERITIES = ("INFO", "WARNING", "CRITICAL")


@dataclass(frozen=True)
class Rule:
    """A rule: its id and name, when it fires, how severe it is and how long it then rests."""

    rule_id: str
    name: str
    condition: str
    severity: str = "WARNING"
    cooldown: int = 300

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or self.cooldown < 0:
            raise ValueError(f"{self.rule_id}: severity is one of {', '.join(SEVERITIES)}, a cooldown is 0 or more seconds")


def read_rules(table: DataFrame, most: int = 10_000) -> list[Rule]:
    """Rules of a table (rule_id, name, condition, severity, cooldown), by id; a table of ticks is not one of rules."""
    rows = table.select("rule_id", "name", "condition", "severity", "cooldown").orderBy("rule_id").limit(most + 1).collect()
    if len(rows) > most or len({r.rule_id for r in rows}) < len(rows):
        raise ValueError(f"a rule table has at most {most} rows, one for each id")
    return [Rule(*r) for r in rows]


def set_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """The rules with this one added, or in place of the one with its id."""
    kept = [rule if r.rule_id == rule.rule_id else r for r in rules]
    return kept if rule in kept else [*kept, rule]


def matches(snapshots: DataFrame, rules: list[Rule], key: str, ts: str, seq: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(rule_id, severity, cooldown, key, ts, seq) of every snapshot and rule whose condition holds.

    A condition that is null on a snapshot does not fire; conditions can use any column of
    the snapshots and should use ``try_`` functions where a value can be bad. ``extra``
    columns are carried along.
    """
    kind = "struct<rule_id: string, severity: string, cooldown: int>"
    fired = [F.when(F.expr(r.condition), F.struct(F.lit(r.rule_id), F.lit(r.severity), F.lit(r.cooldown)).cast(kind)) for r in rules]
    every = F.array_compact(F.array(*fired)) if fired else F.array().cast(f"array<{kind}>")
    x = snapshots.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), *extra, every.alias("fired"))
    return x.select(F.inline("fired"), "key", "ts", "seq", *extra)


class RuleCooldown(simulation.Cooldown):
    """A cooldown whose length is that of the rule, which all rows of a key share."""

    def __init__(self) -> None:
        super().__init__("ts", 0)

    def step(self, key: str, part: pd.DataFrame) -> pd.DataFrame:
        self.wait = pd.Timedelta(seconds=int(part["cooldown"].iloc[0])).to_timedelta64()
        return super().step(key, part)


def alerts(matched: DataFrame) -> DataFrame:
    """Of each rule and key the matches that its cooldown lets through, over stored snapshots."""
    x = matched.withColumn("state", F.concat_ws("|", "rule_id", F.col("key").cast("string")))
    return simulation.in_order(x, "state", ["ts", "seq"], x.schema, RuleCooldown).drop("state")


ALERT = "rule_id string, severity string, cooldown int, key string, ts timestamp, seq long"


class CooldownState(StatefulProcessor):
    """The time at which each rule last fired for each key, in microseconds."""

    columns = [c.split()[0] for c in ALERT.split(", ")]

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        x = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        wait, keep = int(x["cooldown"].iloc[0]) * 1_000_000, []
        for at in x["at"]:
            fires = last is None or at - last >= wait
            last = at if fires else last
            keep.append(fires)
        if last != before:
            self.last.update((last,))
        yield x[keep][self.columns]

    def close(self) -> None:
        pass


def alert_stream(matched: DataFrame) -> DataFrame:
    """The same over a stream of matches; state is one number for each rule and key."""
    x = matched.select("rule_id", "severity", "cooldown", F.col("key").cast("string").alias("key"), "ts", "seq", F.unix_micros("ts").alias("at"))
    return x.groupBy("rule_id", "key").transformWithStateInPandas(CooldownState(), ALERT, "Append", "None")


def acknowledged(raised: DataFrame, log: DataFrame, by: list[str]) -> DataFrame:
    """Alerts with ``acknowledged`` as the log leaves them.

    The log (``by``, log_ts, log_seq, action: ack or reopen) is only ever appended to; an
    entry is about all alerts of its ``by`` up to its time. So the last entry decides for an
    alert, if it is not older: one row for each ``by``, added up before the join.
    """
    last = log.groupBy(*by).agg(F.max_by(F.struct("log_ts", "action"), F.struct("log_ts", "log_seq")).alias("__last"))
    said = (F.col("__last.log_ts") >= F.col("ts")) & (F.col("__last.action") == "ack")
    return raised.join(last, by, "left").withColumn("acknowledged", F.coalesce(said, F.lit(False))).drop("__last")
