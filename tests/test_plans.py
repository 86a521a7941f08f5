"""Every registered plan against its DuckDB SQL."""

import os

import duckdb
import pytest

from tidemark.plans import registry

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.plans()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    out = {}
    for sf in (SMALL, SF):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return out


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(4) + 0.0
        frame[c] = frame[c].map(lambda x: "null" if x is None or x != x else repr(round(float(x), 4)) if isinstance(x, float) else str(x).replace(" 00:00:00", ""))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", [SMALL, SF], ids=["small", "large"])
def test_matches_oracle(spark, con, sf, name):
    got, want = normal(QUERIES[name](spark, sf).toPandas()), normal(con[sf].sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) and (len(got) > 0 or sf == SMALL)
    differ = (got != want).any(axis=1)
    assert not differ.any(), (got[differ].head(), want[differ].head())


#: No SQL: random draws, Student's p-values, and a queue of orders (cases by hand in test_operators.py).
WITHOUT_SQL = {"bootstrap_ci", "car_t_test", "paper_match"}


def test_plans_without_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def test_the_entry_module_runs_on_the_smoke_tables(spark):
    import __spark_entry__ as entry

    first = entry.entry(spark)
    assert first.count() >= 0 and first.schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    for name in WITHOUT_SQL:
        assert QUERIES[name](spark, SMALL).count() >= 0


def test_books_add_up(spark):
    """What holds for every row of the books without SQL."""
    v1 = QUERIES["v1_book"](spark, SF).toPandas()
    assert (v1.long >= 0).all() and (v1.short >= 0).all() and (v1.margin >= -1e-6).all() and v1.filled.gt(0).any()
    perp = QUERIES["perp_ledger"](spark, SF).toPandas()
    assert {"opened", "hold"} <= set(perp.event) <= {"opened", "hold", "added", "rejected", "closed", "reversed", "liquidated"}
    flat = perp[perp.event.isin(["closed", "liquidated"])]
    assert (flat.cash == flat.equity).all()
    paper = QUERIES["paper_match"](spark, SF).toPandas()
    asked = spark.read.parquet(f"{SF}/events.parquet").where("value > 0 and event_id % 10 in (3, 7)").count()
    assert len(paper) == asked and (paper.cash >= 0).all() and (paper.held >= 0).all()
    t = QUERIES["car_t_test"](spark, SF).toPandas()
    assert t.p.between(0, 1).all() and (t.t.abs().argsort().values[::-1][:1] == t.p.argsort().values[:1]).all()
    b = QUERIES["bootstrap_ci"](spark, SF).toPandas()
    assert (b.ci_low < b["mean"]).all() and (b["mean"] < b.ci_high).all()


def test_event_windows_take_the_nearest_second(spark, tmp_path):
    """Times with fractions of a second at the ends of the windows, as the SQL's cast rounds them."""
    import pandas as pd

    at = [0.0, 0.4, 0.5, 0.6, 1.5, 2.5, 14399.5, 14400.4, 14400.5, 14400.6, 14401.5, 28800.49, 28801.5, 28802.6]
    events = pd.DataFrame({"event_id": range(len(at)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="s"), "user_id": 1, "event_type": "view", "value": [100.0 + 10 * i for i in range(len(at))], "props": "{}"})
    events["ts"] = events.ts.dt.round("us").astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet", index=False)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = normal(QUERIES["event_window_vol"](spark, str(tmp_path)).toPandas()), normal(db.sql(SQL["event_window_vol"]).df())
    assert len(want) == 8 and got.equals(want)


def test_a_part_of_the_delayed_replay_is_many_files(spark, con, tmp_path):
    """No part passes through a single task; what is late stays the same."""
    from tidemark.plans import stream

    for i in range(3):
        con[SMALL].sql(f"select * from events where event_id % 3 = {i}").df().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{i}.parquet", index=False)
    (tmp_path / "sf").mkdir()
    spark.read.parquet(str(tmp_path / "*.parquet")).repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    split, path = stream.delayed_replay(spark, str(tmp_path / "sf"))
    n_files = len({r[0] for r in spark.read.parquet(f"{path}/in").selectExpr("input_file_name()").collect()})
    n_parts = spark.read.parquet(f"{path}/in").select("part").distinct().count()
    assert n_files > n_parts == split.manifest()["batch"] + 1 > 5
    want = {r[0] for r in con[SMALL].sql(SQL["stream_late_rows"]).fetchall()}
    assert {r.trade_id for r in split.late().collect()} == want
