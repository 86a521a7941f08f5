"""Models as plug-ins, the memo, late rows and windows over several files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import memo, models, runs
from tidemark.streaming import flows, late

T = dt.datetime(2024, 1, 1)
DAY = dt.date(2024, 1, 10)


def minute(m):
    return T + dt.timedelta(minutes=m)


# models


@pytest.fixture
def pit(spark, tmp_path):
    rows = [("a", dt.date(2024, 1, d), float(d)) for d in range(1, 21)] + [("b", dt.date(2024, 1, 15), 9.0)]
    spark.createDataFrame(rows, "ticker string, d date, close double").write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    return models.PointInTime(spark, DAY, {"bars": (bars, "d")}), bars


def newest(b):
    return b.groupBy("ticker").agg((F.max_by("close", "d") / 100).alias("value"))


def test_models_see_nothing_after_the_date(pit):
    known, _ = pit
    r = models.Registry()
    r.model("last", "s", 2.0)(lambda p: newest(p.table("bars")))
    got = r.views(known).collect()
    assert [(v.strategy, v.model, v.weight, v.ticker, v.d, v.value, v.abstained) for v in got] == [("s", "last", 2.0, "a", DAY, 0.1, False)]


def test_models_that_look_ahead_are_refused(spark, pit):
    known, bars = pit
    ahead = {
        "plain": lambda p: newest(bars),
        "joined": lambda p: p.table("bars").join(bars.groupBy("ticker").agg(F.max("close").alias("top")), "ticker").select("ticker", (F.col("top") / 100).alias("value")),
        "union": lambda p: newest(p.table("bars").union(bars)),
        "inner": lambda p: newest(p.table("bars")).where(F.col("value") < F.lit(1.0)).union(spark.sql("select 'a' as ticker, 0.5D as value from future where close > 0")),
        "other_date": lambda p: newest(models.PointInTime(spark, dt.date(2024, 1, 20), {"bars": (bars, "d")}).table("bars")),
        "own_filter": lambda p: newest(bars.where("d <= date'2024-01-10'")),
    }
    bars.createOrReplaceTempView("future")
    for name, fn in ahead.items():
        r = models.Registry()
        r.model(name, "s")(fn)
        with pytest.raises(models.LookAhead, match=name):
            r.views(known)


def test_schemas_names_and_convictions_are_checked(spark, pit):
    known, _ = pit
    r = models.Registry()
    r.model("wrong", "s")(lambda p: p.table("bars").select("ticker"))
    with pytest.raises(TypeError, match="value double"):
        r.views(known)
    with pytest.raises(ValueError, match="registered already"):
        r.model("wrong", "s")
    wild = models.Registry()
    wild.model("wild", "s")(lambda p: p.table("bars").select("ticker", F.col("close").alias("value")))
    with pytest.raises(Exception, match="not within -1 to 1"):
        wild.views(known).collect()
    none = models.Registry()
    none.model("none", "s")(lambda p: p.table("bars").select("ticker", F.lit(None).cast("double").alias("value")).distinct())
    assert [(v.value, v.abstained) for v in none.views(known).collect()] == [(0.0, True)]
    none.price_source("close")(lambda p: p.table("bars").groupBy("ticker").agg(F.max_by("close", "d").alias("price")))
    assert [tuple(x) for x in none.marks(known, "close").collect()] == [("a", 10.0)]


# memo


def answering(spark, asked, fail=()):
    def compute(misses):
        def run(frames):
            for pdf in frames:
                asked.add(len(pdf))
                pdf["body"] = [None if x in fail else f"answer {x}" for x in pdf["x"]]
                yield pdf[["key", "body"]]

        return misses.mapInPandas(run, "key string, body string")

    return compute


def test_only_distinct_requests_without_an_answer_are_computed(spark, tmp_path):
    kept = memo.Memo(spark, str(tmp_path / "memo"), buckets=3)
    requests = spark.createDataFrame([(i % 5, "p" if i % 2 else None) for i in range(20)], "x long, p string")
    asked = [spark.sparkContext.accumulator(0) for _ in range(4)]
    first = kept.serve(requests, "m", ["x", "p"], answering(spark, asked[0], fail=(3,)))
    assert first.count() == 20 and asked[0].value == 10
    assert {(r.x, r.body) for r in first.collect()} == {(i, None if i == 3 else f"answer {i}") for i in range(5)}
    kept.serve(requests, "m", ["p", "x"], answering(spark, asked[1])).count()
    assert asked[1].value == 2  # only what failed, whatever the order of the names
    kept.serve(requests, "m", ["x", "p"], answering(spark, asked[2])).count()
    assert asked[2].value == 0
    kept.serve(requests, "other method", ["x", "p"], answering(spark, asked[3]))
    assert asked[3].value == 10


def test_requests_that_differ_by_run_are_evaluated_once(spark, tmp_path):
    """As a mean can, whose sum depends on the order in which its rows come."""
    kept = memo.Memo(spark, str(tmp_path / "memo"))
    drawn = F.udf(lambda _: random.random(), "double").asNondeterministic()
    requests = spark.range(20).select("id", drawn("id").alias("x"))
    got = kept.serve(requests, "m", ["id", "x"], answering(spark, spark.sparkContext.accumulator(0))).collect()
    assert len(got) == 20 and [r.body for r in got] == [f"answer {r.x}" for r in got]
    assert kept.asked == 20


def test_an_answer_that_is_not_valid_is_asked_for_again(spark, tmp_path):
    kept = memo.Memo(spark, str(tmp_path / "memo"))
    requests = spark.createDataFrame([(1,), (2,)], "x long")
    asked = [spark.sparkContext.accumulator(0) for _ in range(2)]
    kept.serve(requests, "m", ["x"], answering(spark, asked[0]))
    valid = ~F.col("body").endswith("1")
    kept.serve(requests, "m", ["x"], answering(spark, asked[1]), valid)
    assert asked[1].value == 1


def test_folding_answers(spark):
    answers = ['{"signal": "bullish", "confidence": 80}', '{"signal": " BEARISH", "confidence": 5}', '{"signal": "neutral", "confidence": 0}', '{"signal": "bullish", "confidence": 101}', '{"signal": "up", "confidence": 1}', '{"signal": "bullish"}', "not json", "", None]
    value, abstained = memo.signal_of(F.col("body"))
    got = [(r.value, r.abstained) for r in spark.createDataFrame([(a,) for a in answers], "body string").coalesce(1).select(value.alias("value"), abstained.alias("abstained")).collect()]
    assert got == [(0.8, False), (-0.05, False), (0.0, False)] + [(0.0, True)] * 6


# runs


def test_runs_are_saved_once_renamed_deleted_and_listed(spark, tmp_path):
    schema = "run_id string, name string, created timestamp, params string, metrics map<string, double>"
    made = spark.createDataFrame([(f"r{i}", f"run {i}", minute(i // 2), "{}", {"sharpe": float(i)}) for i in range(6)], schema)
    store = runs.RunStore(spark, str(tmp_path / "runs"), 3)
    assert store.page().count() == 0
    store.save(made)
    store.rename(spark.createDataFrame([("r1", " one "), ("r2", "  "), ("none", "x")], "run_id string, name string"))
    store.delete(spark.createDataFrame([("r5",), ("r5",), ("none",)], "run_id string"))
    store.save(made.withColumn("name", F.lit("again")))
    assert [(r.run_id, r.name) for r in store.page().collect()] == [("r4", "run 4"), ("r2", "run 2"), ("r3", "run 3"), ("r0", "run 0"), ("r1", "one")]
    assert [r.run_id for r in store.page(1, 2).collect()] == ["r2", "r3"]
    assert store.get("r5").count() == 0 and store.get("r1").first().metrics == {"sharpe": 1.0}
    assert sorted((r.run_id, r.sharpe, r.other) for r in store.compare(["sharpe", "other"]).collect()) == [(f"r{i}", float(i), None) for i in range(5)]


# late rows and windows

ROW = "trade_id long, symbol string, ts timestamp, price double, amount double"


def put(spark, rows, folder):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_split_off_and_counted_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    files = [[(i * 50 + k, "s", minute(i * 60 + rng.randrange(-90, 60)), 1.0 + k, 1.0) for k in range(50)] for i in range(4)]
    files[2][0] = (100, "s", None, 1.0, 1.0)
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "split"))
    want, seen = set(), None
    for rows in files:
        want |= {r[0] for r in rows if r[2] is None or seen and r[2] < seen - dt.timedelta(minutes=10)}
        seen = max([t for t in [seen, *(r[2] for r in rows)] if t])
    for n, rows in enumerate(files):
        put(spark, rows, source)
        split = late.LateSplit(spark, out, spark.createDataFrame([], ROW).schema, "ts", 600)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        if n == 2:  # the tables are written, but the batch is not published

            def crash(_):
                raise OSError("lost")

            publish, split.publish = split.publish, crash
            with pytest.raises(Exception, match="lost"):
                late.split_stream(stream, split, state)
            split.publish = publish
        late.split_stream(stream, split, state)
    assert {r.trade_id for r in split.late().collect()} == want and len(want) > 20
    assert split.counts() == {"on_time": 200 - len(want), "late": len(want)} and split.on_time().count() == 200 - len(want)
    before = split.counts()
    split.apply(spark.createDataFrame(files[3], ROW), 3)
    assert split.counts() == before


def test_a_table_without_late_rows_is_empty(spark, tmp_path):
    split = late.LateSplit(spark, str(tmp_path / "s"), spark.createDataFrame([], ROW).schema, "ts", 600)
    assert split.late().count() == split.on_time().count() == 0
    split.apply(spark.createDataFrame([], ROW), 0)
    assert split.manifest() == {"batch": 0, "seen": None, "on_time": 0, "late": 0}


def test_sliding_mean_prices_over_several_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), minute(i * 2), rng.uniform(1, 9), float(rng.randrange(4))) for i in range(240)]
    source = str(tmp_path / "in")
    for first in range(0, 240, 80):
        put(spark, rows[first : first + 80], source)
        stream = spark.readStream.schema(ROW).parquet(source)
        out = flows.drain(flows.vwap(stream), str(tmp_path / "run"))
    got = {(r.symbol, r.start): (r.vwap, r.volume, r.n) for r in out.collect()}
    edge, want = rows[-1][2] - dt.timedelta(minutes=10), {}
    for quarter in range(-4, 40):
        start = minute(15 * quarter)
        for s in "ab":
            inside = [r for r in rows if r[1] == s and start <= r[2] < start + dt.timedelta(hours=1)]
            if inside and start + dt.timedelta(hours=1) <= edge:
                volume = sum(r[4] for r in inside)
                want[s, start] = (sum(r[3] * r[4] for r in inside) / volume if volume else None, volume, len(inside))
    assert got.keys() == want.keys() and out.count() == len(got)
    for k, (vwap, volume, n) in want.items():
        assert got[k] == (pytest.approx(vwap), volume, n)


def test_throttled_snapshots_do_not_depend_on_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), T + dt.timedelta(seconds=i * 2 + rng.random()), 1.0 * i, 1.0) for i in range(300)]
    want, last = [], {}
    for _, s, t, p, _ in rows:
        if s not in last or t - last[s] >= dt.timedelta(seconds=30):
            last[s] = t
            want.append((s, t, p))
    for first in range(0, 300, 100):
        put(spark, rows[first : first + 100], str(tmp_path / "in"))
        stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
        with flows.disk_state(spark):
            out = flows.drain(flows.throttle(stream, 30), str(tmp_path / "run"))
    assert sorted(map(tuple, out.collect())) == sorted(want)
