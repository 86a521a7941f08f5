"""Alert rules, ranges, backfills and keyed tables: cases by hand, brute force and failures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, backfill, intervals
from tidemark.streaming import flows, upserts

T = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# alerts

TICKS = "id long, symbol string, ts timestamp, price double, user_id long"


def ticks(spark, rows):
    return spark.createDataFrame([(i, s, T + dt.timedelta(seconds=t), p, u) for i, (s, t, p, u) in enumerate(rows)], TICKS)


def test_rules_rest_for_their_cooldown_by_key(spark):
    rules = [alerts.Rule("hi", "high", "price > 10", "CRITICAL", 60), alerts.Rule("any", "any", "price is not null", "INFO", 0)]
    rows = [("a", 0, 11.0, 1), ("a", 30, 12.0, 1), ("b", 30, 12.0, 1), ("a", 60, 12.0, 1), ("a", 61, 5.0, 1), ("a", 70, None, 1)]
    m = alerts.matches(ticks(spark, rows), rules, "symbol", "ts", "id")
    got = sorted((r.rule_id, r.key, r.seq) for r in alerts.alerts(m).collect())
    assert got == [("any", "a", 0), ("any", "a", 1), ("any", "a", 3), ("any", "a", 4), ("any", "b", 2), ("hi", "a", 0), ("hi", "a", 3), ("hi", "b", 2)]


def test_a_further_rule_adds_no_scan(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks(spark, [("a", 0, 1.0, 1)]).write.parquet(path)
    scans = []
    for n in (1, 5, 40):
        rules = [alerts.Rule(f"r{i}", "r", f"price > {i}", "INFO", 60) for i in range(n)]
        scans.append(plan_of(alerts.alerts(alerts.matches(spark.read.parquet(path), rules, "symbol", "ts", "id"))).count("FileScan"))
    assert scans == [1, 1, 1]


def test_alerts_of_a_stream_do_not_depend_on_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), rng.randrange(5_000), rng.uniform(0, 20), 1) for _ in range(300))
    rows.sort(key=lambda r: r[1])
    rules = [alerts.Rule("hi", "high", "price > 10", "CRITICAL", 600), alerts.Rule("lo", "low", "price < 5", "INFO", 45)]
    table = ticks(spark, rows)
    want = {(r.rule_id, r.key, r.seq) for r in alerts.alerts(alerts.matches(table, rules, "symbol", "ts", "id")).collect()}
    for first in range(0, 300, 100):
        table.where(F.col("id").between(first, first + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
        with flows.disk_state(spark):
            out = flows.drain(alerts.alert_stream(alerts.matches(stream, rules, "symbol", "ts", "id")), str(tmp_path / "run"))
    got = [(r.rule_id, r.key, r.seq) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_rules_are_rows(spark):
    rows = [("b", "B", "price > 2", "INFO", 5), ("a", "A", "price > 1", "WARNING", 0)]
    schema = "rule_id string, name string, condition string, severity string, cooldown int"
    rules = alerts.read_rules(spark.createDataFrame(rows, schema))
    assert [r.rule_id for r in rules] == ["a", "b"]
    changed = alerts.set_rule(alerts.set_rule(rules, alerts.Rule("a", "A", "price > 7", "INFO", 1)), alerts.Rule("c", "C", "false"))
    assert [(r.rule_id, r.condition) for r in changed] == [("a", "price > 7"), ("b", "price > 2"), ("c", "false")]
    with pytest.raises(ValueError, match="severity"):
        alerts.Rule("x", "x", "true", "LOUD")
    with pytest.raises(ValueError, match="one for each id"):
        alerts.read_rules(spark.createDataFrame(rows + rows, schema))
    assert alerts.matches(ticks(spark, [("a", 0, 1.0, 1)]), [], "symbol", "ts", "id").count() == 0


def test_acknowledgements_are_folded_from_their_log(spark):
    raised = spark.createDataFrame([(1, 1, T), (2, 1, T + dt.timedelta(1)), (3, 2, T), (4, 3, T)], "alert int, user_id long, ts timestamp")
    log = spark.createDataFrame([(1, T, 1, "ack"), (2, T, 1, "ack"), (2, T + dt.timedelta(2), 2, "reopen"), (2, T + dt.timedelta(2), 1, "ack")], "user_id long, log_ts timestamp, log_seq long, action string")
    got = {r.alert: r.acknowledged for r in alerts.acknowledged(raised, log, ["user_id"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


# ranges


def test_overlap_join_equals_a_theta_join(spark):
    rng = random.Random(9)
    far = [(0, 10**9), (-(10**6), 10**6), (5, 5), (31, 32), (63, 64)]

    def made(n):
        out = [(rng.choice("ab"), *r) for r in far]
        for _ in range(n):
            low = rng.randrange(-3_000, 30_000)
            out.append((rng.choice("ab"), low, low + int(10 ** rng.uniform(0, 5)) - 1))
        return out + [(None, 0, 9), ("a", None, 3), ("a", 3, None), ("a", 9, 3)]

    a, b = made(120), made(90)
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "i int, k string, x long, y long")
    right = spark.createDataFrame([(j, *r) for j, r in enumerate(b)], "j int, k string, u long, v long")
    out = intervals.overlap_join(left, right, "k", ("x", "y"), ("u", "v"), 32)
    got = [(r.i, r.j) for r in out.collect()]
    fine = lambda r: None not in r and r[1] <= r[2]
    want = {(i, j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if fine(p) and fine(q) and p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2]}
    assert len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    assert out.columns == ["i", "k", "x", "y", "j", "u", "v"]


def test_a_range_over_everything_is_a_few_rows(spark):
    one = spark.createDataFrame([("a", 0, 32 * 1_048_576 - 1)], "k string, x long, y long")
    assert intervals.spread(one, "x", "y", 32, False).count() <= 2
    short = spark.createDataFrame([("a", 7, 8)], "k string, x long, y long")
    assert intervals.spread(short, "x", "y", 32, True).count() == len(intervals.GROWTH) + 1


def brute_gaps(points, low, high):
    out, run = [], []
    for x in range(low, high + 1):
        if x not in points:
            run.append(x)
        elif run:
            out.append((run[0], run[-1]))
            run = []
    return out + ([(run[0], run[-1])] if run else [])


@pytest.mark.parametrize("span", [7, 64, 4096])
def test_gaps_equal_brute_force(spark, span):
    rng = random.Random(span)
    points = {"a": {rng.randrange(0, 300) for _ in range(150)}, "b": {50}, "c": set(), "d": set(range(0, 300))}
    asked = [(k, lo, lo + rng.randrange(0, 120)) for k in points for lo in (-20, 10, 100, 280)]
    stored = spark.createDataFrame([(k, x) for k, xs in points.items() for x in xs] * 2, "k string, at long")
    got = intervals.gaps(stored, spark.createDataFrame(asked, "k string, lo long, hi long"), "k", "at", "lo", "hi", span)
    found = sorted((r.k, r.lo, r.hi, r.gap_low, r.gap_high) for r in got.collect())
    assert found == sorted((k, lo, hi, *g) for k, lo, hi in asked for g in brute_gaps(points[k], lo, hi))


def test_islands_and_chunks(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 10, 11), ("a", 13, 13), ("a", 4, 5), ("b", 1, 1)], "k string, lo long, hi long")
    islands = intervals.merged(r, "k", "lo", "hi")
    assert sorted(map(tuple, islands.collect())) == [("a", 1, 11), ("a", 13, 13), ("b", 1, 1)]
    cut = intervals.chunks(islands, "lo", "hi", 5, 1)
    assert sorted((x.k, x.chunk_low, x.chunk_high) for x in cut.collect()) == [("a", 1, 5), ("a", 5, 10), ("a", 10, 11), ("a", 13, 13), ("b", 1, 1)]


# backfill


def test_a_backfill_completes_the_store_and_reads_only_what_lacks(spark, tmp_path):
    days = range(0, 320)
    source = spark.createDataFrame([(k, x, float(x)) for k in "ab" for x in days], "k string, at long, v double")
    source.withColumn("part", F.floor(F.col("at") / 32)).write.partitionBy("part").parquet(str(tmp_path / "source"))
    table = spark.read.parquet(str(tmp_path / "source"))
    stored = source.where("k = 'a' and not (at between 70 and 90) and at <> 200").withColumn("v", F.lit(-1.0))
    asked = spark.createDataFrame([("a", 64, 127), ("a", 190, 289)], "k string, lo long, hi long")
    covered = {r.lo: (r.n_rows, r.expected) for r in backfill.coverage(stored, asked, "k", "at", "lo", "hi").collect()}
    assert covered == {64: (43, 64), 190: (99, 100)}
    ranges = backfill.missing(stored, asked, "k", "at", "lo", "hi")
    assert [tuple(r) for r in ranges.collect()] == [("a", 70, 90)]  # the second request has 99 % and is left alone
    fetched = backfill.fetch(table, ranges, "k", "at", "part")
    assert sorted(r.at for r in fetched.collect()) == list(range(70, 91))
    node = fetched._jdf.queryExecution().executedPlan()
    scanned = [int(line.split(":")[1]) for line in metrics_of(node) if line.startswith("numOutputRows:")]
    assert max(scanned) <= 2 * 32  # one of ten partitions
    full = backfill.backfill(stored, table.drop("part"), asked, "k", "at", "lo", "hi")
    got = {r.at: r.v for r in full.where("k = 'a'").collect()}
    assert got == {x: (float(x) if 70 <= x <= 90 else -1.0) for x in days if x != 200}
    again = backfill.missing(full, asked, "k", "at", "lo", "hi")
    assert again.count() == 0


def metrics_of(plan):
    """numOutputRows of the scans of an executed plan, whatever wraps it."""
    if "Adaptive" in plan.getClass().getSimpleName():
        yield from metrics_of(plan.executedPlan())
    elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from metrics_of(plan.plan())
    else:
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            yield f"numOutputRows:{plan.metrics().apply('numOutputRows').value()}"
        children = plan.children()
        for i in range(children.size()):
            yield from metrics_of(children.apply(i))


# keyed tables

ROW = "k long, v string, n long"


def put(spark, rows, folder):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def keyed(spark, folder):
    return upserts.KeyedTable(spark, folder, spark.createDataFrame([], ROW).schema, ["k"], ["n"], buckets=4)


def content(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_crash_between_write_and_publication_changes_nothing_and_is_made_good(spark, tmp_path):
    table, source, state = keyed(spark, str(tmp_path / "t")), str(tmp_path / "in"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    put(spark, [(1, "a", 1), (2, "b", 1), (1, "c", 2)], source)
    upserts.upsert_stream(stream(), table, state)
    assert content(table) == [(1, "c", 2), (2, "b", 1)]
    put(spark, [(2, "d", 2), (3, "e", 1)], source)
    publish = table.publish

    def crash(manifest):
        raise OSError("lost")

    table.publish = crash
    with pytest.raises(Exception, match="lost"):
        upserts.upsert_stream(stream(), table, state)
    table.publish = publish
    assert content(table) == [(1, "c", 2), (2, "b", 1)]
    upserts.upsert_stream(stream(), table, state)
    assert content(table) == [(1, "c", 2), (2, "d", 2), (3, "e", 1)]
    assert table.vacuum(keep=1) >= 1 and content(table) == [(1, "c", 2), (2, "d", 2), (3, "e", 1)]


def test_a_replayed_batch_changes_nothing_and_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = keyed(spark, str(tmp_path / "t"))
    table.apply(spark.createDataFrame([(i, "a", 1) for i in range(50)], ROW), 0)
    before = table.manifest()
    table.apply(spark.createDataFrame([(i, "z", 9) for i in range(50)], ROW), 0)
    assert table.manifest() == before and {r.v for r in table.read().collect()} == {"a"}
    table.apply(spark.createDataFrame([(7, "b", 2)], ROW), 1)
    after = table.manifest()
    assert sum(after["buckets"][b] != before["buckets"][b] for b in before["buckets"]) == 1
    table.apply(spark.createDataFrame([], ROW), 2)
    assert table.manifest() == {"batch": 2, "buckets": after["buckets"]}
    assert len(content(table)) == 50 and (7, "b", 2) in content(table)


def test_two_writers_of_one_batch_do_not_both_publish(spark, tmp_path):
    a, b = keyed(spark, str(tmp_path / "t")), keyed(spark, str(tmp_path / "t"))
    a.publish({"batch": 0, "buckets": {}})
    with pytest.raises(OSError, match="another writer"):
        b.publish({"batch": 0, "buckets": {}})
