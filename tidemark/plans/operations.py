"""Plans of alerts, ranges, backfills and upserts: what runs beside the research."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import alerts, backfill, intervals
from tidemark.plans.stream import folder
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table
from tidemark.streaming import flows, upserts

QUERIES, SQL = {}, {}


def plan(name, sql=None, views="trades"):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql)
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


# Alerts

RULES = [
    alerts.Rule("high", "Price above 150", "price > 150", "WARNING", 86_400),
    alerts.Rule("crash", "Price below 0.5", "price < 0.5", "CRITICAL", 3_600),
    alerts.Rule("bulk", "Large buy", "amount > 90 AND side = 'buy'", "INFO", 43_200),
    alerts.Rule("owner", "Watched accounts", "user_id % 7 = 3 AND price > 60", "WARNING", 7_200),
    alerts.Rule("band", "Purchases in a narrow band", "symbol LIKE 'p%' AND price BETWEEN 40 AND 45", "INFO", 600),
]

MATCHED = " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {r.cooldown} AS cooldown, symbol AS key, ts, trade_id AS seq, user_id FROM trades WHERE {r.condition}" for r in RULES)
RAISED = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rule_id, key ORDER BY ts, seq) AS i FROM ({MATCHED})),
    c AS (SELECT *, ts AS last, true AS fires FROM a WHERE i = 1 UNION ALL
      SELECT a.*, CASE WHEN epoch_us(a.ts) - epoch_us(c.last) >= a.cooldown * 1000000::BIGINT THEN a.ts ELSE c.last END, epoch_us(a.ts) - epoch_us(c.last) >= a.cooldown * 1000000::BIGINT FROM c JOIN a ON a.rule_id = c.rule_id AND a.key = c.key AND a.i = c.i + 1),
    raised AS (SELECT rule_id, severity, key, ts, seq, user_id FROM c WHERE fires)"""


def raised(spark, sf):
    return alerts.alerts(alerts.matches(A.trades(spark, sf), RULES, "symbol", "ts", "trade_id", ("user_id",)))


@plan("rule_alerts", f"{RAISED} SELECT rule_id, severity, key, ts, seq FROM raised")
def rule_alerts(spark, sf):
    """Alerts of five rules over all ticks, each rule resting for its cooldown by symbol."""
    return raised(spark, sf).select("rule_id", "severity", "key", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


@plan("stream_rule_alerts", f"{RAISED} SELECT rule_id, severity, key, ts, seq FROM raised")
def stream_rule_alerts(spark, sf):
    """The same alerts from a stream of the ticks."""
    ticks = flows.event_stream(spark, sf).withColumn("amount", F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0)))
    with flows.disk_state(spark):
        out = flows.drain(alerts.alert_stream(alerts.matches(ticks, RULES, "symbol", "ts", "trade_id")), folder(spark))
    return out.select("rule_id", "severity", "key", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


@plan("alert_inbox", f"""{RAISED}, l AS (SELECT user_id, arg_max(symbol, (ts, trade_id)) AS action, max(ts) AS log_ts FROM trades WHERE symbol IN ('error', 'signup') GROUP BY 1)
    SELECT rule_id, severity, count(*) AS n, count(*) FILTER (action = 'error' AND log_ts >= ts) AS acknowledged, count(*) FILTER (NOT coalesce(action = 'error' AND log_ts >= ts, false)) AS open, max(ts) AS newest FROM raised LEFT JOIN l USING (user_id) GROUP BY 1, 2""")
def alert_inbox(spark, sf):
    """Alerts by rule, and how many are open: accounts acknowledge what was raised on their ticks so far (error) or open it again (signup)."""
    t = A.trades(spark, sf)
    action = F.when(F.col("symbol") == "error", "ack").when(F.col("symbol") == "signup", "reopen")
    log = t.select("user_id", F.col("ts").alias("log_ts"), F.col("trade_id").alias("log_seq"), action.alias("action")).where("action is not null")
    x = alerts.acknowledged(raised(spark, sf), log, ["user_id"])
    seen = F.col("acknowledged")
    return x.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("acknowledged"), F.count_if(~seen).alias("open"), F.max("ts").cast("timestamp_ntz").alias("newest"))


# Ranges

CATALOGUE = """files AS (SELECT symbol || '_' || strftime(min(d), '%Y-%m-%d') || '_' || strftime(max(d), '%Y-%m-%d') || '.json' AS file, symbol, min(d) AS a, max(d) AS b FROM bars GROUP BY symbol, date_trunc('quarter', d)),
    asked AS (SELECT o_orderkey AS request, ['AF', 'NF', 'NO', 'RF', 'AO', 'RO'][o_custkey % 6 + 1] AS symbol, CAST(o_orderdate AS DATE) AS x, CAST(o_orderdate AS DATE) + (o_orderkey % 400)::INT AS y FROM orders)"""


def catalogue(names):
    """Files whose names say what they hold, ``SYMBOL_FIRST_LAST.json``: (symbol, low, high, file) in days."""
    part = lambda i: F.unix_date(F.to_date(F.regexp_extract("file", r"^(.+)_(\d{4}-\d\d-\d\d)_(\d{4}-\d\d-\d\d)\.json$", i)))
    symbol = F.regexp_extract("file", r"^(.+)_(\d{4}-\d\d-\d\d)_(\d{4}-\d\d-\d\d)\.json$", 1)
    return names.select(symbol.alias("symbol"), part(2).alias("low"), part(3).alias("high"), "file").where("symbol <> ''")


@plan("catalogue_lookup", f"WITH {CATALOGUE} SELECT request, file, (least(b, y) - greatest(a, x) + 1)::INT AS shared_days FROM asked JOIN files ON files.symbol = asked.symbol AND a <= y AND x <= b", "bars")
def catalogue_lookup(spark, sf):
    """The files that each request needs: ranges in file names against requested ranges."""
    q = A.bars_1d(spark, sf).groupBy("symbol", F.trunc("d", "quarter").alias("q")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    files = catalogue(q.select(F.format_string("%s_%s_%s.json", "symbol", F.date_format("a", "yyyy-MM-dd"), F.date_format("b", "yyyy-MM-dd")).alias("file")))
    o = table(spark, sf, "orders")
    symbol = F.element_at(F.array(*[F.lit(s) for s in ("AF", "NF", "NO", "RF", "AO", "RO")]), (F.col("o_custkey") % 6 + 1).cast("int"))
    first = F.unix_date(F.to_date("o_orderdate"))
    asked = o.select(F.col("o_orderkey").alias("request"), symbol.alias("symbol"), first.alias("x"), (first + (F.col("o_orderkey") % 400).cast("int")).alias("y"))
    j = intervals.overlap_join(asked, files, "symbol", ("x", "y"), ("low", "high"), 32)
    return j.select("request", "file", (F.least("high", "y") - F.greatest("low", "x") + 1).alias("shared_days"))


HELD = """held AS (SELECT trade_id, symbol, amount, epoch_us(ts) // 1000000 AS a, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id, symbol ORDER BY ts, trade_id)) // 1000000, epoch_us(ts) // 1000000 + 86400) AS b FROM trades),
    paid AS (SELECT symbol, (avg(price) - 50) / 100000 AS rate, epoch_us(ts) // 28800000000 * 28800 AS u, epoch_us(ts) // 28800000000 * 28800 + 28799 AS v FROM trades GROUP BY symbol, epoch_us(ts) // 28800000000)"""


@plan("position_funding", f"""WITH {HELD} SELECT trade_id, count(*) AS n_periods, round(sum(1e4 * amount * rate * (least(b, v) - greatest(a, u) + 1) / 28800.0), 6) AS paid_bp FROM held JOIN paid ON held.symbol = paid.symbol AND a <= v AND u <= b GROUP BY 1""")
def position_funding(spark, sf):
    """Funding of every position by the part of each period in which it was held."""
    second = F.floor(F.unix_micros("ts") / 1_000_000)
    after = F.lead(second).over(W.partitionBy("user_id", "symbol").orderBy("ts", "trade_id"))
    held = A.trades(spark, sf).select("trade_id", "symbol", "amount", second.alias("a"), F.coalesce(after, second + 86_400).alias("b"))
    start = F.unix_seconds(F.window("ts", "8 hours").start).alias("u")
    paid = A.trades(spark, sf).groupBy("symbol", start).agg(((F.avg("price") - 50) / 100_000).alias("rate")).withColumn("v", F.col("u") + 28_799)
    j = intervals.overlap_join(held, paid, "symbol", ("a", "b"), ("u", "v"), 28_800)
    part = (F.least("b", "v") - F.greatest("a", "u") + 1) / F.lit(28_800.0)
    return j.groupBy("trade_id").agg(F.count(F.lit(1)).alias("n_periods"), r6(F.sum(10_000 * F.col("amount") * F.col("rate") * part), "paid_bp"))


# Backfills

HOLES = "(month(d) + ascii(symbol)) % 5 = 0 OR date_diff('day', DATE '1992-01-01', d) % 37 = 0"
ASKED = "asked AS (SELECT symbol, y, make_date(y, 1, 1) AS lo, make_date(y, 9, 30) AS hi FROM (SELECT DISTINCT symbol, year(d) AS y FROM bars) UNION ALL SELECT 'new', 1995, DATE '1995-01-01', DATE '1995-03-31')"
STORE = f"""stored AS MATERIALIZED (SELECT symbol, d, close FROM bars WHERE NOT ({HOLES})), {ASKED},
    cov AS (SELECT asked.*, hi - lo + 1 AS expected, (SELECT count(*) FROM stored s WHERE s.symbol = asked.symbol AND s.d BETWEEN lo AND hi) AS n_rows FROM asked),
    days AS MATERIALIZED (SELECT DISTINCT symbol, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM cov WHERE n_rows / expected < 0.95),
    lacking AS MATERIALIZED (SELECT days.* FROM days ANTI JOIN stored ON stored.symbol = days.symbol AND stored.d = days.d)"""


def store_and_requests(spark, sf):
    """Bars with planted holes (months, and single days), and requests for the first nine months of each year."""
    b = A.bars_1d(spark, sf).select("symbol", "d", "close")
    hole = ((F.month("d") + F.ascii("symbol")) % 5 == 0) | (F.date_diff("d", F.lit("1992-01-01").cast("date")) % 37 == 0)
    years = b.select("symbol", F.year("d").alias("y")).distinct()
    edge = lambda m, d: F.unix_date(F.make_date("y", F.lit(m), F.lit(d)))
    asked = years.select("symbol", edge(1, 1).alias("lo"), edge(9, 30).alias("hi"))
    new = spark.range(1).select(F.lit("new").alias("symbol"), F.unix_date(F.lit("1995-01-01").cast("date")).alias("lo"), F.unix_date(F.lit("1995-03-31").cast("date")).alias("hi"))
    day = F.unix_date("d")
    return b.withColumn("at", day), b.where(~hole).withColumn("at", day), asked.union(new)


@plan("backfill_coverage", f"WITH {STORE} SELECT symbol, lo AS low, hi AS high, n_rows, expected, round(n_rows / expected, 6) AS covered FROM cov", "bars")
def backfill_coverage(spark, sf):
    """How much of each requested range is stored."""
    _, stored, asked = store_and_requests(spark, sf)
    c = backfill.coverage(stored, asked, "symbol", "at", "lo", "hi", bucket=64)
    return c.select("symbol", F.date_from_unix_date("lo").alias("low"), F.date_from_unix_date("hi").alias("high"), "n_rows", "expected", r6(F.col("covered"), "covered"))


@plan("backfill_ranges", f"""WITH {STORE}, i AS (SELECT *, d - row_number() OVER (PARTITION BY symbol ORDER BY d)::INT AS island FROM lacking), r AS (SELECT symbol, min(d) AS a, max(d) AS b FROM i GROUP BY symbol, island),
    c AS (SELECT symbol, a, b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 90 DAY))::DATE AS s FROM r) SELECT symbol, greatest(a, s - 1) AS low, least(b, s + 89) AS high FROM c""", "bars")
def backfill_ranges(spark, sf):
    """What is to be fetched: the gaps of requests of little coverage, in chunks of 90 days that overlap by one."""
    _, stored, asked = store_and_requests(spark, sf)
    c = intervals.chunks(backfill.missing(stored, asked, "symbol", "at", "lo", "hi"), "gap_low", "gap_high", 90, 1)
    return c.select("symbol", F.date_from_unix_date("chunk_low").alias("low"), F.date_from_unix_date("chunk_high").alias("high"))


@plan("backfilled_store", f"WITH {STORE} SELECT symbol, d, round(close, 6) AS close FROM stored UNION ALL SELECT symbol, d, round(close, 6) FROM bars JOIN lacking USING (symbol, d)", "bars")
def backfilled_store(spark, sf):
    """The store after the backfill of all requests."""
    source, stored, asked = store_and_requests(spark, sf)
    full = backfill.backfill(stored, source, asked, "symbol", "at", "lo", "hi")
    return full.select("symbol", "d", r6(F.col("close"), "close"))


# Upserts


@plan("stream_upsert", "SELECT user_id, symbol, arg_max(price, (ts, trade_id)) AS price, max(ts) AS ts FROM trades GROUP BY 1, 2")
def stream_upsert(spark, sf):
    """The newest price of every account and symbol, kept by a stream in a keyed table."""
    ticks = flows.event_stream(spark, sf).select("user_id", "symbol", "price", "ts", "trade_id")
    path = folder(spark)
    kept = upserts.KeyedTable(spark, f"{path}/table", ticks.schema, ["user_id", "symbol"], ["ts", "trade_id"])
    upserts.upsert_stream(ticks, kept, f"{path}/state")
    return kept.read().select("user_id", "symbol", "price", F.col("ts").cast("timestamp_ntz").alias("ts"))
