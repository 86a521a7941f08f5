"""Plans of store reads and writes, generators, order books and calendars of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import costs
from tidemark.plans import books, stream
from tidemark.plans.stream import folder
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def plan(name: str, sql: str, views: str = ""):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


# Reads


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet all bounds given: ``column=value``, ``column_from=low`` and ``column_to=high`` (closed); None is no bound."""
    for name, value in wanted.items():
        if value is not None:
            low, high = name.endswith("_from"), name.endswith("_to")
            c = F.col(name.removesuffix("_from").removesuffix("_to"))
            df = df.where(c >= value if low else c <= value if high else c == value)
    return df


@plan("ticks_optional", "SELECT trade_id, symbol, price FROM trades WHERE side = 'buy' AND price >= 20 AND price <= 120", "trades")
def ticks_optional(spark, sf):
    """Ticks by whatever bounds a request names."""
    return optional(A.trades(spark, sf), symbol=None, side="buy", price_from=20.0, price_to=120.0).select("trade_id", "symbol", "price")


@plan("news_range", "SELECT trade_id, symbol, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id) AS n FROM trades WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12') WHERE n <= 20", "trades")
def news_range(spark, sf):
    """The newest 20 items of each symbol within a half-open range."""
    t = A.trades(spark, sf).where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-12'")
    n = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"), "trade_id"))
    return t.withColumn("n", n).where("n <= 20").select("trade_id", "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"))


@plan("supplier_lookup", "SELECT s_suppkey AS ticker, s_name AS name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def supplier_lookup(spark, sf):
    """A ticker's facts from the dimension tables; what is missing stays null."""
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return x.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@plan("markets_by_last_seen", "SELECT user_id AS token_id, max(ts) AS last_seen, count(*) AS n FROM trades GROUP BY 1 ORDER BY last_seen DESC, token_id LIMIT 50", "trades")
def markets_by_last_seen(spark, sf):
    """The 50 markets that were seen last."""
    g = A.trades(spark, sf).groupBy(F.col("user_id").alias("token_id")).agg(F.max("ts").cast("timestamp_ntz").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("last_seen"), "token_id").limit(50)


@plan("history_chunks", "SELECT symbol, d, round(close, 6) AS close, CASE WHEN d > first AND (d - first) % 15 = 0 THEN 2 ELSE 1 END AS n_chunks FROM bars JOIN (SELECT symbol, min(d) AS first FROM bars GROUP BY 1) USING (symbol)", "bars")
def history_chunks(spark, sf):
    """History fetched in chunks of 15 days whose edges overlap, stitched together: each day once, and how many chunks had it."""
    b = A.bars_1d(spark, sf).withColumn("age", F.date_diff("d", F.min("d").over(W.partitionBy("symbol"))))
    age = F.col("age")
    own = F.floor(age / 15)
    chunks = F.when((age > 0) & (age % 15 == 0), F.array(own - 1, own)).otherwise(F.array(own))
    fetched = b.select("symbol", "d", "close", F.explode(chunks).alias("chunk"))
    return fetched.groupBy("symbol", "d").agg(r6(F.max_by("close", "chunk"), "close"), F.count_distinct("chunk").cast("int").alias("n_chunks"))


@plan("backfill_chunks", """WITH m AS (SELECT symbol, min(d) AS a, max(d) AS b FROM bars GROUP BY 1), s AS (SELECT symbol, b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 90 DAY))::DATE AS first FROM m)
    SELECT symbol, first, least(first + 89, b) AS last FROM s""", "bars")
def backfill_chunks(spark, sf):
    """The ranges of at most 90 days in which a store is filled."""
    m = A.bars_1d(spark, sf).groupBy("symbol").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    s = m.select("symbol", "b", F.explode(F.sequence("a", "b", F.expr("interval 90 days"))).alias("first"))
    return s.select("symbol", "first", F.least(F.date_add("first", 89), F.col("b")).alias("last"))


# Generators


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from md5 of the parts, the same in any SQL engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double")
    return (h + 1) / 4294967297.0


def gbm(days: DataFrame, names: list[str], start: float, drift: float, vol: float) -> DataFrame:
    """Geometric Brownian paths over the days, seeded by name and day (Box-Muller), with bars around the close."""
    x = days.select("d", F.explode(F.array(*[F.lit(n) for n in names])).alias("symbol"))
    u, v = uniform(F.lit("u"), F.col("symbol"), F.col("d")), uniform(F.lit("v"), F.col("symbol"), F.col("d"))
    z = F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.lit(3.141592653589793) * v)
    x = x.withColumn("step", (drift - vol * vol / 2) + vol * z)
    w = W.partitionBy("symbol").orderBy("d")
    x = x.withColumn("close", start * F.exp(F.sum("step").over(w)))
    x = x.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(start)))
    return x.select("symbol", "d", "open", (F.greatest("open", "close") * (1 + vol / 4)).alias("high"), (F.least("open", "close") * (1 - vol / 4)).alias("low"), "close")


@plan("synthetic_bars", """WITH x AS (SELECT d, s AS symbol, (('0x' || substr(md5('u|' || s || '|' || d), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u, (('0x' || substr(md5('v|' || s || '|' || d), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS v FROM bench CROSS JOIN (VALUES ('SYN1'), ('SYN2')) t(s)),
    c AS (SELECT symbol, d, 100.0::DOUBLE * exp(sum((0.0003 - 0.0001 / 2)::DOUBLE + 0.01::DOUBLE * sqrt(-2 * ln(u)) * cos(2 * 3.141592653589793::DOUBLE * v)) OVER (PARTITION BY symbol ORDER BY d)) AS close FROM x),
    o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY d), 100.0) AS open FROM c)
    SELECT symbol, d, round(open, 6) AS open, round(greatest(open, close) * 1.0025, 6) AS high, round(least(open, close) * 0.9975, 6) AS low, round(close, 6) AS close FROM o""", "bench")
def synthetic_bars(spark, sf):
    """Two generated series on the trading days of the benchmark."""
    g = gbm(A.bench_1d(spark, sf).select("d"), ["SYN1", "SYN2"], 100.0, 0.0003, 0.01)
    return g.select("symbol", "d", *[r6(F.col(c), c) for c in ("open", "high", "low", "close")])


def numbered_days(bars: DataFrame) -> DataFrame:
    """Days with their number ``i`` from 0; they are numbered by month, so that no window holds all."""
    b = bars.select("d", F.trunc("d", "month").alias("m"))
    per = b.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    i = F.col("before") + F.row_number().over(W.partitionBy("m").orderBy("d")) - 1
    return b.join(per.select("m", before.alias("before")), "m").withColumn("i", i)


@plan("synthetic_news", "SELECT d, 'SYN' AS symbol, 'Report ' || d AS title FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM bench) WHERE i % 3 = 0", "bench")
def synthetic_news(spark, sf):
    """A headline on every third trading day."""
    x = numbered_days(A.bench_1d(spark, sf)).where("i % 3 = 0")
    return x.select("d", F.lit("SYN").alias("symbol"), F.concat(F.lit("Report "), F.col("d").cast("string")).alias("title"))


@plan("synthetic_insiders", """WITH b AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM bench), x AS (SELECT d, (('0x' || substr(md5('u|insider|' || d), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u, i FROM b WHERE i % 15 = 0)
    SELECT d AS filing_date, d - 2 AS transaction_date, CASE WHEN u > 0.5 THEN 'A' ELSE 'D' END AS code, (floor(u * 10000) + 100)::BIGINT AS shares FROM x""", "bench")
def synthetic_insiders(spark, sf):
    """An insider trade on every fifteenth trading day, filed two days later: acquired or disposed, and how many shares, by hash of the day."""
    x = numbered_days(A.bench_1d(spark, sf)).where("i % 15 = 0").withColumn("u", uniform(F.lit("u"), F.lit("insider"), F.col("d")))
    return x.select(F.col("d").alias("filing_date"), F.date_sub("d", 2).alias("transaction_date"), F.when(F.col("u") > 0.5, "A").otherwise("D").alias("code"), (F.floor(F.col("u") * 10_000) + 100).cast("long").alias("shares"))


@plan("synthetic_fundamentals", """WITH q AS (SELECT DISTINCT date_trunc('quarter', d)::DATE AS report_period FROM bench), x AS (SELECT report_period, (('0x' || substr(md5('u|margin|' || report_period), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS u, row_number() OVER (ORDER BY report_period) - 1 AS i FROM q)
    SELECT report_period, report_period + 135 AS filing_date, round(0.3 + 0.2 * u, 6) AS gross_margin, round(8 * pow(1.02, i), 6) AS bvps FROM x""", "bench")
def synthetic_fundamentals(spark, sf):
    """Quarterly figures for every quarter of the benchmark, known 45 days after it ends: a margin by hash and a growing book value."""
    q = A.bench_1d(spark, sf).select(F.trunc("d", "quarter").alias("report_period")).distinct()
    u = uniform(F.lit("u"), F.lit("margin"), F.col("report_period"))
    x = q.withColumn("i", F.row_number().over(W.orderBy("report_period")) - 1)
    return x.select("report_period", F.date_add("report_period", 135).alias("filing_date"), r6(0.3 + 0.2 * u, "gross_margin"), r6(8 * F.pow(F.lit(1.02), F.col("i")), "bvps"))


# Sinks


@plan("results_without_failures", f"{books.GRID_RUN} SELECT symbol, fast, slow, total_return FROM o WHERE error IS NULL", "bars")
def results_without_failures(spark, sf):
    """Optimisation results as they are stored: failed parameter sets are left out."""
    path = folder(spark)
    books.grid(spark, sf).where("error is null").write.partitionBy("symbol").json(path)
    return spark.read.schema("symbol string, fast int, slow int, total_return double").json(path).select("symbol", "fast", "slow", "total_return")


@plan("cycle_receipts", f"{books.FUND} SELECT d, round(equity, 2) AS equity, n AS n_orders FROM f WHERE i > 0 AND n > 0", "views bench")
def cycle_receipts(spark, sf):
    """One JSON receipt for each cycle that traded, written and read back."""
    path = folder(spark)
    body = F.to_json(F.struct("d", F.round("equity", 2).alias("equity"), F.col("n_orders").alias("orders")))
    books.valued(spark, sf).where("n_orders > 0").select(body.alias("value")).write.text(path)
    r = F.from_json("value", "d date, equity double, orders long")
    return spark.read.text(path).select(r.alias("r")).select("r.d", "r.equity", F.col("r.orders").alias("n_orders"))


# Books and orders


@plan("mid_prices", """SELECT symbol, date_trunc('hour', ts) AS h, round((max(price) FILTER (side = 'buy') + min(price) FILTER (side = 'sell')) / 2, 6) AS mid, round(min(price) FILTER (side = 'sell') - max(price) FILTER (side = 'buy'), 6) AS spread FROM trades GROUP BY 1, 2""", "trades")
def mid_prices(spark, sf):
    """Middle and distance of the best bid and ask of each hour; null where a side is empty."""
    bid, ask = F.max(F.when(F.col("side") == "buy", F.col("price"))), F.min(F.when(F.col("side") == "sell", F.col("price")))
    return A.trades(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(r6((bid + ask) / 2, "mid"), r6(ask - bid, "spread"))


@plan("open_after_cancel", f"{stream.ORDER_STATES} SELECT order_id, account, opened, side, qty - filled AS remaining FROM orders_now WHERE status IN ('submitting', 'not_traded', 'part_traded')", "order_log")
def open_after_cancel(spark, sf):
    """Recorded orders that are still active after all fills, cancellations and expiries, and what remains of them."""
    o = stream.order_states_now(spark, sf).where("status in ('submitting', 'not_traded', 'part_traded')")
    return o.select("order_id", "account", "opened", "side", (F.col("qty") - F.col("filled")).alias("remaining"))


@plan("portfolio_value", """WITH now AS (SELECT max(ts) AS t FROM trades), p AS (SELECT symbol, sum(amount) FILTER (side = 'buy') AS q, sum(price * amount) FILTER (side = 'buy') / nullif(sum(amount) FILTER (side = 'buy'), 0) AS entry, arg_max(price, (ts, trade_id)) FILTER (ts >= t - INTERVAL 20 MINUTE) AS mark FROM trades, now GROUP BY 1)
    SELECT round(1000000 + sum(q * coalesce(mark, entry)), 2) AS value, count(*) FILTER (mark IS NULL) AS n_at_entry FROM p""", "trades")
def portfolio_value(spark, sf):
    """Cash and positions at their last price of the last 20 minutes, or at what they cost where there is none so fresh."""
    t = A.trades(spark, sf)
    now = t.agg(F.max("ts").alias("now"))
    buy = F.col("side") == "buy"
    k = F.when(F.col("ts") >= F.col("now") - F.expr("interval 20 minutes"), F.struct("ts", "trade_id"))
    p = t.join(now, F.col("ts") <= F.col("now")).groupBy("symbol").agg(F.sum(F.when(buy, F.col("amount"))).alias("q"), F.sum(F.when(buy, F.col("price") * F.col("amount"))).alias("v"), F.max_by(F.when(k.isNotNull(), F.col("price")), k).alias("mark"))
    entry = F.try_divide("v", "q")
    return p.agg(F.round(1_000_000 + F.sum(F.col("q") * F.coalesce("mark", entry)), 2).alias("value"), F.sum(F.col("mark").isNull().cast("long")).alias("n_at_entry"))


@plan("run_history", """SELECT date_trunc('month', o_orderdate)::DATE AS run, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 ORDER BY run DESC LIMIT 24""")
def run_history(spark, sf):
    """Summaries of the newest 24 runs, newest first."""
    g = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("run"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy(F.desc("run")).limit(24)


@plan("model_roster", """WITH m AS (SELECT strategy, model, min(d) AS since, bool_and(model = 'drift') AS human FROM views GROUP BY 1, 2)
    SELECT strategy, model, row_number() OVER (PARTITION BY strategy ORDER BY since, model) AS place, CASE WHEN bool_and(human) OVER (PARTITION BY strategy) THEN 'discretionary' ELSE 'systematic' END AS kind FROM m""", "views")
def model_roster(spark, sf):
    """Each strategy's models in the order in which they first appear, and the kind that follows from them."""
    m = A.model_views(spark, sf).groupBy("strategy", "model").agg(F.min("d").alias("since"), F.min(F.col("model") == "drift").alias("human"))
    every = F.min("human").over(W.partitionBy("strategy"))
    place = F.row_number().over(W.partitionBy("strategy").orderBy("since", "model"))
    return m.select("strategy", "model", place.alias("place"), F.when(every, "discretionary").otherwise("systematic").alias("kind"))


@plan("log_prices", r"""WITH l AS (SELECT o_custkey, o_orderdate, o_orderkey, 'order ' || o_orderkey || ' filled at $' || o_totalprice || ' depth ' || (o_orderkey % 50) AS line FROM orders)
    SELECT o_custkey, arg_max(CAST(regexp_extract(line, '\$([0-9.]+)', 1) AS DOUBLE), (o_orderdate, o_orderkey)) AS last_price, arg_max(CAST(regexp_extract(line, 'depth ([0-9]+)', 1) AS INT), (o_orderdate, o_orderkey)) AS last_depth, count(*) AS n FROM l GROUP BY 1""")
def log_prices(spark, sf):
    """The last price and depth that the lines of a log name."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" filled at $"), F.col("o_totalprice").cast("string"), F.lit(" depth "), (F.col("o_orderkey") % 50).cast("string"))
    k = F.struct("o_orderdate", "o_orderkey")
    l = o.select("o_custkey", "o_orderdate", "o_orderkey", line.alias("line"))
    return l.groupBy("o_custkey").agg(F.max_by(F.regexp_extract("line", r"\$([0-9.]+)", 1).cast("double"), k).alias("last_price"), F.max_by(F.regexp_extract("line", r"depth ([0-9]+)", 1).cast("int"), k).alias("last_depth"), F.count(F.lit(1)).alias("n"))


@plan("cash_flows", """WITH t AS (SELECT symbol, sum(price * amount) * 0.0004 AS fees, sum(CASE WHEN side = 'buy' THEN amount ELSE -amount END) AS net FROM trades GROUP BY 1), f AS (SELECT symbol, sum(rate) AS rate FROM funding GROUP BY 1)
    SELECT symbol, round(fees, 4) AS fees, round(net * rate, 6) AS funding, round(-fees - net * rate, 4) AS cash FROM t JOIN f USING (symbol)""", "trades funding")
def cash_flows(spark, sf):
    """What fees and funding took from the cash of each symbol's book."""
    v = F.col("price") * F.col("amount")
    t = A.trades(spark, sf).groupBy("symbol").agg(F.sum(costs.fee(v, F.lit("perp"), 1, False)).alias("fees"), F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    x = t.join(A.funding(spark, sf).groupBy("symbol").agg(F.sum("rate").alias("rate")), "symbol")
    due = F.col("net") * F.col("rate")
    return x.select("symbol", F.round("fees", 4).alias("fees"), r6(due, "funding"), F.round(-F.col("fees") - due, 4).alias("cash"))


@plan("hour_flow", """WITH h AS (SELECT symbol, date_trunc('hour', ts) AS h, sum(amount) AS volume, count(*) AS n, sum(amount) FILTER (side = 'buy') / nullif(sum(amount), 0) AS taker, sum(amount) / count(*) AS size FROM trades GROUP BY 1, 2),
    z AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN (volume - avg(volume) OVER w) / (stddev_samp(volume) OVER w + 1e-9) END AS vz, CASE WHEN count(*) OVER w >= 10 THEN (n - avg(n) OVER w) / (stddev_samp(n) OVER w + 1e-9) END AS nz FROM h WINDOW w AS (PARTITION BY symbol ORDER BY h ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT symbol, h, round(vz, 5) AS volume_z, round(nz, 5) AS trades_z, round(coalesce(taker, 0), 6) AS taker_ratio, round(size, 6) AS avg_size, coalesce(nz > 1 AND size < 30, false) AS iceberg FROM z""", "trades")
def hour_flow(spark, sf):
    """Unusual volume and numbers of trades, the share of buyers, and many small trades at once."""
    g = A.trades(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"))
    h = g.agg(F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(0.0)).alias("bought"))
    w = X.series("symbol", "h")
    h = h.withColumns({"vz": X.z_score(F.col("volume"), w, 60, 10), "nz": X.z_score(F.col("n"), w, 60, 10), "size": F.col("volume") / F.col("n")})
    return h.select("symbol", "h", F.round("vz", 5).alias("volume_z"), F.round("nz", 5).alias("trades_z"), r6(F.coalesce(F.try_divide("bought", "volume"), F.lit(0.0)), "taker_ratio"), r6(F.col("size"), "avg_size"), F.coalesce((F.col("nz") > 1) & (F.col("size") < 30), F.lit(False)).alias("iceberg"))


@plan("filing_map", "SELECT ticker, count(*) FILTER (source_type = '8-K') AS n_8k, count(*) FILTER (source_type = '10-Q') AS n_10q, count(*) FILTER (source_type = '10-K') AS n_10k FROM filings GROUP BY 1", "filings")
def filing_map(spark, sf):
    """Counts by source as a map of each ticker, and what the map holds."""
    n = A.filings(spark, sf).groupBy("ticker", "source_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("source_type", "n"))).alias("m"))
    return m.select("ticker", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"n_{c}") for k, c in (("8-K", "8k"), ("10-Q", "10q"), ("10-K", "10k"))])
