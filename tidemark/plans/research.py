"""Plans of point-in-time joins, fundamentals, event studies, signals and sentiment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import event_study, joins, signals, stats
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None, views: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


def ntz(c="ts"):
    return F.col(c).cast("timestamp_ntz").alias(c)


@plan("asof_mark", """WITH probe AS (SELECT symbol, d FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) AS d FROM bars))
    SELECT p.symbol, p.d, CASE WHEN p.d - b.d <= 7 THEN b.d END AS mark_date, CASE WHEN p.d - b.d <= 7 THEN round(b.close, 6) END AS mark FROM probe p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.d >= b.d""", "bars")
def asof_mark(spark, sf):
    b = A.bars_1d(spark, sf)
    probe = b.select("symbol").distinct().crossJoin(b.select(F.date_trunc("week", "d").cast("date").alias("d")).distinct())
    j = joins.asof_join(probe, b, "symbol", "d", ["close"])
    fresh = F.date_diff("d", "quote_d") <= 7
    return j.select("symbol", "d", F.when(fresh, F.col("quote_d")).alias("mark_date"), F.when(fresh, F.round("close", 6)).alias("mark"))


@plan("asof_strict_metric", """SELECT t.trade_id, t.symbol, f.ts AS rate_ts, f.rate FROM trades t ASOF LEFT JOIN funding f ON t.symbol = f.symbol AND t.ts > f.ts""", "trades funding")
def asof_strict(spark, sf):
    j = joins.asof_join(A.trades(spark, sf).select("trade_id", "symbol", "ts"), A.funding(spark, sf), "symbol", "ts", ["rate"], strict=True)
    return j.select("trade_id", "symbol", F.col("quote_ts").cast("timestamp_ntz").alias("rate_ts"), "rate")


@plan("snap_forward", """WITH f AS (SELECT DISTINCT ticker % 6 AS k, filing_date FROM filings), s AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM bars)),
    e AS (SELECT symbol, filing_date FROM f JOIN s USING (k))
    SELECT e.symbol, e.filing_date, (SELECT min(b.d) FROM bars b WHERE b.symbol = e.symbol AND b.d BETWEEN e.filing_date AND e.filing_date + 4) AS trading_day FROM e""", "bars filings")
def snap_forward(spark, sf):
    b = A.bars_1d(spark, sf)
    e = events_on(spark, sf).select("symbol", "filing_date").distinct()
    j = joins.asof_join(e.withColumnRenamed("filing_date", "d"), b, "symbol", "d", ["close"], direction="forward")
    return j.select("symbol", F.col("d").alias("filing_date"), F.when(F.date_diff("quote_d", "d") <= 4, F.col("quote_d")).alias("trading_day"))


def events_on(spark, sf):
    """Filings spread over the traded symbols."""
    names = A.bars_1d(spark, sf).select("symbol").distinct().withColumn("k", F.dense_rank().over(W.orderBy("symbol")) - 1)
    f = A.filings(spark, sf).withColumn("k", (F.col("ticker") % 6).cast("int"))
    return f.join(names, "k").drop("k")


@plan("pit_fundamentals", """SELECT ticker, report_period, filing_date, round(gross_margin, 6) AS gross_margin FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_period DESC) AS n FROM fundamentals WHERE filing_date <= DATE '1998-06-30') WHERE n <= 4""", "fundamentals")
def pit(spark, sf):
    f = A.fundamentals(spark, sf).where("filing_date <= date'1998-06-30'")
    return joins.latest_per_key(f, ["ticker"], [F.desc("report_period")], 4).select("ticker", "report_period", "filing_date", r6(F.col("gross_margin"), "gross_margin"))


@plan("fundamentals_snapshot", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_period DESC) AS n FROM fundamentals WHERE filing_date <= DATE '1998-06-30')
    SELECT ticker, count(*) AS n_periods, round(avg(gross_margin), 6) AS avg_margin, round(arg_max(gross_margin, report_period) - arg_min(gross_margin, report_period), 6) AS margin_trend,
      round(pow(arg_max(bvps, report_period) / arg_min(bvps, report_period), 4.0 / (count(*) - 1)) - 1, 6) AS bvps_cagr FROM l WHERE n <= 8 GROUP BY 1 HAVING count(*) >= 4""", "fundamentals")
def snapshot(spark, sf):
    f = joins.latest_per_key(A.fundamentals(spark, sf).where("filing_date <= date'1998-06-30'"), ["ticker"], [F.desc("report_period")], 8)
    new, old = (lambda c: F.max_by(c, "report_period")), (lambda c: F.min_by(c, "report_period"))
    g = f.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_periods"), F.avg("gross_margin").alias("a"), (new("gross_margin") - old("gross_margin")).alias("t"), (new("bvps") / old("bvps")).alias("b"))
    return g.where("n_periods >= 4").select("ticker", "n_periods", F.round("a", 6).alias("avg_margin"), r6(F.col("t"), "margin_trend"), r6(F.pow("b", 4.0 / (F.col("n_periods") - 1)) - 1, "bvps_cagr"))


@plan("filing_dedupe_priority", """SELECT ticker, report_period, source_type, filing_date, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, report_period ORDER BY CASE source_type WHEN '8-K' THEN 0 WHEN '10-Q' THEN 1 WHEN '10-K' THEN 2 ELSE 99 END, filing_date, filing_id) AS n FROM filings) WHERE n = 1""", "filings")
def dedupe(spark, sf):
    return best_filing(A.filings(spark, sf)).select("ticker", "report_period", "source_type", "filing_date", "filing_id")


def best_filing(f):
    """One filing for each ticker and period: the source with the highest priority, then the earliest."""
    rank = F.when(F.col("source_type") == "8-K", 0).when(F.col("source_type") == "10-Q", 1).when(F.col("source_type") == "10-K", 2).otherwise(99)
    return joins.latest_per_key(f, ["ticker", "report_period"], [rank, F.col("filing_date"), F.col("filing_id")])


@plan("pead_signal", """WITH q AS (SELECT ticker, filing_date, arg_max(surprise, (report_period, filing_id)) AS surprise FROM filings WHERE surprise IN ('BEAT', 'MISS') AND filing_date - report_period BETWEEN 0 AND 44 GROUP BY 1, 2),
    w AS (SELECT DISTINCT CAST(date_trunc('week', filing_date) AS DATE) AS d FROM filings), p AS (SELECT ticker, d FROM (SELECT DISTINCT ticker FROM filings) CROSS JOIN w)
    SELECT p.ticker, p.d, CASE WHEN p.d - q.filing_date <= 4 THEN CASE surprise WHEN 'BEAT' THEN 1.0 ELSE -1.0 END ELSE 0.0 END::DOUBLE AS conviction FROM p ASOF LEFT JOIN q ON p.ticker = q.ticker AND p.d >= q.filing_date""", "filings")
def pead(spark, sf):
    f = A.filings(spark, sf)
    q = f.where("surprise in ('BEAT', 'MISS') and datediff(filing_date, report_period) between 0 and 44")
    q = q.groupBy("ticker", F.col("filing_date").alias("d")).agg(F.max_by("surprise", F.struct("report_period", "filing_id")).alias("surprise"))
    probe = f.select("ticker").distinct().crossJoin(f.select(F.date_trunc("week", "filing_date").cast("date").alias("d")).distinct())
    j = joins.asof_join(probe, q, "ticker", "d", ["surprise"])
    fresh = F.date_diff("d", "quote_d") <= 4
    return j.select("ticker", "d", F.when(fresh, F.when(F.col("surprise") == "BEAT", 1.0).otherwise(-1.0)).otherwise(0.0).alias("conviction"))


def returns_of(spark, sf):
    return event_study.aligned_returns(A.bars_1d(spark, sf).withColumnRenamed("symbol", "ticker"), A.bench_1d(spark, sf))


def study_frame(spark, sf):
    e = events_on(spark, sf).where("surprise <> 'MEET' and datediff(filing_date, report_period) between 0 and 44")
    return event_study.study(e.select(F.col("symbol").alias("ticker"), F.col("filing_id").alias("event_id"), "source_type", F.col("filing_date").alias("event_date")), returns_of(spark, sf))


EVENTS = """s AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM bars)),
    j AS (SELECT b.symbol, b.d, row_number() OVER w AS i, b.close / lag(b.close) OVER w - 1 AS r, m.close / lag(m.close) OVER w - 1 AS m FROM bars b JOIN bench m USING (d) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.d)),
    e AS (SELECT DISTINCT s.symbol, filing_id, source_type, filing_date FROM filings f JOIN s ON f.ticker % 6 = s.k WHERE surprise <> 'MEET' AND filing_date - report_period BETWEEN 0 AND 44),
    t AS (SELECT e.*, (SELECT min(i) FROM j WHERE j.symbol = e.symbol AND j.d BETWEEN e.filing_date AND e.filing_date + 4) AS i FROM e),
    est AS (SELECT t.symbol, t.filing_id, t.source_type, t.filing_date, count(j.r) AS n_est, regr_slope(j.r, j.m) AS beta, regr_intercept(j.r, j.m) AS alpha FROM t JOIN j ON j.symbol = t.symbol AND j.i BETWEEN t.i - 250 AND t.i - 11 AND j.r IS NOT NULL GROUP BY 1, 2, 3, 4),
    ar AS (SELECT t.symbol, t.filing_id, t.source_type, t.filing_date, j.i - t.i AS k, j.r - est.alpha - est.beta * j.m AS ar, n_est, alpha, beta FROM t JOIN est USING (symbol, filing_id, source_type, filing_date) JOIN j ON j.symbol = t.symbol AND j.i BETWEEN t.i AND t.i + 20 WHERE n_est >= 200),
    car AS (SELECT symbol, filing_id, source_type, filing_date, any_value(n_est) AS n_est, any_value(alpha) AS alpha, any_value(beta) AS beta,
      CASE WHEN count(ar) FILTER (k <= 1) = 2 THEN sum(ar) FILTER (k <= 1) END AS c1, CASE WHEN count(ar) FILTER (k <= 5) = 6 THEN sum(ar) FILTER (k <= 5) END AS c5, CASE WHEN count(ar) = 21 THEN sum(ar) END AS c20 FROM ar GROUP BY 1, 2, 3, 4)"""


@plan("event_study_car", f"WITH {EVENTS} SELECT symbol AS ticker, filing_id AS event_id, source_type, filing_date AS event_date, n_est, round(beta, 3) AS beta, round(c1, 2) AS car_0_1, round(c5, 2) AS car_0_5, round(c20, 2) AS car_0_20 FROM car", "bars bench filings")
def car(spark, sf):
    s = study_frame(spark, sf)
    return s.select("ticker", "event_id", "source_type", "event_date", "n_est", F.round("beta", 3).alias("beta"), *[F.round(c, 2).alias(c) for c in ("car_0_1", "car_0_5", "car_0_20")])


@plan("car_aggregate", f"""WITH {EVENTS}, u AS (SELECT source_type, unnest(['car_0_1', 'car_0_5', 'car_0_20']) AS win, unnest([c1, c5, c20]) AS car FROM car)
    SELECT source_type, win, count(car) AS n, round(avg(car), 4) AS mean, round(stddev_samp(car), 4) AS sd, round(avg(car) / (stddev_samp(car) / sqrt(count(car))), 3) AS t FROM u GROUP BY 1, 2 HAVING count(car) >= 2""", "bars bench filings")
def car_aggregate(spark, sf):
    return unpivoted(spark, sf).groupBy("source_type", "win").agg(F.count("car").alias("n"), F.round(F.avg("car"), 4).alias("mean"), F.round(F.stddev_samp("car"), 4).alias("sd"), F.round(F.avg("car") / (F.stddev_samp("car") / F.sqrt(F.count("car"))), 3).alias("t")).where("n >= 2")


def unpivoted(spark, sf):
    return study_frame(spark, sf).select("source_type", "ticker", "event_id", F.expr("stack(3, 'car_0_1', car_0_1, 'car_0_5', car_0_5, 'car_0_20', car_0_20) as (win, car)"))


@plan("car_t_test", None)
def t_test(spark, sf):
    """One-sample t-test of every source and window, with Student's p-value."""
    g = unpivoted(spark, sf).groupBy("source_type", "win").agg(F.count("car").alias("n"), F.avg("car").alias("mean"), (F.avg("car") / (F.stddev_samp("car") / F.sqrt(F.count("car")))).alias("t")).where("n >= 2")
    return g.withColumn("p", stats.t_p("t", F.col("n") - 1))


@plan("bootstrap_ci", None)
def bootstrap(spark, sf):
    u = unpivoted(spark, sf).withColumn("event", F.concat_ws("|", "ticker", "event_id"))
    return stats.bootstrap_ci(u, ["source_type", "win"], "car", "event")


@plan("avg_cum_ar", f"""WITH {EVENTS}, c AS (SELECT source_type, k, sum(ar) OVER (PARTITION BY symbol, filing_id ORDER BY k) AS v FROM ar)
    SELECT source_type, k AS day, count(*) AS n, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v) / sqrt(count(v)), 0), 4) AS se FROM c GROUP BY 1, 2""", "bars bench filings")
def avg_path(spark, sf):
    s = event_study.paths(study_frame(spark, sf), returns_of(spark, sf))
    run = F.sum(F.coalesce("ar", F.lit(0.0))).over(W.partitionBy("ticker", "event_id").orderBy("day"))
    s = s.select("source_type", F.col("day").cast("long").alias("day"), run.alias("v")).groupBy("source_type", "day")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp("v") / F.sqrt(F.count("v")), F.lit(0.0)), 4).alias("se"))


@plan("car_hist", f"""WITH {EVENTS}, u AS (SELECT source_type, c20 AS car FROM car WHERE c20 IS NOT NULL), w AS (SELECT *, min(car) OVER (PARTITION BY source_type) AS lo, max(car) OVER (PARTITION BY source_type) AS hi FROM u)
    SELECT source_type, least(floor(CASE WHEN hi > lo THEN (car - lo) / (hi - lo) * 20 ELSE 0 END), 19)::BIGINT AS bin, count(*) AS n FROM w GROUP BY 1, 2""", "bars bench filings")
def car_hist(spark, sf):
    """20 equal bins of the longest window's sums for each source."""
    u = unpivoted(spark, sf).where("win = 'car_0_20' and car is not null")
    w = W.partitionBy("source_type")
    x = u.withColumns({"lo": F.min("car").over(w), "hi": F.max("car").over(w)})
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col("car") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 20), F.lit(19)).cast("long")
    return x.groupBy("source_type", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@plan("cum_ret_horizons", """WITH h(k) AS (VALUES (1), (2), (4), (8)), p AS (SELECT trade_id, symbol, ts, price, k, ts + to_hours(k) AS at FROM trades CROSS JOIN h)
    SELECT p.trade_id, p.k AS horizon, round(t.price / nullif(p.price, 0) - 1, 6) AS ret FROM p ASOF LEFT JOIN trades t ON p.symbol = t.symbol AND p.at >= t.ts""", "trades")
def horizons(spark, sf):
    t = A.trades(spark, sf)
    p = t.select("trade_id", "symbol", F.col("price").alias("base"), "ts", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8)])).alias("horizon"))
    p = p.select("trade_id", "symbol", "base", "horizon", (F.col("ts") + F.make_dt_interval(F.lit(0), F.col("horizon"))).alias("ts"))
    j = joins.asof_join(p, t.select("symbol", "ts", "price"), "symbol", "ts", ["price"])
    return j.select("trade_id", "horizon", r6(F.try_divide("price", "base") - 1, "ret"))


@plan("event_window_vol", """WITH e AS (SELECT trade_id, symbol, epoch(ts)::BIGINT AS s FROM trades WHERE price > 150), t AS (SELECT symbol, epoch(ts)::BIGINT AS q, price FROM trades)
    SELECT e.trade_id, count(*) FILTER (q < s) AS n_pre, count(*) FILTER (q > s) AS n_post, round(avg(price) FILTER (q < s), 6) AS pre, round(avg(price) FILTER (q > s), 6) AS post
    FROM e JOIN t ON e.symbol = t.symbol AND q BETWEEN s - 14400 AND s + 14400 GROUP BY 1""", "trades")
def event_windows(spark, sf):
    nearest = F.rint(F.unix_micros("ts") / 1_000_000).cast("long")  # the whole second next to it, as the SQL's cast takes it
    t = A.trades(spark, sf).select("trade_id", "symbol", nearest.alias("q"), "price")
    e = t.where("price > 150").select("trade_id", "symbol", F.col("q").alias("s"), (F.col("q") - 14400).alias("lo"), (F.col("q") + 14400).alias("hi"))
    x = joins.range_join(e, t.select("symbol", "q", "price"), "symbol", "q", "lo", "hi", 14400)
    pre, post = F.when(F.col("q") < F.col("s"), F.col("price")), F.when(F.col("q") > F.col("s"), F.col("price"))
    return x.groupBy("trade_id").agg(F.count(pre).alias("n_pre"), F.count(post).alias("n_post"), r6(F.avg(pre), "pre"), r6(F.avg(post), "post"))


@plan("mann_whitney", """WITH x AS (SELECT symbol, CASE WHEN side = 'buy' THEN 1 ELSE 0 END AS g, price FROM trades),
    r AS (SELECT symbol, g, rank() OVER (PARTITION BY symbol ORDER BY price) + (count(*) OVER (PARTITION BY symbol, price) - 1) / 2.0 AS rk FROM x),
    s AS (SELECT symbol, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, sum(rk) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2 AS u FROM r GROUP BY 1),
    t AS (SELECT symbol, sum(k * k * k - k) AS ties FROM (SELECT symbol, count(*)::DOUBLE AS k FROM x GROUP BY symbol, price) GROUP BY 1)
    SELECT symbol, n1, n0, round(u, 3)::DOUBLE AS u, round((u - n1 * n0 / 2.0 - 0.5) / sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0)))), 6)::DOUBLE AS z FROM s JOIN t USING (symbol)""", "trades")
def rank_sum(spark, sf):
    x = A.trades(spark, sf).select("symbol", (F.col("side") == "buy").cast("int").alias("g"), "price")
    return stats.mann_whitney(x, ["symbol"], "g", "price").select("symbol", "n1", "n0", F.round("u", 3).alias("u"), r6(F.col("z"), "z"))


@plan("prob_velocity", """WITH m AS (SELECT token_id, max(ts) AS t FROM prob GROUP BY 1), v AS (SELECT token_id, avg(p) FILTER (ts > t - INTERVAL 1 HOUR) AS now, avg(p) FILTER (ts > t - INTERVAL 24 HOUR AND ts <= t - INTERVAL 1 HOUR) AS old FROM prob JOIN m USING (token_id) GROUP BY 1)
    SELECT token_id, round(now, 6) AS p, round(now - coalesce(old, now), 6) AS velocity FROM v""", "prob")
def velocity(spark, sf):
    return velocities(A.prob_ticks(spark, sf)).select("token_id", r6(F.col("now"), "p"), r6(F.col("v"), "velocity"))


def velocities(ticks):
    """Mean of the last hour and its change against the 23 hours before, in one pass."""
    x = ticks.withColumn("t", F.max("ts").over(W.partitionBy("token_id")))
    age = F.unix_micros("t") - F.unix_micros("ts")
    hour = 3_600_000_000
    g = x.groupBy("token_id").agg(F.avg(F.when(age < hour, F.col("p"))).alias("now"), F.avg(F.when((age >= hour) & (age < 24 * hour), F.col("p"))).alias("old"))
    return g.select("token_id", "now", (F.col("now") - F.coalesce("old", "now")).alias("v"))


KEYWORDS = ("the", "und", "les", "los")


@plan("risk_markets_semi", """SELECT doc_id AS token_id, lang FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'und') OR contains(lower(text), 'les') OR contains(lower(text), 'los')) AND doc_id IN (SELECT token_id FROM prob GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-29')""", "prob")
def risk_markets(spark, sf):
    live = A.prob_ticks(spark, sf).groupBy("token_id").agg(F.max("ts").alias("t")).where("t >= timestamp'2024-01-29'")
    q = F.lower("text")
    hit = q.contains(KEYWORDS[0]) | q.contains(KEYWORDS[1]) | q.contains(KEYWORDS[2]) | q.contains(KEYWORDS[3])
    d = table(spark, sf, "documents").where(hit).select(F.col("doc_id").alias("token_id"), "lang")
    return d.join(live, "token_id", "left_semi")


TIER = """WITH m AS (SELECT token_id, max(ts) AS t FROM prob GROUP BY 1), v AS (SELECT token_id, avg(p) FILTER (ts > t - INTERVAL 1 HOUR) AS now, avg(p) FILTER (ts > t - INTERVAL 24 HOUR AND ts <= t - INTERVAL 1 HOUR) AS old FROM prob JOIN m USING (token_id) GROUP BY 1),
    s AS (SELECT token_id % 5 AS grp, now, now - coalesce(old, now) AS v, CASE WHEN now >= 0.85 THEN 1.0 WHEN now >= 0.7 THEN 0.7 WHEN now <= 0.15 THEN -0.3 ELSE 0 END AS score, CASE WHEN now >= 0.85 THEN 80 WHEN now >= 0.7 THEN 55 WHEN now <= 0.15 THEN 25 ELSE 0 END AS conf FROM v),
    b AS (SELECT grp, CASE WHEN v >= 0.1 AND now > 0.5 THEN least(score + 0.2, 1) ELSE score END AS score, CASE WHEN v >= 0.1 AND now > 0.5 THEN least(conf + 15, 90) ELSE conf END AS conf FROM s)"""


@plan("risk_signal", TIER + """ SELECT grp, count(*) AS n, CASE WHEN sum(score) <= 0 THEN 'neutral' WHEN avg(score) >= 0.25 THEN 'bearish' ELSE 'neutral' END AS signal, CASE WHEN sum(score) <= 0 THEN 'low' WHEN avg(score) >= 0.6 THEN 'high' WHEN avg(score) >= 0.25 THEN 'moderate' ELSE 'low' END AS level, CASE WHEN sum(score) <= 0 THEN 0 ELSE max(conf) END AS confidence FROM b GROUP BY 1""", "prob")
def risk_signal(spark, sf):
    v = velocities(A.prob_ticks(spark, sf)).withColumn("grp", F.col("token_id") % 5)
    p = F.col("now")
    score = F.when(p >= 0.85, 1.0).when(p >= 0.7, 0.7).when(p <= 0.15, -0.3).otherwise(0.0)
    conf = F.when(p >= 0.85, 80).when(p >= 0.7, 55).when(p <= 0.15, 25).otherwise(0)
    boost = (F.col("v") >= 0.1) & (p > 0.5)
    x = v.select("grp", F.when(boost, F.least(score + 0.2, F.lit(1.0))).otherwise(score).alias("score"), F.when(boost, F.least(conf + 15, F.lit(90))).otherwise(conf).alias("conf"))
    g = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.avg("score").alias("a"), F.max("conf").alias("c"))
    calm = F.col("s") <= 0
    level = F.when(calm, "low").when(F.col("a") >= 0.6, "high").when(F.col("a") >= 0.25, "moderate").otherwise("low")
    return g.select("grp", "n", F.when(~calm & (F.col("a") >= 0.25), "bearish").otherwise("neutral").alias("signal"), level.alias("level"), F.when(calm, 0).otherwise(F.col("c")).alias("confidence"))


UP, DOWN = ("the", "de", "der"), ("of", "la", "die")
LEX = """x AS (SELECT doc_id, source, len(list_intersect(w, ['the', 'de', 'der'])) AS u, len(list_intersect(w, ['of', 'la', 'die'])) AS v FROM (SELECT doc_id, source, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents)),
    l AS (SELECT doc_id, source, CASE WHEN u > v THEN 'bullish' WHEN u < v THEN 'bearish' ELSE 'neutral' END AS label, CASE WHEN u = v THEN 0.5 ELSE least(0.5 + 0.1 * abs(u - v), 0.9) END::DOUBLE AS confidence FROM x)"""


@plan("lexicon_sentiment", f"WITH {LEX} SELECT doc_id, label, round(confidence, 6) AS confidence FROM l")
def lexicon(spark, sf):
    return signals.lexicon_sentiment(table(spark, sf, "documents").select("doc_id", "text"), "text", UP, DOWN).select("doc_id", "label", r6(F.col("confidence"), "confidence"))


@plan("sentiment_aggregate", f"""WITH {LEX} SELECT source, round(sum(CASE label WHEN 'bullish' THEN confidence WHEN 'bearish' THEN -confidence ELSE 0 END) / sum(confidence), 6) AS score, count(*) FILTER (label = 'bullish') AS n_bullish, count(*) FILTER (label = 'bearish') AS n_bearish, count(*) FILTER (label = 'neutral') AS n_neutral,
    round(greatest(count(*) FILTER (label = 'bullish'), count(*) FILTER (label = 'bearish'), count(*) FILTER (label = 'neutral')) / count(*), 6) AS consensus FROM l GROUP BY 1""")
def sentiment(spark, sf):
    s = signals.lexicon_sentiment(table(spark, sf, "documents").select("doc_id", "source", "text"), "text", UP, DOWN)
    return signals.aggregate_sentiment(s, ["source"]).select("source", r6(F.col("score"), "score"), "n_bullish", "n_bearish", "n_neutral", r6(F.col("consensus"), "consensus"))


@plan("content_hash", "SELECT event_id, substr(sha256(event_type || '|' || user_id || '|' || props), 1, 24) AS h FROM events")
def content_hash(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.substring(F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), "props"), 256), 1, 24).alias("h"))


@plan("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@plan("universe_normalise", "SELECT upper(trim(c_mktsegment)) AS symbol, min(c_custkey) AS ordinal FROM customer GROUP BY 1")
def universe(spark, sf):
    return table(spark, sf, "customer").groupBy(F.upper(F.trim("c_mktsegment")).alias("symbol")).agg(F.min("c_custkey").alias("ordinal"))
