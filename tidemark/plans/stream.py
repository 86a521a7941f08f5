"""Plans that replay stored events through Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.streaming import flows, late, orders

QUERIES, SQL = {}, {}


def folder(spark) -> str:
    """A new folder in the shared checkpoint folder; a session within this process gets one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def plan(name, sql=None, views="trades"):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql)
        return fn

    return add


@plan("stream_ohlc", """SELECT symbol, date_trunc('hour', ts) AS h, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, count(*) AS n FROM trades
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM trades) GROUP BY 1, 2""")
def stream_ohlc(spark, sf):
    """Hourly bars that the watermark has closed."""
    return flows.drain(flows.ohlc(flows.event_stream(spark, sf)), folder(spark)).withColumn("h", F.col("h").cast("timestamp_ntz"))


@plan("stream_throttle", """WITH RECURSIVE a AS MATERIALIZED (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, price) AS i FROM trades),
    c AS (SELECT symbol, ts, price, i, ts AS last, true AS fires FROM a WHERE i = 1 UNION ALL
      SELECT a.symbol, a.ts, a.price, a.i, CASE WHEN a.ts - c.last >= INTERVAL 1 HOUR THEN a.ts ELSE c.last END, a.ts - c.last >= INTERVAL 1 HOUR FROM c JOIN a ON a.symbol = c.symbol AND a.i = c.i + 1)
    SELECT symbol, ts, price FROM c WHERE fires""")
def stream_throttle(spark, sf):
    """Snapshots at least an hour apart for each symbol."""
    with flows.disk_state(spark):
        kept = flows.drain(flows.throttle(flows.event_stream(spark, sf), 3600), folder(spark))
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("stream_sessions", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM trades WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM trades)""")
def stream_sessions(spark, sf):
    """Sessions of users that the watermark has closed."""
    s = flows.drain(flows.sessions(flows.event_stream(spark, sf)), folder(spark))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@plan("stream_first_trades", "SELECT trade_id, symbol, price FROM trades")
def stream_first_trades(spark, sf):
    """Each trade once, from a stream that delivers every one twice."""
    t = flows.event_stream(spark, sf)
    return flows.drain(flows.first_trades(t.union(t)).select("trade_id", "symbol", "price"), folder(spark))


# Recorded orders

#: Seconds that an order lives.
ORDER_LIFE = 2 * 86_400

ORDER_STATES = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, seq) AS i FROM order_log),
    ends AS (SELECT account, greatest(max(ts), (SELECT max(ts) - INTERVAL 10 MINUTE FROM order_log)) AS seen FROM order_log GROUP BY 1),
    s AS (SELECT DISTINCT order_id, account, 0::BIGINT AS i, NULL::BIGINT AS opened, 'none' AS status, NULL::VARCHAR AS side, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS filled, 0.0::DOUBLE AS notional, NULL::TIMESTAMP AS expires, false AS expired, 'none' AS effect FROM n
      UNION ALL SELECT order_id, account, i, CASE WHEN opens THEN seq ELSE opened END,
        CASE WHEN opens THEN 'submitting' WHEN NOT active THEN was WHEN kind = 'accept' AND was = 'submitting' THEN 'not_traded' WHEN kind = 'fill' THEN CASE WHEN filled + part >= qty THEN 'all_traded' ELSE 'part_traded' END WHEN kind = 'cancel' THEN 'cancelled' ELSE was END,
        CASE WHEN opens THEN new_side ELSE side END, CASE WHEN opens THEN new_qty ELSE qty END, CASE WHEN opens THEN 0 WHEN active AND kind = 'fill' THEN filled + part ELSE filled END, CASE WHEN opens THEN 0 WHEN active AND kind = 'fill' THEN notional + part * price ELSE notional END,
        CASE WHEN opens THEN ts + INTERVAL {ORDER_LIFE} SECOND ELSE expires END, NOT opens AND late, CASE WHEN opens THEN 'opened' WHEN active AND (kind IN ('fill', 'cancel') OR kind = 'accept' AND was = 'submitting') THEN kind ELSE 'ignored' END
      FROM (SELECT *, kind = 'submit' AND NOT active AS opens, least(new_qty, qty - filled) AS part
      FROM (SELECT *, CASE WHEN late AND was_active THEN 'cancelled' ELSE status END AS was, was_active AND NOT late AS active
      FROM (SELECT s.order_id, s.account, n.i, n.seq, n.ts, n.kind, n.side AS new_side, n.qty AS new_qty, n.price, s.opened, s.status, s.side, s.qty, s.filled, s.notional, s.expires,
          s.status IN ('submitting', 'not_traded', 'part_traded') AS was_active, s.expired OR s.status IN ('submitting', 'not_traded', 'part_traded') AND s.expires <= n.ts AS late
        FROM s JOIN n ON n.order_id = s.order_id AND n.i = s.i + 1)))),
    l AS (SELECT s.account, order_id, opened, arg_max(status, i) AS status, arg_max(side, i) AS side, arg_max(qty, i) AS qty, arg_max(filled, i) AS filled, arg_max(notional, i) AS notional, arg_max(expires, i) AS expires, bool_or(expired) AS expired, count(*) FILTER (effect <> 'ignored') AS n FROM s WHERE opened IS NOT NULL GROUP BY 1, 2, 3),
    e AS (SELECT l.*, l.status IN ('submitting', 'not_traded', 'part_traded') AND expires <= seen AS ends_late FROM l JOIN ends USING (account)),
    orders_now AS (SELECT account, order_id, opened, CASE WHEN ends_late OR expired THEN 'cancelled' ELSE status END AS status, side, qty, filled, round(notional / nullif(filled, 0), 6) AS avg_price, expired OR ends_late AS expired, n + CASE WHEN expired OR ends_late THEN 1 ELSE 0 END AS n_changes FROM e)"""


def order_states_now(spark, sf):
    """Every order of the recorded log as the stream leaves it."""
    with flows.disk_state(spark):
        changes = flows.drain(orders.order_changes(A.order_log(flows.stored(spark, sf)), ORDER_LIFE), folder(spark))
    return orders.last_states(changes)


@plan("order_states", f"{ORDER_STATES} SELECT * FROM orders_now", "order_log")
def order_states(spark, sf):
    return order_states_now(spark, sf).withColumn("avg_price", F.round("avg_price", 6))


@plan("account_orders", f"""{ORDER_STATES} SELECT account, count(*) AS n_orders, count(*) FILTER (status IN ('submitting', 'not_traded', 'part_traded')) AS n_active, count(*) FILTER (status = 'all_traded') AS n_traded, count(*) FILTER (expired) AS n_expired, max(opened) AS last_order,
    coalesce(sum(qty - filled) FILTER (status IN ('submitting', 'not_traded', 'part_traded')), 0) AS open_qty FROM orders_now GROUP BY 1""", "order_log")
def account_orders(spark, sf):
    """What the order getters of an account answer: active and finished orders, the newest, and what is still open."""
    active = F.col("status").isin("submitting", "not_traded", "part_traded")
    g = order_states_now(spark, sf).groupBy("account")
    return g.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(active).alias("n_active"), F.count_if(F.col("status") == "all_traded").alias("n_traded"), F.count_if("expired").alias("n_expired"), F.max("opened").alias("last_order"), F.coalesce(F.sum(F.when(active, F.col("qty") - F.col("filled"))), F.lit(0.0)).alias("open_qty"))


# Late rows

#: Seconds of arrival in one file of the replay, and how far rows may come behind the newest one seen.
PART, LATE = 3 * 86_400, 600

ARRIVED = f"""a AS (SELECT *, ('0x' || substr(md5('arrival|' || trade_id), 1, 8))::BIGINT AS x FROM trades),
    b AS MATERIALIZED (SELECT * EXCLUDE x, (epoch_us(ts) // 1000000 + CASE WHEN x % 20 = 0 THEN x % 21600 ELSE x % 300 END) // {PART} AS part FROM a),
    m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {LATE} SECOND AS edge FROM b GROUP BY part),
    s AS MATERIALIZED (SELECT b.*, coalesce(ts < edge, false) AS late FROM b JOIN m USING (part))"""


def delayed_replay(spark, sf):
    """The ticks in several files by time of arrival, most of them within minutes and some hours late, split as they come."""
    x = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("arrival"), F.col("trade_id").cast("string"))), 1, 8), 16, 10).cast("long")
    second = F.floor(F.unix_micros("ts") / 1_000_000)
    ticks = A.trades(spark, sf).withColumn("part", F.floor((second + F.when(x % 20 == 0, x % 21_600).otherwise(x % 300)) / PART))
    path = folder(spark)
    ticks.write.partitionBy("part").parquet(f"{path}/arrivals")  # one pass over the ticks for all parts
    split = late.LateSplit(spark, f"{path}/split", ticks.schema, "ts", LATE)
    arrived = spark.read.schema(ticks.schema).parquet(f"{path}/arrivals")
    for (part,) in arrived.select("part").distinct().orderBy("part").collect():
        # What is there when the stream goes on is one micro-batch, of as many files as tasks wrote.
        arrived.where(F.col("part") == part).write.mode("append").parquet(f"{path}/in")
        late.split_stream(spark.readStream.schema(ticks.schema).parquet(f"{path}/in"), split, f"{path}/state")
    return split, path


@plan("stream_late_rows", f"WITH {ARRIVED} SELECT trade_id, symbol, part, ts FROM s WHERE late")
def stream_late_rows(spark, sf):
    """What came behind the watermark, kept in a table of its own."""
    split, _ = delayed_replay(spark, sf)
    return split.late().select("trade_id", "symbol", "part", F.col("ts").cast("timestamp_ntz").alias("ts"))


@plan("stream_sliding_vwap", f"""WITH {ARRIVED}, w AS (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS start, price, amount FROM s, range(4) r(k) WHERE NOT late),
    n AS (SELECT count(*) FILTER (late) AS dropped FROM s)
    SELECT symbol, start, round(sum(price * amount) / nullif(sum(amount), 0), 6) AS vwap, sum(amount) AS volume, count(*) AS n, any_value(dropped) AS dropped FROM w, n GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL {LATE} SECOND FROM trades)""")
def stream_sliding_vwap(spark, sf):
    """Mean prices of sliding hours over the rows in time, and how many rows were not."""
    split, path = delayed_replay(spark, sf)
    rows = spark.readStream.schema(split.stored).parquet(f"{path}/split/on_time")
    w = flows.drain(flows.vwap(rows, late=f"{LATE} seconds"), f"{path}/vwap")
    return w.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.round("vwap", 6).alias("vwap"), "volume", "n", F.lit(split.counts()["late"]).alias("dropped"))
