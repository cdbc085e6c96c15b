"""Queries over trades, holders, candles, pairs and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text
from ..operators import budget, market, tables
from .registry import NOW, now, query, r6, table, trades


@query(", w AS (SELECT CASE WHEN o_totalprice IS NULL THEN 0 ELSE floor(o_totalprice)::DECIMAL(38,0) END AS a, o_custkey FROM orders), p AS (SELECT o_custkey, sum(a)::DECIMAL(38,0) AS amount FROM w WHERE a <> 0 GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, o_custkey) AS rank, sum(amount) OVER () AS total, count(*) OVER () AS holders FROM p), q AS (SELECT *, (amount::HUGEINT * 10000 // total::HUGEINT)::DOUBLE / 100 AS pct FROM r WHERE rank <= 20) SELECT rank, o_custkey, amount::DOUBLE AS amount, pct, holders, round((SELECT sum(pct) FROM q WHERE rank <= 10), 2) AS top10_pct FROM q".replace(", w AS", "WITH w AS", 1))
def holder_concentration(spark, sf_dir):
    """Customers as owners."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").cast("decimal(38,0)").alias("a"))
    return market.holder_concentration(o, "o_custkey", "a").withColumn("amount", F.col("amount").cast("double"))


PNL = ", n AS (SELECT *, row_number() OVER (PARTITION BY mint, wallet ORDER BY ts, id) AS k FROM {pool}), f AS (SELECT DISTINCT mint, wallet, 0::BIGINT AS k, 0::DOUBLE AS held, 0::DOUBLE AS cost, 0::DOUBLE AS pnl FROM n UNION ALL SELECT f.mint, f.wallet, n.k, CASE WHEN side = 'buy' THEN held + amount ELSE held - least(amount, held) END, CASE WHEN side = 'buy' THEN cost + usd WHEN held > 0 THEN cost - cost / held * least(amount, held) ELSE cost END, CASE WHEN side = 'buy' THEN pnl WHEN held > 0 THEN pnl + (usd - cost / held * least(amount, held)) ELSE pnl + usd END FROM f JOIN n ON f.mint = n.mint AND f.wallet = n.wallet AND n.k = f.k + 1), e AS (SELECT mint, wallet, max_by(held, k) AS held, max_by(cost, k) AS cost, max_by(pnl, k) AS pnl FROM f GROUP BY ALL), c AS (SELECT mint, wallet, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side <> 'buy') AS sells, coalesce(sum(usd) FILTER (WHERE side = 'buy'), 0) AS buy_usd, coalesce(sum(usd) FILTER (WHERE side <> 'buy'), 0) AS sell_usd FROM {pool} GROUP BY ALL) "


def _recursive(sql: str) -> str:
    from .registry import CTE

    return "WITH RECURSIVE " + CTE["trades"] + sql


@query(_recursive(PNL.format(pool="trades") + "SELECT c.mint, c.wallet, buys, sells, round(buy_usd, 2) AS buy_usd, round(sell_usd, 2) AS sell_usd, round(pnl, 3) AS realized, held, round(cost, 3) AS cost FROM c JOIN e ON c.mint = e.mint AND c.wallet = e.wallet"))
def wallet_pnl(spark, sf_dir):
    """A37 for each wallet of each token."""
    w = market.wallet_pnl(trades(spark, sf_dir), ["mint", "wallet"], ["ts", "id"], amount="amount")
    return w.select("mint", "wallet", "buys", "sells", F.round("buy_usd", 2).alias("buy_usd"), F.round("sell_usd", 2).alias("sell_usd"), F.round("realized", 3).alias("realized"), "held", F.round("cost", 3).alias("cost"))


@query(_recursive(", l AS (SELECT mint, max(ts) AS last, max_by(price, (ts, id)) AS price_now FROM trades GROUP BY mint), pool AS (SELECT t.* FROM trades t JOIN l ON t.mint = l.mint WHERE t.ts >= l.last - INTERVAL 720 DAY)" + PNL.format(pool="pool") + ", s AS (SELECT c.*, e.pnl, e.held FROM c JOIN e ON c.mint = e.mint AND c.wallet = e.wallet), a AS (SELECT mint, wallet, 'trader' AS kind, row_number() OVER (PARTITION BY mint ORDER BY pnl DESC, wallet) AS rank, pnl FROM s WHERE sells > 0 UNION ALL SELECT mint, wallet, 'accumulating', row_number() OVER (PARTITION BY mint ORDER BY buy_usd DESC, wallet), pnl FROM s WHERE sells = 0) SELECT mint, wallet, kind, rank, round(pnl, 3) AS realized FROM a WHERE rank <= 3"))
def top_traders(spark, sf_dir):
    """Three traders and three accumulators of each token over its last 720 days."""
    t = trades(spark, sf_dir).withColumnRenamed("amount", "token_amount")
    out = market.top_traders(t, "mint", "wallet", "ts", "id", "price", "INTERVAL 720 DAYS", 3, 3)
    return out.select("mint", "wallet", "kind", "rank", F.round("realized", 3).alias("realized"))


BARS = ", b AS (SELECT mint, date_trunc('month', ts) AS t, min_by(price, (ts, id)) AS o, max(price) AS h, min(price) AS l, max_by(price, (ts, id)) AS c, sum(usd) AS v FROM trades GROUP BY ALL) "


@query("SELECT user_id, date_trunc('day', ts) AS t, min_by(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, (ts, event_id)) AS c, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def ohlc_daily(spark, sf_dir):
    """Candles of each user's values."""
    c = market.candles(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", "value", "1 day")
    return c.select("user_id", F.col("t").cast("timestamp_ntz").alias("t"), "o", "h", "l", "c", F.round("v", 4).alias("v"))


@query(BARS + "SELECT mint, min_by(o, t) AS launch_price, greatest(min_by(o, t), max(h)) AS peak_price, max_by(c, t) AS current_price, round(greatest(min_by(o, t), max(h)) / min_by(o, t), 6) AS peak_multiple, greatest(min_by(o, t), max(h)) * 1000000000.0 AS peak_mcap FROM b GROUP BY mint", "trades")
def peak_metrics(spark, sf_dir):
    """A39 over monthly candles."""
    t = trades(spark, sf_dir)
    bars = t.groupBy("mint", F.date_trunc("month", "ts").alias("t")).agg(
        F.min_by("price", F.struct("ts", "id")).alias("o"), F.max("price").alias("h"), F.max_by("price", F.struct("ts", "id")).alias("c"))
    return market.peak_metrics(bars, "mint").select("mint", "launch_price", "peak_price", "current_price", r6("peak_multiple"), "peak_mcap")


PEAK = """, g AS (SELECT mint, min(ts) + INTERVAL 100 DAY AS graduated_at FROM trades GROUP BY mint), p AS (SELECT t.*, g.graduated_at FROM trades t JOIN g ON t.mint = g.mint WHERE usd > 0 AND amount > 0),
a AS (SELECT mint, max(price) AS max_price, min_by(price, (ts, id)) FILTER (WHERE ts >= graduated_at) AS price_after, min_by(price, (ts, id)) FILTER (WHERE ts >= graduated_at AND venue = 'O' AND usd >= 10000) AS price_at_graduation, min_by(price, (ts, id)) AS first_price, count(*) AS trade_count FROM p GROUP BY mint),
n AS (SELECT p.mint, count(*) AS trades_near_peak FROM p JOIN a ON p.mint = a.mint WHERE price >= max_price * 0.9 GROUP BY p.mint)
SELECT g.mint, first_price, price_after, price_at_graduation, max_price, round(max_price / nullif(price_after, 0), 6) AS peak_multiple_old, round(max_price / nullif(price_at_graduation, 0), 6) AS peak_multiple, trade_count, coalesce(trades_near_peak, 0) AS trades_near_peak FROM g LEFT JOIN a ON g.mint = a.mint LEFT JOIN n ON g.mint = n.mint"""


@query(PEAK, "trades")
def peak_multiples(spark, sf_dir):
    """Peaks over the price at graduation, a hundred days after the first trade."""
    t = trades(spark, sf_dir)
    g = t.groupBy("mint").agg(F.min("ts").alias("first")).select("mint", (F.col("first") + F.expr("INTERVAL 100 DAYS")).alias("graduated_at"))
    legs = t.where("side = 'buy'").union(t.where("side <> 'buy'")).select("mint", F.col("ts").alias("at"), "id", "venue", "usd", "amount")
    return market.peak_multiples(g, legs, ["O"], least_usd=10_000).select("mint", "first_price", "price_after", "price_at_graduation", "max_price", r6("peak_multiple_old"), r6("peak_multiple"), "trade_count", "trades_near_peak")


PAIRS = ", pr AS (SELECT mint, wallet AS pair, wallet % 3 = 0 AS sol, sum(usd) AS volume, max(amount) AS liquidity FROM trades GROUP BY ALL) "


@query(PAIRS + "SELECT mint, pair, sol AS sol_quote, round(volume, 2) AS volume FROM pr QUALIFY row_number() OVER (PARTITION BY mint ORDER BY sol DESC, volume DESC, liquidity DESC, pair) = 1", "trades")
def best_pair_per_mint(spark, sf_dir):
    """K8."""
    p = trades(spark, sf_dir).groupBy("mint", F.col("wallet").alias("pair")).agg(F.round(F.sum("usd"), 2).alias("volume"), F.max("amount").alias("liquidity")).withColumn("sol_quote", F.col("pair") % 3 == 0)
    return market.best_pair(p).select("mint", "pair", "sol_quote", "volume")


@query("SELECT p_name AS ticker, p_partkey AS mint, p_retailprice AS liquidity FROM part QUALIFY row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_retailprice DESC NULLS LAST, p_size DESC NULLS LAST, p_partkey) = 1")
def dedup_by_ticker(spark, sf_dir):
    """K10."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("ticker"), F.col("p_partkey").alias("mint"), F.col("p_retailprice").alias("liquidity"), F.col("p_size").alias("launch_at"))
    return market.dedup_by_ticker(p).select("ticker", "mint", "liquidity")


@query("WITH m AS (SELECT l_suppkey AS mint, max(l_extendedprice) AS v FROM lineitem GROUP BY 1), s AS (SELECT p_name AS symbol, max(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_partkey AS mint, coalesce(m.v, s.v) AS v FROM part LEFT JOIN m ON p_partkey = m.mint LEFT JOIN s ON p_name = s.symbol")
def symbol_or_mint_join(spark, sf_dir):
    """The best price by the number of a part, read as a supplier's, of which there are fewer, or else by the part's name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mint"), F.col("p_name").alias("symbol"))
    names = p.withColumnRenamed("mint", "l_partkey")
    v = table(spark, sf_dir, "lineitem").join(names, "l_partkey").select(F.col("l_suppkey").alias("mint"), "symbol", F.col("l_extendedprice").alias("v"))
    return market.by_symbol_or_mint(p, v, "v").select("mint", "v")


@query("WITH a AS (SELECT o_orderkey AS id, o_custkey AS term, epoch_us(o_orderdate) // 1000 AS t FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT o_custkey AS term, o_orderkey AS mint, epoch_us(o_orderdate) // 1000 AS u FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT a.id, min((u, mint)) AS f FROM a JOIN l ON a.term = l.term AND u >= t - 300000 GROUP BY a.id) SELECT a.id, f[2] AS mint, f[1] AS launch_ms, f IS NOT NULL AS coined FROM a LEFT JOIN h ON a.id = h.id".replace("f[2]", "struct_extract(f, 2)").replace("f[1]", "struct_extract(f, 1)"))
def first_coin_after(spark, sf_dir):
    """The first closed order of the same customer at or after each open one."""
    o = table(spark, sf_dir, "orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    a = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("term"), F.col("ms").alias("anchor_ms"))
    b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("term"), F.col("o_orderkey").alias("mint"), F.col("ms").alias("launch_ms"))
    return market.first_after(a, b).select("id", "mint", "launch_ms", "coined")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '% ring' THEN 'ring' END AS suffix, coalesce(p_retailprice >= 1000 AND p_size >= 10 AND p_size <= 40 AND p_retailprice > 0, false) AS shown FROM part")
def token_floor(spark, sf_dir):
    """P4, P8."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.when(F.endswith("p_name", F.lit(" ring")), "ring").alias("suffix"), gates.token_floor(F.col("p_retailprice"), F.col("p_size"), F.col("p_size"), F.col("p_retailprice"), 1000, 10, 40).alias("shown"))


@query("SELECT p_partkey, CASE WHEN upper(split_part(p_name, ' ', 1)) IN ('HOT', 'NEW') THEN 'generic ticker $' || upper(split_part(p_name, ' ', 1)) END AS reason FROM part")
def name_plausibility(spark, sf_dir):
    """The first word of a part's name as its ticker."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.name_reject_reason(F.col("p_name"), F.split("p_name", " ")[0]).alias("reason"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS day_spent, round(sum(value) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS hour_spent FROM events")
def budget_running_day(spark, sf_dir):
    """W15, T8."""
    e = budget.running_spend(table(spark, sf_dir, "events"), "ts", "event_id", "value")
    return e.select("event_id", F.round("day_spent", 4).alias("day_spent"), F.round("hour_spent", 4).alias("hour_spent"))


@query("WITH r AS (SELECT event_id, event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d, sum(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h FROM events) SELECT event_type, coalesce(CASE WHEN d > 10000 THEN 'day' WHEN h > 700 THEN 'hour' END, 'open') AS state, count(*) AS n FROM r GROUP BY ALL")
def budget_hourly_block(spark, sf_dir):
    """Reads that the hourly or daily limit blocks."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    r = budget.running_spend(e, "ts", "event_id", "k")
    state = F.coalesce(budget.blocked(F.col("hour_spent"), F.col("day_spent"), 700, 10_000), F.lit("open"))
    return r.groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS spent, (sum(o_totalprice::DECIMAL(18,2)) * day(last_day(o_orderdate::DATE)))::DOUBLE AS month_projection FROM orders GROUP BY o_orderdate::DATE, 1")
def daily_spend(spark, sf_dir):
    """A32."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("paid"))
    d = budget.daily_spend(o, "o_orderdate", "paid")
    return d.select(F.col("day").cast("string").alias("day"), F.col("spent").cast("double").alias("spent"), F.col("month_projection").cast("double").alias("month_projection"))


@query("SELECT round(sum(value) / 7, 6) AS per_day, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-13'")
def trailing_average(spark, sf_dir):
    """A33."""
    return budget.trailing_average(table(spark, sf_dir, "events"), "ts", "value", F.lit("2024-01-20 00:00:00").cast("timestamp")).select(r6("per_day"), "n")


@query("SELECT round(sum(value), 4) AS spent, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def latest_spend(spark, sf_dir):
    """A45."""
    return budget.latest_spend(table(spark, sf_dir, "events"), "ts", "event_id", "value").select(F.round("spent", 4).alias("spent"), "n")


@query("SELECT o_orderpriority AS lane, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS converted, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY o_orderpriority")
def lane_conversion(spark, sf_dir):
    """A34, J16."""
    c = budget.lane_conversion(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return c.select(F.col("o_orderpriority").alias("lane"), "n", "converted", r6("rate"))


@query("SELECT user_id, event_id, CASE WHEN k = 0 THEN greatest(100, floor(floor(value) * 6e-1)) WHEN k % 5 = 0 THEN floor(value) WHEN k > 50 THEN least(100000, ceil(floor(value) * 12e-1)) WHEN k < 30 THEN greatest(100, floor(floor(value) * 8e-1)) ELSE floor(value) END::BIGINT AS floor FROM (SELECT user_id, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def next_floors(spark, sf_dir):
    """T7's rule for each cycle on its own; the keyed controller is in the streaming package."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("user_id", "event_id", budget.next_floor(F.floor("value"), F.col("k"), F.col("k"), F.lit(50), F.col("k") % 5 == 0, F.lit(100)).alias("floor"))


@query("WITH e AS (SELECT user_id, event_id, ts, value, value < 100 AS low FROM events), s AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM e), b AS (SELECT *, min(CASE WHEN low THEN epoch_us(ts) END) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM s), c AS (SELECT *, CASE WHEN low THEN floor((epoch_us(ts) - since) / 3600000000 - 2) END AS step FROM b), d AS (SELECT user_id, coalesce(step >= 0 AND step > coalesce(lag(step) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id), -1), false) AS alarm FROM c) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE alarm) AS alarms FROM d GROUP BY user_id")
def underused_alarms(spark, sf_dir):
    """T10, batch form."""
    a = budget.underused_alarms(table(spark, sf_dir, "events"), "ts", "value", "event_id", ["user_id"], least=100.0)
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("alarm").alias("alarms"))


@query("WITH t AS (SELECT l_partkey AS term, max(l_extendedprice) AS views, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT o_custkey AS term FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 45 MINUTE) SELECT term, views, n FROM t WHERE term NOT IN (SELECT term FROM c) ORDER BY views DESC, term LIMIT 20")
def trend_candidates(spark, sf_dir):
    """T15, K14."""
    terms = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term"), F.col("l_extendedprice").alias("views"))
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderdate").alias("fetched_at"))
    return tables.trend_batch(terms, cache, "term", F.lit("2001-01-01 00:00:00").cast("timestamp"))
