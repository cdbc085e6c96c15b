"""Queries of the back-testing lab."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import market, reports
from .market import PEAK
from .registry import query, r6, rated, table, trades


def _peaks(spark, sf_dir):
    t = trades(spark, sf_dir)
    g = t.groupBy("mint").agg(F.min("ts").alias("first")).select("mint", (F.col("first") + F.expr("INTERVAL 100 DAYS")).alias("graduated_at"))
    return market.peak_multiples(g, t.select("mint", F.col("ts").alias("at"), "id", "venue", "usd", "amount"), ["O"], least_usd=10_000)


PEAKS = PEAK.replace("SELECT g.mint, first_price", ", pk AS (SELECT g.mint, g.graduated_at, max_price / nullif(price_after, 0) AS old, max_price / nullif(price_at_graduation, 0) AS multiple, max_price * 1000000000.0 AS ath, trade_count FROM g LEFT JOIN a ON g.mint = a.mint LEFT JOIN n ON g.mint = n.mint) SELECT g.mint, first_price")
PEAKS = PEAKS[: PEAKS.index(" SELECT g.mint, first_price")] + " "
OUTCOME = "CASE WHEN coalesce(multiple, 0) >= 5 AND NOT coalesce(multiple, 0) < 2 THEN 'winner' WHEN coalesce(multiple, 0) < 2 THEN 'loser' ELSE 'ignored' END"


@query(PEAKS + f"SELECT {OUTCOME} AS outcome, CASE WHEN multiple IS NULL THEN 'unknown' WHEN multiple >= 5 THEN 'ran' WHEN multiple < 2 THEN 'fizzled' ELSE 'middle' END AS peak, count(*) AS n FROM pk GROUP BY ALL", "trades")
def outcome_counts(spark, sf_dir):
    """F37, A35, A48."""
    p = _peaks(spark, sf_dir)
    o = gates.outcome(F.col("peak_multiple"), F.lit(0.0), F.lit(60_000.0), F.lit(False))
    return p.groupBy(o.alias("outcome"), gates.peak_class(F.col("peak_multiple")).alias("peak")).agg(F.count(F.lit(1)).alias("n"))


@query(PEAKS + "SELECT CASE WHEN old >= 5 THEN 'yes' ELSE 'no' END AS was, CASE WHEN multiple >= 5 THEN 'yes' ELSE 'no' END AS now, count(*) AS n FROM pk GROUP BY ALL", "trades")
def peak_revision(spark, sf_dir):
    """Winners under the old and the new price at graduation."""
    kind = lambda c: F.when(F.col(c) >= 5, "yes").otherwise("no")
    return reports.transitions(_peaks(spark, sf_dir), kind("peak_multiple_old"), kind("peak_multiple"))


FEATURES = ", c AS (SELECT mint, count(*) AS trades, sum(amount) AS amount, count(DISTINCT wallet) AS wallets, avg(usd) AS mean_usd FROM trades GROUP BY mint), r AS (SELECT CASE WHEN multiple >= 5 THEN 'winner' WHEN multiple < 5 THEN 'loser' END AS outcome, c.trades::DOUBLE AS trades, c.amount, c.wallets::DOUBLE AS wallets, c.mean_usd FROM pk JOIN c ON pk.mint = c.mint) "


def _features(spark, sf_dir):
    t = trades(spark, sf_dir)
    c = t.groupBy("mint").agg(F.count(F.lit(1)).alias("trades"), F.sum("amount").alias("amount"), F.countDistinct("wallet").alias("wallets"), F.avg("usd").alias("mean_usd"))
    o = F.when(F.col("peak_multiple") >= 5, "winner").when(F.col("peak_multiple") < 5, "loser")
    return _peaks(spark, sf_dir).select("mint", o.alias("outcome")).join(c, "mint")


@query(PEAKS + FEATURES + ", u AS (SELECT outcome, unnest(['trades', 'amount', 'wallets', 'mean_usd']) AS feature, unnest([trades, amount, wallets, mean_usd]) AS value FROM r WHERE outcome IS NOT NULL), d AS (SELECT feature, outcome, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS p75 FROM u GROUP BY ALL), w AS (SELECT feature, max(m) FILTER (WHERE outcome = 'winner') AS wm, max(m) FILTER (WHERE outcome = 'loser') AS lm, max(p75 - p25) FILTER (WHERE outcome = 'winner') AS ws, max(p75 - p25) FILTER (WHERE outcome = 'loser') AS ls FROM d GROUP BY feature) SELECT feature, round(wm, 4) AS winner_median, round(lm, 4) AS loser_median, round(coalesce(abs(wm - lm) / greatest(ws, ls, 1e-9), 0), 4) AS separation FROM w", "trades")
def separation_score(spark, sf_dir):
    """A28, B4."""
    s = reports.separation(_features(spark, sf_dir), ["trades", "amount", "wallets", "mean_usd"])
    return s.select("feature", *[F.round(c, 4).alias(c) for c in ("winner_median", "loser_median", "separation")])


@query(PEAKS + FEATURES + "SELECT count(*) FILTER (WHERE outcome = 'winner' AND trades >= 30 AND mean_usd >= 40000) AS winners_caught, count(*) FILTER (WHERE outcome = 'winner' AND NOT (trades >= 30 AND mean_usd >= 40000)) AS winners_missed, count(*) FILTER (WHERE outcome = 'loser' AND trades >= 30 AND mean_usd >= 40000) AS losers_passed, count(*) FILTER (WHERE outcome = 'loser' AND NOT (trades >= 30 AND mean_usd >= 40000)) AS losers_blocked FROM r", "trades")
def threshold_confusion(spark, sf_dir):
    """A27."""
    return reports.confusion(_features(spark, sf_dir), reports.threshold_pass(F.col("trades"), F.col("mean_usd"), 30, 40_000))


@query("SELECT b AS band, low, high, count(r.id) AS n, count(r.id) FILTER (WHERE coined) AS coined, round(count(r.id) FILTER (WHERE coined) / nullif(count(r.id), 0), 6) AS rate FROM (VALUES (0, 0.0, 0.3), (1, 0.3, 0.5), (2, 0.5, 0.6), (3, 0.6, 0.7), (4, 0.7, 0.8), (5, 0.8, 0.9), (6, 0.9, 1.01)) AS v(b, low, high) LEFT JOIN rated r ON r.score >= low::DOUBLE AND r.score < high::DOUBLE GROUP BY ALL", "rated")
def score_bands(spark, sf_dir):
    """A23."""
    return reports.score_bands(rated(spark, sf_dir), "score", "coined").withColumn("rate", F.round("rate", 6))


@query(", t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n, count(*) FILTER (WHERE score >= threshold AND coined) AS coined, count(*) AS total FROM t, rated GROUP BY threshold), r AS (SELECT threshold, n, coined, coined / nullif(n, 0) AS rate, n / total AS share FROM c) SELECT threshold, n, coined, round(rate, 6) AS rate, round(share, 6) AS share, round(rate - last_value(rate IGNORE NULLS) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS delta FROM r", "rated")
def cumulative_thresholds(spark, sf_dir):
    """A24, A25, W13."""
    c = reports.cumulative(rated(spark, sf_dir), "score", "coined")
    return c.select("threshold", "n", "coined", r6("rate"), r6("share"), r6("delta"))


@query(", t AS (SELECT unnest([1, 2, 3, 4, 5]) AS p, unnest([0.7, 0.65, 0.75, 0.6, 0.8]::DOUBLE[]) AS threshold), c AS (SELECT p, threshold, count(*) FILTER (WHERE score >= threshold) AS an, count(*) FILTER (WHERE score >= threshold AND coined) AS ac, count(*) FILTER (WHERE score < threshold) AS bn, count(*) FILTER (WHERE score < threshold AND coined) AS bc FROM t, rated GROUP BY ALL) SELECT threshold, an AS above_n, bn AS below_n, round(ac / an, 6) AS above_rate, round(bc / bn, 6) AS below_rate FROM c WHERE an >= 15 AND bn >= 15 AND ac / an >= 0.5 AND bc / bn <= 0.9 ORDER BY p LIMIT 1", "rated")
def elbow_threshold(spark, sf_dir):
    """A26."""
    e = reports.elbow(rated(spark, sf_dir), "score", "coined", above=0.5, below=0.9)
    return e.select("threshold", "above_n", "below_n", r6("above_rate"), r6("below_rate"))


@query("SELECT lang, count(*) FILTER (WHERE score >= 0.7) AS passed, count(*) FILTER (WHERE score >= 0.7 AND coined) AS passed_coined, count(*) FILTER (WHERE score < 0.7) AS failed, count(*) FILTER (WHERE score < 0.7 AND coined) AS failed_coined, round((count(*) FILTER (WHERE score >= 0.7 AND coined) / nullif(count(*) FILTER (WHERE score >= 0.7), 0)) / nullif(count(*) FILTER (WHERE score < 0.7 AND coined) / nullif(count(*) FILTER (WHERE score < 0.7), 0), 0), 6) AS lift FROM rated GROUP BY lang", "rated")
def pass_fail_lift(spark, sf_dir):
    """A29."""
    p = reports.pass_fail(rated(spark, sf_dir), "score", "coined", 0.7, ["lang"])
    return p.select("lang", "passed", "passed_coined", "failed", "failed_coined", r6("lift"))


@query("SELECT round(avg(score), 6) AS old_mean, round(avg(CASE WHEN coined THEN 0.8 ELSE 0.4 END), 6) AS new_mean, count(*) FILTER (WHERE abs((CASE WHEN coined THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END) - score) >= 0.2::DOUBLE) AS moved, count(*) AS n FROM rated", "rated")
def score_shift(spark, sf_dir):
    """A30."""
    r = rated(spark, sf_dir).withColumn("new", F.when(F.col("coined"), 0.8).otherwise(0.4))
    return reports.score_shift(r, "score", "new").select(r6("old_mean"), r6("new_mean"), "moved", "n")


@query("WITH u AS (SELECT lang, 'quality' AS label, quality AS v FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM labels JOIN documents USING (doc_id)) SELECT lang, label, count(*) FILTER (WHERE v = 1) AS yes, count(*) FILTER (WHERE v IN (0, 1)) AS usable, count(*) FILTER (WHERE v IS NULL OR v NOT IN (0, 1)) AS excluded, round(count(*) FILTER (WHERE v = 1) * 100.0 / nullif(count(*) FILTER (WHERE v IN (0, 1)), 0), 6) AS rate FROM u GROUP BY ALL")
def yes_rate(spark, sf_dir):
    """A19, F38."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return reports.yes_rates(l.select("lang", "quality", "toxic"), ["quality", "toxic"], ["lang"]).withColumn("rate", F.round("rate", 6))


@query("SELECT CASE WHEN trim(p_type) = '' THEN '(blank)' ELSE trim(p_type) END AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf_dir):
    """A20."""
    return reports.value_counts(table(spark, sf_dir, "part"), "p_type")


@query("SELECT coined AS has_url, count(*) AS n, round(median(score * 10), 6) AS median_peak, round(median(n_chars::DOUBLE), 6) AS median_mcap, count(*) FILTER (WHERE score * 10 >= 5) AS ran, round(count(*) FILTER (WHERE score * 10 >= 5) * 100.0 / count(*), 6) AS ran_pct FROM rated GROUP BY coined", "rated")
def group_stats(spark, sf_dir):
    """A21."""
    r = rated(spark, sf_dir).withColumn("m", F.col("score") * 10).withColumnRenamed("coined", "has_url")
    g = reports.group_stats(r, ["has_url"], "m", "n_chars")
    return g.select("has_url", "n", r6("median_peak"), r6("median_mcap"), "ran", r6("ran_pct"))


@query(", a AS (SELECT id % 120 AS age, score, coined FROM rated) SELECT d AS days, count(*) FILTER (WHERE age <= d) AS n, count(*) FILTER (WHERE age <= d AND coined) AS winners, count(*) FILTER (WHERE age <= d AND NOT coined) AS losers FROM a, (VALUES (30), (60), (90)) AS w(d) GROUP BY d", "rated")
def outcome_windows(spark, sf_dir):
    """A22."""
    r = rated(spark, sf_dir).withColumn("age", F.col("id") % 120)
    return reports.outcome_windows(r, "age", F.col("coined"), ~F.col("coined"))


@query(", b AS (SELECT count(*) FILTER (WHERE coined) / count(*) AS base FROM rated) SELECT source AS wave, count(*) AS n, count(*) FILTER (WHERE coined) AS winners, round(count(*) FILTER (WHERE coined) / count(*) / nullif(min(base), 0), 6) AS vs_base FROM rated, b GROUP BY source", "rated")
def wave_shares(spark, sf_dir):
    """A48."""
    w = reports.share_by_wave(rated(spark, sf_dir), "source", F.col("coined"))
    return w.select(F.col("source").alias("wave"), "n", "winners", r6("vs_base"))


@query("SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'mid' ELSE 'large' END AS bucket, coined, count(*) AS n FROM rated GROUP BY ALL", "rated")
def follower_buckets(spark, sf_dir):
    """A47 over lengths."""
    b = gates.follower_bucket(F.col("n_chars") * 20)
    return rated(spark, sf_dir).groupBy(b.alias("bucket"), "coined").agg(F.count(F.lit(1)).alias("n"))


@query(", t AS (SELECT id, CASE WHEN coined THEN 'winner' ELSE 'loser' END AS \"group\" FROM rated), k AS (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY md5('42/' || id), id) AS r FROM t), n AS (SELECT min(c) AS n FROM (SELECT least(count(*), 50) AS c FROM t GROUP BY \"group\")) SELECT row_number() OVER (ORDER BY md5('43/' || id), id) AS row_id, id, \"group\" FROM k, n WHERE r <= n", "rated")
def case_control_sample(spark, sf_dir):
    """Fifty good and fifty other documents in seeded order."""
    return reports.case_control(rated(spark, sf_dir), "id", F.col("coined"), ~F.col("coined"), 42, 50).select("row_id", "id", "group")


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42/' || o_orderkey), o_orderkey) <= 5")
def seeded_sample(spark, sf_dir):
    """Five orders of each priority."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return reports.seeded_sample(o, "o_orderkey", 5, 42, ["o_orderpriority"])


@query("SELECT l_orderkey AS key, l_linenumber AS post_id, l_quantity / 50 AS confidence, l_extendedprice AS views FROM lineitem WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_quantity / 50 >= 0.35) DESC, CASE WHEN l_quantity / 50 >= 0.35 THEN l_extendedprice END DESC NULLS LAST, l_quantity / 50 DESC, l_extendedprice DESC, l_linenumber) = 1")
def best_matches(spark, sf_dir):
    """The best line of each order; returns stand for wrong addresses."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("post_id"), (F.col("l_quantity") / 50).alias("confidence"), F.col("l_extendedprice").alias("views"), (F.col("l_returnflag") == "R").alias("wrong_address"))
    return reports.best_match(l, "key", F.lit(True)).select("key", "post_id", "confidence", "views")
