"""Queries of feeds, queues and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import feeds, health, narratives
from .registry import NOW, now, posts, query, r6, rated, scores, snapshots, table
from .series import NARRATIVES

EPOCH = "epoch_us(posted_at) // 1000"


@query("SELECT post_id FROM posts JOIN documents ON post_id = doc_id WHERE likes >= 50 AND lang = 'en' AND posted_at >= TIMESTAMP '2024-01-30 06:00:00' AND posted_at < TIMESTAMP '2024-01-30 18:00:00'", "posts")
def search_filter(spark, sf_dir):
    """S7."""
    p = posts(spark, sf_dir).withColumn("lang", F.when(F.col("platform") == "x", "en").otherwise("other")).withColumn("posted_at", values.millis(F.col("posted_at")))
    return feeds.search_filter(p, 50, "en", 1706594400000, 1706637600000).select("post_id")


@query(f", l AS (SELECT views, CASE WHEN likes % 5 = 0 THEN 'media-lane' WHEN (epoch_us(TIMESTAMP '{NOW}') // 1000 - {EPOCH}) / 60000 > 120 THEN 'slow-burn' ELSE 'catch-all' END AS lane FROM posts) SELECT lane, count(*) AS n, count(*) FILTER (WHERE views >= CASE lane WHEN 'media-lane' THEN 100 WHEN 'slow-burn' THEN 1000 ELSE 300 END) AS reaching FROM l GROUP BY lane", "posts")
def ingest_lanes(spark, sf_dir):
    """T19, P6."""
    p = posts(spark, sf_dir).select("views", F.when(F.col("likes") % 5 == 0, "u").alias("media_url"), values.age_minutes(values.millis(F.col("posted_at")), values.millis(now())).alias("age_min"))
    return feeds.lanes(p, {"media-lane": 100, "slow-burn": 1000, "catch-all": 300}).groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.count_if("reaches").alias("reaching"))


@query("SELECT post_id, 'force' AS queue FROM (SELECT post_id FROM posts ORDER BY posted_at DESC, post_id LIMIT 10) UNION ALL SELECT post_id, 'recheck' FROM (SELECT post_id FROM posts WHERE views < 1000 ORDER BY views DESC, post_id LIMIT 50)", "posts")
def work_queues(spark, sf_dir):
    """K2, K7."""
    p = posts(spark, sf_dir).drop("text")
    a, b = feeds.force_batch(p, 10), feeds.recheck_batch(p.where("views < 1000"))
    return a.select("post_id", F.lit("force").alias("queue")).unionByName(b.select("post_id", F.lit("recheck").alias("queue")))


@query("SELECT o_orderpriority AS stage, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def latest_runs(spark, sf_dir):
    """K12."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("id"))
    return feeds.latest_run(o).select("stage", "id")


@query("(SELECT id, 'false_positive' AS kind, score FROM rated WHERE score >= 0.7 AND NOT coined ORDER BY score DESC, id LIMIT 10) UNION ALL (SELECT id, 'false_negative', score FROM rated WHERE score < 0.7 AND coined ORDER BY score, id LIMIT 10)", "rated")
def score_mistakes(spark, sf_dir):
    """K19."""
    return feeds.mistakes(rated(spark, sf_dir), "score", "coined", 0.7, "id").select("id", "kind", "score")


@query(f"SELECT narrative_id, round(sum(o.views), 4) AS views, round(coalesce(sum(s.views_velocity), 0), 4) AS views_velocity FROM posts p JOIN ok o ON p.post_id = o.post_id AND o.r = 1 LEFT JOIN speed s ON p.post_id = s.post_id GROUP BY narrative_id", "snaps", "ok", "vel", "speed", "posts")
def open_velocities(spark, sf_dir):
    """T16; narratives whose posts have snapshots."""
    v = feeds.open_velocities(posts(spark, sf_dir), snapshots(spark, sf_dir))
    return v.where("views > 0").select("narrative_id", F.round("views", 4).alias("views"), F.round("views_velocity", 4).alias("views_velocity"))


@query("SELECT narrative_id, epoch_us(min(posted_at)) // 1000 AS oldest, epoch_us(max(posted_at)) // 1000 AS newest FROM posts GROUP BY narrative_id", "posts")
def member_span(spark, sf_dir):
    """W14."""
    s = narratives.member_span(posts(spark, sf_dir))
    return s.select("narrative_id", values.millis(F.col("oldest")).alias("oldest"), values.millis(F.col("newest")).alias("newest"))


def _cycle(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    seen = s.groupBy("post_id").agg(F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_snapshot_at"))
    return feeds.snapshot_cycle(seen.withColumn("platform", F.when(F.col("post_id") % 2 == 0, "x").otherwise("tt")), s, now(), min_views=100, min_views_tt=100)


CYCLE = f", seen AS (SELECT post_id, min(captured_at) AS first_seen, max(captured_at) AS last_at FROM snaps GROUP BY post_id), t AS (SELECT e.post_id, e.first_seen, e.last_at, s.views, s.views_velocity, row_number() OVER (ORDER BY coalesce(views_velocity, 0) DESC, e.post_id) AS rank, count(*) OVER () AS total FROM seen e LEFT JOIN speed s ON e.post_id = s.post_id), u AS (SELECT *, CASE WHEN rank <= greatest(1, ceil(total * 0.2)) THEN 'hot' WHEN rank <= greatest(1, ceil(total * 0.2), ceil(total * 0.6)) THEN 'warm' ELSE 'cold' END AS tier FROM t), v AS (SELECT tier, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_at)) / 60000000 >= (CASE tier WHEN 'hot' THEN 2 WHEN 'warm' THEN 8 ELSE 20 END) * (CASE WHEN post_id % 2 = 0 THEN 1 ELSE 3 END) AS waited, coalesce(tier = 'cold' AND epoch_us(first_seen) <= epoch_us(TIMESTAMP '{NOW}') - 600000000 AND coalesce(views, 0) < 100 AND views_velocity < 500, false) AS pruned FROM u) SELECT tier, count(*) AS n, count(*) FILTER (WHERE pruned) AS pruned, count(*) FILTER (WHERE waited AND NOT pruned) AS due FROM v GROUP BY tier"


@query(CYCLE, "snaps", "ok", "vel", "speed")
def snapshot_cycle(spark, sf_dir):
    """T14."""
    return _cycle(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("pruned").alias("pruned"), F.count_if("due").alias("due"))


@query(NARRATIVES.replace("SELECT narrative_id, n_posts, round(sum_views", ", last_step AS (SELECT narrative_id, n_posts, round(sum_views") + ") SELECT gate_reason, count(*) AS n FROM last_step GROUP BY gate_reason", "snaps", "ok", "vel", "speed", "posts", "scores")
def gate_counts(spark, sf_dir):
    """A43 by gate."""
    d = narratives.derive(posts(spark, sf_dir), snapshots(spark, sf_dir), scores(spark, sf_dir), now(), min_views=20_000)
    return health.gate_counts(d)


@query("SELECT round(coalesce(sum(value), 0), 4) AS spent, round(coalesce(sum(value), 0) / 0.5, 4) AS projected, coalesce(sum(value), 0) / 0.5 > 1000 AS over FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def spend_projection(spark, sf_dir):
    """Spend of a day so far, carried on."""
    p = health.spend_projection(table(spark, sf_dir, "events"), "ts", "value", F.lit("2024-01-20 12:00:00").cast("timestamp"), 1000)
    return p.select(F.round("spent", 4).alias("spent"), F.round("projected", 4).alias("projected"), "over")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN k * 20 ELSE k END AS reads, round((CASE WHEN event_type = 'error' THEN k * 20 ELSE k END) * 15e-5, 6) AS cost_usd FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def billing_backfill(spark, sf_dir):
    """Requests made posts."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("reads"), F.when(F.col("event_type") == "error", "requests").otherwise("posts").alias("unit"))
    return health.billed(e).select("event_id", "reads", r6("cost_usd"))


@query("SELECT count(*) FILTER (WHERE regexp_matches(text, '\\bthe\\b')) AS tagged, count(*) FILTER (WHERE regexp_matches(text, '\\bthe\\b') AND quality = 1) AS tagged_coined, count(*) FILTER (WHERE NOT regexp_matches(text, '\\bthe\\b')) AS untagged, count(*) FILTER (WHERE NOT regexp_matches(text, '\\bthe\\b') AND quality = 1) AS untagged_coined FROM documents JOIN labels USING (doc_id)")
def tag_metrics(spark, sf_dir):
    """A31 for a common word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    return health.tag_metrics(d.withColumn("coined", F.col("quality") == 1), "text", r"\bthe\b", "coined")


@query("SELECT o_custkey, sum(floor(o_totalprice))::DOUBLE AS balance FROM orders GROUP BY o_custkey")
def balances(spark, sf_dir):
    """A42."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").alias("a"))
    return health.balances(o, "o_custkey", "a").withColumn("balance", F.col("balance").cast("double"))


@query("SELECT lang AS outcome, count(*) AS n, count(*) FILTER (WHERE coined) AS seen, count(*) FILTER (WHERE NOT coined) AS missed, round(quantile_cont(n_chars, 0.25), 6) AS views_p25 FROM rated GROUP BY lang", "rated")
def pipeline_visibility(spark, sf_dir):
    """A49."""
    v = health.visibility(rated(spark, sf_dir), "coined", "lang", "n_chars")
    return v.select(F.col("lang").alias("outcome"), "n", "seen", "missed", r6("views_p25"))


@query("WITH a AS (SELECT l_partkey AS k, max(l_extendedprice / l_quantity) AS ours FROM lineitem GROUP BY 1) SELECT k, round(ours / nullif(p_retailprice, 0), 6) AS ratio, coalesce(abs(ours / nullif(p_retailprice, 0) - 1) <= 0.25, false) AS agrees FROM a JOIN part ON k = p_partkey")
def peak_spot_check(spark, sf_dir):
    """B8."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("ours"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("theirs"))
    return health.peak_check(a, b, "k").select("k", r6("ratio"), "agrees")


@query("SELECT narrative_id, arg_max(meme_score, (views, -post_id))::DOUBLE AS meme_score, max(meme_score)::DOUBLE AS max_score, count(*) AS n FROM posts JOIN scores USING (post_id) GROUP BY narrative_id", "posts", "scores")
def rescored_narratives(spark, sf_dir):
    """B11, A5."""
    return health.rescored(posts(spark, sf_dir).drop("text"), scores(spark, sf_dir))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def purge_by_payload(spark, sf_dir):
    """P20."""
    return health.purge(table(spark, sf_dir, "events"), "props", "$.k", "50").select("event_id")


@query("SELECT metric, value FROM (SELECT (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM posts WHERE first_seen_at >= TIMESTAMP '2024-01-30 21:00:00') AS recent_posts, (SELECT count(*) FROM posts WHERE first_seen_at >= TIMESTAMP '2024-01-30 21:00:00' AND post_id IN (SELECT post_id FROM scores)) AS recent_scored, (SELECT count(DISTINCT narrative_id) FROM posts) AS narratives, (SELECT count(DISTINCT narrative_id) FROM posts WHERE platform = 'x') AS eligible) UNPIVOT (value FOR metric IN (posts, recent_posts, recent_scored, narratives, eligible))", "posts", "scores")
def pipeline_health(spark, sf_dir):
    """Narratives with posts of the first platform stand for eligible ones."""
    p = posts(spark, sf_dir).drop("text")
    n = p.groupBy("narrative_id").agg(F.when(F.bool_or(F.col("platform") == "x"), "eligible").otherwise("no_velocity").alias("gate_reason"))
    return health.pipeline_health(p, scores(spark, sf_dir), n, now())
