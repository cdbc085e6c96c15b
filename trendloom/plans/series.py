"""Queries over engagement series, tiers and narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text, values
from ..operators import narratives, tables, tiering, velocity
from .registry import NOW, now, posts, query, r6, scores, snapshots, table

LIFE = "CASE WHEN coalesce(v, 0) <= 0 AND coalesce(a, 0) <= 0 THEN 'peaking' WHEN (CASE WHEN coalesce(v, 0) > 0 THEN coalesce(a, 0) / v ELSE sign(coalesce(a, 0)) END) > 0.12 AND coalesce(v, 0) > 0 THEN 'heating' WHEN (CASE WHEN coalesce(v, 0) > 0 THEN coalesce(a, 0) / v ELSE sign(coalesce(a, 0)) END) < -0.07 OR coalesce(a, 0) < -500 THEN 'cooling' ELSE 'peaking' END"
LIFECYCLE = LIFE.replace("(v,", "(views_velocity,").replace("/ v ", "/ views_velocity ").replace("(a,", "(views_acceleration,")


def _speed(spark, sf_dir):
    return velocity.velocities(snapshots(spark, sf_dir))


@query(f", tiers AS (SELECT *, row_number() OVER (ORDER BY coalesce(views_velocity, 0) DESC, post_id) AS rank, count(*) OVER () AS total FROM speed) SELECT post_id, total AS n, rank, CASE WHEN rank <= greatest(1, ceil(total * 0.2)) THEN 'hot' WHEN rank <= greatest(1, ceil(total * 0.2), ceil(total * 0.6)) THEN 'warm' ELSE 'cold' END AS tier, views, round(views_velocity, 6) AS views_velocity, round(views_acceleration, 6) AS views_acceleration, {LIFECYCLE} AS lifecycle FROM tiers ORDER BY rank LIMIT 20", "snaps", "ok", "vel", "speed")
def velocity_top(spark, sf_dir):
    """The twenty fastest posts with tier and phase (the flagship; S1, P1, W1, W2, W4, W5, F28, K1)."""
    out = tiering.velocity_report(_speed(spark, sf_dir).drop("n"))
    return out.withColumns({c: F.round(c, 6) for c in ("views_velocity", "views_acceleration")})


@query(f"SELECT post_id, round(views_velocity, 6) AS views_velocity, round(views_acceleration, 6) AS views_acceleration, round(engagement_velocity, 6) AS engagement_velocity, {LIFECYCLE} AS lifecycle FROM speed", "snaps", "ok", "vel", "speed")
def velocities(spark, sf_dir):
    """W2, W3, W4, F28 for every post."""
    return _speed(spark, sf_dir).select("post_id", r6("views_velocity"), r6("views_acceleration"), r6("engagement_velocity"), "lifecycle")


@query("SELECT post_id, id, views, likes FROM ok WHERE r = 1", "snaps", "ok")
def latest_snapshot(spark, sf_dir):
    return velocity.latest_snapshots(snapshots(spark, sf_dir)).select("post_id", "id", "views", "likes")


@query(", tiers AS (SELECT *, row_number() OVER (ORDER BY coalesce(views_velocity, 0) DESC, post_id) AS rank, count(*) OVER () AS total FROM speed) SELECT post_id, CASE WHEN rank <= greatest(1, ceil(total * 0.2)) THEN 'hot' WHEN rank <= greatest(1, ceil(total * 0.2), ceil(total * 0.6)) THEN 'warm' ELSE 'cold' END AS tier FROM tiers", "snaps", "ok", "vel", "speed")
def tiering_all(spark, sf_dir):
    """W5 for every post."""
    return tiering.assign_tiers(_speed(spark, sf_dir).drop("n")).select("post_id", "tier")


def _tracked(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    seen = s.groupBy("post_id").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_at"))
    tiers = tiering.assign_tiers(_speed(spark, sf_dir).drop("n"))
    return tiers.join(seen, "post_id").withColumn("platform", F.when(F.col("post_id") % 2 == 0, "x").otherwise("tt"))


TRACKED = ", tiers AS (SELECT *, row_number() OVER (ORDER BY coalesce(views_velocity, 0) DESC, post_id) AS rank, count(*) OVER () AS total FROM speed), seen AS (SELECT post_id, min(captured_at) AS first_seen, max(captured_at) AS last_at FROM snaps GROUP BY post_id), tracked AS (SELECT t.*, s.first_seen, s.last_at, CASE WHEN t.post_id % 2 = 0 THEN 'x' ELSE 'tt' END AS platform, CASE WHEN rank <= greatest(1, ceil(total * 0.2)) THEN 'hot' WHEN rank <= greatest(1, ceil(total * 0.2), ceil(total * 0.6)) THEN 'warm' ELSE 'cold' END AS tier FROM tiers t JOIN seen s ON t.post_id = s.post_id) "


@query(TRACKED + "SELECT post_id, tier, (epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(last_at)) / 60000000 >= (CASE tier WHEN 'hot' THEN 2 WHEN 'warm' THEN 8 ELSE 20 END) * (CASE platform WHEN 'tt' THEN 3 ELSE 1 END) AS due FROM tracked", "snaps", "ok", "vel", "speed")
def due_for_snapshot(spark, sf_dir):
    """P14 at a fixed time."""
    at = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return _tracked(spark, sf_dir).select("post_id", "tier", tiering.due(F.col("tier"), F.col("platform"), F.col("last_at"), at).alias("due"))


@query(TRACKED + f"SELECT post_id, coalesce(tier = 'cold' AND epoch_us(first_seen) <= epoch_us(TIMESTAMP '{NOW}') - 600000000 AND views < 100 AND views_velocity < 500, false) AS pruned FROM tracked", "snaps", "ok", "vel", "speed")
def cold_prune(spark, sf_dir):
    """P15; posts of unknown velocity stay."""
    t = _tracked(spark, sf_dir)
    return t.select("post_id", tiering.prunable(F.col("tier"), F.col("first_seen"), F.col("views"), F.col("views_velocity"), F.col("platform"), now(), min_views=100, min_views_tt=100).alias("pruned"))


@query("SELECT event_type, date_trunc('hour', captured_at) AS bucket, round(sum(views), 4) AS views FROM snaps WHERE NOT unavailable GROUP BY ALL", "snaps")
def hourly_series(spark, sf_dir):
    """Every snapshot counts."""
    b = velocity.bucket_series(snapshots(spark, sf_dir), "event_type")
    return b.select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("views", 4).alias("views"))


@query(", h AS (SELECT event_type, date_trunc('hour', captured_at) AS bucket, post_id, max_by(views, (captured_at, id)) AS v FROM snaps WHERE NOT unavailable GROUP BY ALL) SELECT event_type, bucket, round(sum(v), 4) AS views FROM h GROUP BY ALL", "snaps")
def hourly_latest_series(spark, sf_dir):
    """T2 without double counting."""
    b = velocity.bucket_series(snapshots(spark, sf_dir), "event_type", latest_only=True)
    return b.select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("views", 4).alias("views"))


SERIES = ", b AS (SELECT post_id, date_trunc('hour', captured_at) AS bucket, sum(views) AS v FROM snaps WHERE NOT unavailable GROUP BY ALL), s AS (SELECT post_id, list(v ORDER BY bucket) AS s FROM b GROUP BY post_id) "


@query(SERIES + "SELECT post_id, len(s) AS n, round(greatest(0, s[len(s)] - s[greatest(0, len(s) - 25) + 1]), 4) AS gain FROM s", "snaps")
def gain_24_buckets(spark, sf_dir):
    """W10."""
    s = velocity.series_arrays(velocity.bucket_series(snapshots(spark, sf_dir), "post_id"), "post_id")
    return s.select("post_id", F.size("series").cast("long").alias("n"), F.round(velocity.gain_24(F.col("series")), 4).alias("gain"))


@query(SERIES + ", x AS (SELECT post_id, s, len(s) AS n FROM s), y AS (SELECT post_id, n, (s[n] - s[n - 3]) / greatest(s[n - 3], 1) AS slope, (s[n // 2 + 1] - s[1]) / greatest(s[1], 1) AS mid, (s[n] - s[n - greatest(2, n // 3) + 1]) / (greatest(2, n // 3) - 1) AS tail FROM x) SELECT post_id, CASE WHEN n < 4 THEN 'peaking' WHEN slope > 0.12 AND mid < 0.45 THEN 'heating' WHEN slope < -0.07 THEN 'cooling' ELSE 'peaking' END AS lifecycle, CASE WHEN n < 3 THEN 'flat' WHEN tail > 1.5 THEN 'rising' WHEN tail < -1.5 THEN 'falling' ELSE 'flat' END AS direction FROM y", "snaps")
def series_lifecycle(spark, sf_dir):
    """W11, W12."""
    s = velocity.series_arrays(velocity.bucket_series(snapshots(spark, sf_dir), "post_id"), "post_id")
    return s.select("post_id", velocity.lifecycle_of_series(F.col("series")).alias("lifecycle"), velocity.tail_direction(F.col("series")).alias("direction"))


@query(", l AS (SELECT *, CASE WHEN event_type = 'signup' THEN NULL ELSE views END AS v, row_number() OVER (PARTITION BY post_id ORDER BY captured_at DESC, id DESC) AS q FROM snaps WHERE NOT unavailable) SELECT count(*) AS checked, count(*) FILTER (WHERE v IS NULL) AS missing, round(count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*), 6) AS pct FROM l WHERE q = 1", "snaps")
def missing_views_share(spark, sf_dir):
    """A17; signups stand for snapshots without views."""
    s = snapshots(spark, sf_dir).withColumn("views", F.when(F.col("event_type") != "signup", F.col("views")))
    return velocity.missing_views(s).withColumn("pct", F.round("pct", 6))


@query(", p AS (SELECT post_id, min(likes) AS low, max(likes) AS high, count(*) AS n FROM snaps WHERE NOT unavailable GROUP BY post_id HAVING count(*) >= 2) SELECT count(*) AS checked, count(*) FILTER (WHERE low = high) AS flat, count(*) >= 3 AND count(*) FILTER (WHERE low = high) >= 0.8 * count(*) AS unreliable FROM p", "snaps")
def flat_view_diagnostic(spark, sf_dir):
    """A18 over a count that changes seldom."""
    return velocity.flat_views(snapshots(spark, sf_dir).withColumn("views", F.col("likes")))


@query(", a AS (SELECT s.post_id, s.id, s.views, epoch_us(s.captured_at) AS us, epoch_us(p.t0) AS t0 FROM snaps s JOIN (SELECT post_id, min(captured_at) AS t0 FROM snaps GROUP BY post_id) p ON s.post_id = p.post_id WHERE epoch_us(s.captured_at) BETWEEN epoch_us(p.t0) AND epoch_us(p.t0) + 2880::BIGINT * 60000000), g AS (SELECT post_id, list({'us': us, 'id': id, 'v': views} ORDER BY us, id) AS s, count(*) AS n FROM a GROUP BY post_id) SELECT post_id, n AS n_snapshots, s[n].v AS views_at_t, round(CASE WHEN n < 2 THEN s[n].v / 2880 ELSE (s[n].v - s[1].v) / greatest(1, (s[n].us - s[1].us) / 60000000) END, 6) AS view_velocity_t, round(CASE WHEN n >= 3 THEN (s[n].v - s[n // 2 + 1].v) / greatest(1, (s[n].us - s[n // 2 + 1].us) / 60000000) - (s[n // 2 + 1].v - s[1].v) / greatest(1, (s[n // 2 + 1].us - s[1].us) / 60000000) END, 6) AS acceleration_t FROM g", "snaps")
def early_window_features(spark, sf_dir):
    """Features as of two days after each post's first snapshot."""
    s = snapshots(spark, sf_dir)
    p = s.groupBy("post_id").agg(F.min("captured_at").alias("posted_at"))
    out = velocity.early_features(p, s, window_min=2880)
    return out.select("post_id", "n_snapshots", "views_at_t", r6("view_velocity_t"), r6("acceleration_t"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_seen FROM events")
def monotone_views(spark, sf_dir):
    """W16."""
    return velocity.monotone(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value").select("event_id", "value_seen")


@query("SELECT event_type, count(*) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events GROUP BY event_type")
def value_distribution(spark, sf_dir):
    """A13, A14, A15."""
    from ..operators.reports import distribution

    d = distribution(table(spark, sf_dir, "events"), ["event_type"], "value")
    return d.select("event_type", "n", "min", r6("p25"), r6("median"), r6("p75"), "max")


AUTHORS = f", per AS (SELECT narrative_id, lower(regexp_replace(handle, '^@', '')) AS h, min(first_seen_at) AS first FROM posts WHERE handle <> '' GROUP BY ALL) SELECT narrative_id, count(*) AS distinct_authors, count(*) FILTER (WHERE first >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS new_authors FROM per GROUP BY narrative_id"


@query(AUTHORS.replace("narrative_id", "platform"), "posts")
def distinct_authors(spark, sf_dir):
    """A7, A8 by platform."""
    return narratives.author_counts(posts(spark, sf_dir), now(), group="platform")


@query(f", u AS (SELECT DISTINCT likes, lower(handle) AS h FROM posts WHERE platform = 'tt' AND first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 1200 MINUTES) SELECT likes::VARCHAR AS sound_id, count(*) AS creators, round(count(*) / 20, 6) AS per_hour FROM u GROUP BY likes", "posts")
def sound_creators(spark, sf_dir):
    """A9 with likes in the place of sounds."""
    p = posts(spark, sf_dir).withColumn("sound_id", F.col("likes").cast("string"))
    return narratives.sound_authors(p, now(), window_min=1200).withColumn("per_hour", F.round("per_hour", 6))


@query("SELECT narrative_id, sum(views)::BIGINT AS views, round(sum(likes + 2 * retweets + replies) / sum(views), 6) AS rate, coalesce(sum(views) >= 10000 AND sum(likes + 2 * retweets + replies) / sum(views) < 0.02, false) AS bought FROM posts GROUP BY narrative_id", "posts")
def group_engagement_rate(spark, sf_dir):
    """A4, F27, F31."""
    p = posts(spark, sf_dir)
    e = values.engagement(F.col("likes"), F.col("retweets"), F.col("replies"))
    g = p.groupBy("narrative_id").agg(F.sum("views").alias("views"), F.sum(e).alias("e"))
    rate = F.try_divide("e", F.nullif("views", F.lit(0)))
    return g.select("narrative_id", "views", F.round(rate, 6).alias("rate"), gates.bought_reach(F.col("views"), rate, 0.02).alias("bought"))


NARRATIVES = f""", last AS (SELECT post_id, views FROM ok WHERE r = 1), lm AS (SELECT post_id, likes, retweets, replies FROM ok WHERE r = 1),
m AS (SELECT p.narrative_id, p.post_id, p.platform, p.handle, p.posted_at, p.first_seen_at, coalesce(l.views, p.views) AS views, coalesce(lm.likes, p.likes) AS likes, coalesce(lm.retweets, p.retweets) AS retweets, coalesce(lm.replies, p.replies) AS replies, sp.views_velocity AS vv, sp.views_acceleration AS va, coalesce(sc.meme_score, 0)::DOUBLE AS meme
  FROM posts p LEFT JOIN last l ON p.post_id = l.post_id LEFT JOIN lm ON p.post_id = lm.post_id LEFT JOIN speed sp ON p.post_id = sp.post_id LEFT JOIN scores sc ON p.post_id = sc.post_id),
g AS (SELECT narrative_id, count(*) AS n_posts, sum(views) AS sum_views, sum(likes + 2 * retweets + replies) AS sum_eng, coalesce(sum(vv), 0) AS vv, coalesce(sum(va), 0) AS accel, max_by(meme, (views, -post_id)) AS meme_score, max(meme) AS max_meme_score, avg(meme) AS avg_meme, max_by(post_id, (views, -post_id)) AS top_post_id, bool_or(platform = 'x') AS hx, bool_or(platform = 'tt') AS ht, count(DISTINCT platform) AS np, min(posted_at) AS oldest, max(posted_at) AS newest,
  count(DISTINCT lower(handle)) AS distinct_authors FROM m GROUP BY narrative_id),
f AS (SELECT narrative_id, count(*) FILTER (WHERE first >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS fresh FROM (SELECT narrative_id, lower(handle) AS h, min(first_seen_at) AS first FROM posts GROUP BY ALL) GROUP BY narrative_id),
bk AS (SELECT p.narrative_id, date_trunc('hour', s.captured_at) AS bucket, sum(s.views) AS v FROM snaps s JOIN posts p ON s.post_id = p.post_id WHERE NOT s.unavailable GROUP BY ALL),
sr AS (SELECT narrative_id, list(v ORDER BY bucket) AS s FROM bk GROUP BY narrative_id),
d AS (SELECT g.*, f.fresh, coalesce(CASE WHEN len(s) > 0 THEN greatest(0, s[len(s)] - s[greatest(0, len(s) - 25) + 1]) END, 0) AS gain, CASE WHEN hx AND ht AND vv > 0 THEN floor(vv * 1.2 + 0.5) ELSE vv END AS velocity, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(newest)) / 60000 AS newest_age FROM g JOIN f ON g.narrative_id = f.narrative_id LEFT JOIN sr ON g.narrative_id = sr.narrative_id)
SELECT narrative_id, n_posts, round(sum_views, 2) AS combined_views, round(velocity, 4) AS views_velocity, round(meme_score, 6) AS meme_score, max_meme_score, top_post_id, hx AND ht AS cross_platform, round(gain, 4) AS gain_24h, distinct_authors, fresh::DOUBLE AS author_velocity,
  CASE WHEN newest_age > (CASE WHEN ht AND NOT hx THEN 4320 ELSE 720 END) THEN 'too_old' WHEN sum_views < 20000 THEN 'below_views' WHEN meme_score < (CASE WHEN hx AND ht THEN 0.6 WHEN ht THEN 0.75 ELSE 0.7 END) THEN 'low_meme' WHEN ht AND NOT hx AND (distinct_authors >= 2 OR fresh > 0) AND NOT velocity > 0 THEN 'eligible' WHEN NOT (velocity > 0 OR (fresh > 0 AND distinct_authors >= 3)) THEN 'no_velocity' ELSE 'eligible' END AS gate_reason,
  floor(least(100.0, avg_meme * 45 + least(np, 4) * 8 + least(n_posts, 12) * 4 + least(gain / 50000, 1.0) * 25 + (CASE WHEN hx AND ht THEN 25 ELSE 0 END) + least(fresh / 10, 1.0) * 30) + 0.5)::BIGINT AS organic_score FROM d"""


@query(NARRATIVES, "snaps", "ok", "vel", "speed", "posts", "scores")
def narrative_rollup(spark, sf_dir):
    """C2-C4, A2-A6, A10, F30, F33, F34 for every narrative (a source)."""
    d = narratives.derive(posts(spark, sf_dir), snapshots(spark, sf_dir), scores(spark, sf_dir), now(), min_views=20_000)
    return d.select("narrative_id", "n_posts", F.round("combined_views", 2).alias("combined_views"), F.round("views_velocity", 4).alias("views_velocity"), r6("meme_score"), "max_meme_score", "top_post_id", "cross_platform", F.round("gain_24h", 4).alias("gain_24h"), "distinct_authors", "author_velocity", "gate_reason", "organic_score")


@query(f"SELECT post_id, narrative_id, CASE WHEN platform = 'tt' THEN 0.75 ELSE 0.7 END AS least FROM posts JOIN scores USING (post_id) WHERE meme_score >= (CASE WHEN platform = 'tt' THEN 0.75 ELSE 0.7 END) AND (epoch_ms(TIMESTAMP '{NOW}') - epoch_us(posted_at) // 1000) / 60000 <= (CASE WHEN platform = 'tt' THEN 4320 ELSE 720 END) ORDER BY views DESC, post_id LIMIT 80", "posts", "scores")
def viral_feed(spark, sf_dir):
    """The feed's eligible posts, most viewed first, eighty of them."""
    p = posts(spark, sf_dir).drop("text").join(scores(spark, sf_dir), "post_id")
    age = values.age_minutes(values.millis(F.col("posted_at")), values.millis(now()))
    ok = gates.feed_eligible(F.col("platform"), age, F.col("meme_score"), F.col("views"))
    return p.where(ok).orderBy(F.col("views").desc(), "post_id").limit(80).select("post_id", "narrative_id", F.when(F.col("platform") == "tt", 0.75).otherwise(0.7).alias("least"))


@query("SELECT platform, count(*) AS total, count(*) FILTER (WHERE views >= 300) AS floor, count(*) FILTER (WHERE views >= 300 AND meme_score IS NOT NULL) AS scored, count(*) FILTER (WHERE views >= 300 AND meme_score >= (CASE WHEN platform = 'tt' THEN 0.75 ELSE 0.7 END)) AS passed FROM posts LEFT JOIN scores USING (post_id) GROUP BY platform", "posts", "scores")
def funnel_counts(spark, sf_dir):
    """A43, P6."""
    from ..operators.budget import funnel

    p = posts(spark, sf_dir).select("post_id", "platform", "views").join(scores(spark, sf_dir), "post_id", "left")
    least = F.when(F.col("platform") == "tt", 0.75).otherwise(0.7)
    return funnel(p, ["platform"], {"floor": F.col("views") >= 300, "scored": F.col("meme_score").isNotNull(), "passed": F.col("meme_score") >= least})


@query(f"SELECT narrative_id, CASE WHEN (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(max(posted_at))) / 60000 > (CASE WHEN bool_or(platform = 'tt') AND NOT bool_or(platform = 'x') THEN 4320 ELSE 720 END) THEN 'aged_out' END AS closing FROM posts GROUP BY narrative_id UNION ALL SELECT 'none', 'empty'", "posts")
def narrative_closing(spark, sf_dir):
    """T13, C5; one narrative has no members."""
    p = posts(spark, sf_dir).drop("text")
    every = p.select("narrative_id").distinct().union(spark.createDataFrame([("none",)], "narrative_id string"))
    return narratives.closing_reason(every, p, now())


@query("SELECT post_id, narrative_id, row_number() OVER (PARTITION BY narrative_id ORDER BY views DESC, post_id) AS rank FROM posts QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY views DESC, post_id) <= 3", "posts")
def top_posts(spark, sf_dir):
    """K15."""
    return tables.top_k(posts(spark, sf_dir).drop("text"), ["narrative_id"], [F.col("views").desc(), F.col("post_id")], 3).select("post_id", "narrative_id", "rank")


@query("SELECT narrative_id, median((epoch_us(first_seen_at) - epoch_us(posted_at)) / 60000000) AS median_latency, round(quantile_cont(views, 0.9), 6) AS p90_views FROM posts GROUP BY narrative_id", "posts")
def eligibility_latency(spark, sf_dir):
    """Median minutes from posting to first sight, and the ninetieth percentile of views."""
    m = (values.micros(F.col("first_seen_at")) - values.micros(F.col("posted_at"))) / 60_000_000
    return posts(spark, sf_dir).groupBy("narrative_id").agg(F.median(m).alias("median_latency"), F.round(F.percentile("views", F.lit(0.9)), 6).alias("p90_views"))


@query("SELECT post_id, round(coalesce(views_velocity, CASE WHEN views >= 100 THEN views / 1000 END), 6) AS urgency FROM speed WHERE views_velocity IS NOT NULL OR views >= 100 ORDER BY urgency DESC, post_id LIMIT 10", "snaps", "ok", "vel", "speed")
def score_queue(spark, sf_dir):
    """K1: the next ten posts to score."""
    s = _speed(spark, sf_dir).withColumn("fast_lane", F.col("views") >= 100)
    return tiering.score_batch(s).select("post_id", r6("urgency"))


@query("SELECT post_id, narrative_id, platform, 'c-' || trim(regexp_replace(lower(narrative_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM posts", "posts")
def narrative_slugs(spark, sf_dir):
    """F8 over narrative names."""
    return posts(spark, sf_dir).select("post_id", "narrative_id", "platform", F.concat(F.lit("c-"), text.slugify(F.col("narrative_id"))).alias("slug"))
