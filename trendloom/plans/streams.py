"""Queries that replay the events table as a stream; each has the result of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming import pipelines, stateful
from .registry import query, r6, table
from .texts import SHARDS, shard_posts


def _stream(spark, sf_dir):
    """events as a stream, with ts as a timestamp."""
    rows = pipelines.source(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, round(sum(value), 4) AS views, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """T2 as a stream: the last state of each window."""
    folder = pipelines.new_folder(spark, "hourly")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(folder)

    pipelines.replayed(pipelines.window_sums(_stream(spark, sf_dir), ["event_type"], "ts", "value"), write, "hourly", "complete")
    return spark.read.parquet(folder).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.round("views", 4).alias("views"), "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    """T5 as a stream."""
    out = pipelines.replayed(pipelines.first_sight(_stream(spark, sf_dir).select("user_id", "ts"), "user_id", "ts", "60 days"), None, "dedup")
    return spark.read.schema("user_id long").parquet(out)


@query("SELECT event_id FROM events WHERE ts >= (TIMESTAMP '2024-01-15' + to_minutes(0)) - INTERVAL 360 MINUTE")
def stream_on_time(spark, sf_dir):
    """T4 as a stream; all rows arrive at one time here."""
    rows = _stream(spark, sf_dir).withColumn("arrived", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    out = pipelines.replayed(pipelines.on_time(rows, "ts", "arrived").select("event_id"), None, "on-time")
    return spark.read.schema("event_id long").parquet(out)


@query("WITH k AS (SELECT user_id AS id, max(event_id) AS version, round(max(value), 2) AS views, max_by(event_type, event_id) <> 'error' AS eligible FROM events GROUP BY user_id) SELECT id, version, views FROM k WHERE eligible ORDER BY views DESC, id LIMIT 80")
def stream_feed(spark, sf_dir):
    """T12, T1, S26 as a stream: a merged, bounded feed."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("value").alias("views"), (F.col("event_type") != "error").alias("eligible"))
    folder = pipelines.new_folder(spark, "feed")
    pipelines.replayed(rows, pipelines.feed_sink(folder), "feed")
    return pipelines.latest_feed(spark, folder).select("id", "version", "views")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 12 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, k")
def activity_spells(spark, sf_dir):
    """Session windows over the finished table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = pipelines.active_spells(e, "user_id", "ts")
    return s.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("closed").cast("timestamp_ntz").alias("closed"), "n")


# Each cycle's posts follow one another; narratives from the first cycle go by their ids and by all members' centroid, those
# of the same cycle by their opening and their first post.
@query(
    f"WITH RECURSIVE {SHARDS}, p AS MATERIALIZED (SELECT shard, id, handle, turn % 2 AS cycle, row_number() OVER (PARTITION BY shard ORDER BY turn % 2, score DESC, id) AS pos FROM z), "
    "g(shard, pos, id, handle, cycle, n, reason, score) USING KEY (shard, pos) AS (SELECT shard, pos, id, handle, cycle, id, 'new', 0.0::DOUBLE FROM p WHERE pos = 1 UNION ALL "
    "(WITH q AS (SELECT p.* FROM p JOIN g ON p.shard = g.shard AND p.pos = g.pos + 1), "
    "w AS (SELECT x.shard, x.n, sqrt(sum(dot)) AS norm FROM recurring.g x JOIN recurring.g y ON x.shard = y.shard AND x.n = y.n JOIN pr ON pr.a = x.id AND pr.b = y.id GROUP BY ALL), "
    "m AS (SELECT q.shard, q.pos, q.cycle, x.n, max(overlap) FILTER (WHERE overlap >= 0.12) AS o, max(dot) FILTER (WHERE x.id = x.n) AS own, sum(dot) AS every, min(x.cycle) AS opened, min(x.pos) AS first "
    "FROM q JOIN recurring.g x ON x.shard = q.shard LEFT JOIN pr ON pr.a = q.id AND pr.b = x.id GROUP BY ALL HAVING NOT bool_or(x.handle = q.handle)), "
    "v AS (SELECT m.shard, m.pos, m.n, o, CASE WHEN opened < cycle THEN every / norm ELSE own END AS c, opened = cycle AS fresh, CASE WHEN opened < cycle THEN m.n ELSE first END AS ord FROM m LEFT JOIN w ON w.shard = m.shard AND w.n = m.n), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY shard, pos ORDER BY o IS NULL, CASE WHEN o IS NULL THEN -round(c, 12) END, fresh, ord) AS r FROM v WHERE o IS NOT NULL OR c >= 0.3) "
    "SELECT q.shard, q.pos, q.id, q.handle, q.cycle, coalesce(h.n, q.id), CASE WHEN h.o IS NOT NULL THEN 'keyword' WHEN h.c IS NOT NULL THEN 'embedding' ELSE 'new' END, coalesce(h.o, h.c, 0.0) FROM q LEFT JOIN h ON h.shard = q.shard AND h.pos = q.pos AND h.r = 1)) "
    "SELECT shard, id AS post_id, cycle, n AS narrative_id, reason, round(score, 6) AS score FROM g")
def stream_narratives(spark, sf_dir):
    """C1, C5 over two cycles as a stream: even turns come first, then the stream is started again for the odd ones."""
    posts = shard_posts(spark, sf_dir).withColumn("at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("turn") % 2).cast("int")))
    folder, out, marks = (new_folder(spark, f"narratives-{x}") for x in ("in", "out", "marks"))
    for cycle in (0, 1):
        posts.where(F.col("turn") % 2 == cycle).write.mode("append").parquet(folder)
        rows = pipelines.source(spark, folder, posts.schema)
        pipelines.replayed(stateful.narratives(rows, "shard", keyword=0.12, cosine=0.3), None, "narratives", out=out, marks=marks)
    found = spark.read.schema("shard string, at timestamp, post_id long, narrative_id long, reason string, score double").parquet(out)
    return found.select("shard", "post_id", F.hour("at").cast("long").alias("cycle"), "narrative_id", "reason", r6("score"))


@query("SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id), 4) AS hour_spent, round(sum(value) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id), 4) AS day_spent, "
       "CASE WHEN round(sum(value) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id), 4) > 3000.00001 THEN 'day' WHEN round(sum(value) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id), 4) > 300.00001 THEN 'hour' END AS blocked FROM events")
def stream_ledger(spark, sf_dir):
    """T8 as a stream: what each kind of event has spent in its hour and day, and which limit that breaks."""
    rows = _stream(spark, sf_dir).select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.col("value").alias("amount"))
    out = pipelines.replayed(stateful.spend_ledger(rows, ["event_type"], 300.00001, 3000.00001), None, "ledger")
    found = spark.read.schema("event_type string, at timestamp, tie long, hour_spent double, day_spent double, blocked string").parquet(out)
    return found.select(F.col("tie").alias("event_id"), "event_type", F.round("hour_spent", 4).alias("hour_spent"), F.round("day_spent", 4).alias("day_spent"), "blocked")


# An hour is silent if it lies wholly between two rows of a spell, or between its last row and the row that ends it or the end of the log.
@query(
    "WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS t, CAST(json_extract(props, '$.k') AS BIGINT) % 10 < 8 AS low FROM events), s AS (SELECT *, count(*) FILTER (WHERE NOT low) OVER (PARTITION BY event_type ORDER BY t, event_id) AS g FROM e), "
    "f AS (SELECT *, min(t) FILTER (WHERE low) OVER (PARTITION BY event_type, g ORDER BY t, event_id) AS since FROM s), "
    "n AS (SELECT *, CASE WHEN low THEN floor((t - since - 7200000) / 3600000)::BIGINT END AS step FROM f), "
    "p AS (SELECT *, lag(step) OVER w AS was, lead(t) OVER v AS until FROM n WINDOW w AS (PARTITION BY event_type, g ORDER BY t, event_id), v AS (PARTITION BY event_type ORDER BY t, event_id)), "
    "q AS (SELECT event_type, since, generate_series(greatest(step, -1) + 1, floor((coalesce(until, (SELECT max(t) FROM e)) - since - 7200000) / 3600000)::BIGINT - 1) AS ks FROM p WHERE low) "
    "SELECT event_type, make_timestamp(t * 1000) AS at, 'row' AS kind FROM p WHERE step >= 0 AND step > coalesce(was, -1) "
    "UNION ALL SELECT event_type, make_timestamp((since + 7200000 + (k + 1) * 3600000) * 1000), 'silent' FROM (SELECT event_type, since, unnest(ks) AS k FROM q)")
def stream_alarms(spark, sf_dir):
    """T10 as a stream: hourly alarms of low spells of each kind of event, also for hours in which nothing came."""
    low = (F.get_json_object("props", "$.k").cast("long") % 10) / 10.0
    rows = _stream(spark, sf_dir).select("event_type", F.col("ts").alias("at"), F.col("event_id").alias("tie"), low.alias("share"))
    out = pipelines.replayed(stateful.underused_alarms(rows, ["event_type"], least=0.75), None, "alarms")
    found = spark.read.schema("event_type string, at timestamp, kind string").parquet(out)
    return found.select("event_type", F.date_trunc("millisecond", "at").cast("timestamp_ntz").alias("at"), "kind")


@query(
    "WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY h0) AS k FROM (SELECT lane, h0, list({'v': views, 't': term} ORDER BY views DESC, term) AS terms FROM (SELECT event_type AS lane, date_trunc('hour', ts) AS h0, 'u' || (user_id % 20)::VARCHAR AS term, max(floor(value))::BIGINT AS views FROM events GROUP BY ALL) GROUP BY ALL)), "
    "r(lane, k, h0, picks, fetched, used) AS (SELECT DISTINCT lane, 0::BIGINT, TIMESTAMP '1970-01-01', []::STRUCT(v BIGINT, t VARCHAR)[], []::STRUCT(h TIMESTAMP, t VARCHAR)[], 0::BIGINT FROM c UNION ALL "
    "SELECT lane, k, h0, picks, list_concat(fresh, list_transform(picks, lambda x: {'h': h0, 't': x.t})), used + len(picks) FROM (SELECT *, list_filter(terms, lambda x: NOT list_contains(known, x.t))[1:greatest(0, least(2, 20 - used))] AS picks FROM "
    "(SELECT *, list_transform(fresh, lambda x: x.t) AS known FROM (SELECT c.lane, c.k, c.h0, c.terms, list_filter(r.fetched, lambda x: x.h >= c.h0 - INTERVAL 5 HOUR) AS fresh, CASE WHEN c.h0::DATE = r.h0::DATE THEN r.used ELSE 0 END AS used FROM r JOIN c ON c.lane = r.lane AND c.k = r.k + 1)))) "
    "SELECT lane AS event_type, h0 AS \"at\", x.t AS term, x.v AS views FROM (SELECT lane, h0, unnest(picks) AS x FROM r)")
def stream_trends(spark, sf_dir):
    """T15, K14 as a stream: the terms that each hour looks up, two at most and twenty a day, none again within five hours."""
    rows = _stream(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").alias("at"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("term"), F.floor("value").alias("views"))
    out = pipelines.replayed(stateful.trend_requests(rows, "event_type", 300, 2, 20), None, "trends")
    found = spark.read.schema("event_type string, at timestamp, term string, views long").parquet(out)
    return found.select("event_type", F.col("at").cast("timestamp_ntz").alias("at"), "term", "views")
