"""The queries of the driver contract: registered functions, their SQL, and the bindings of logical inputs to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The clock of all queries: after the last event and posting.
NOW = "2024-01-31 00:00:00"

#: The same bindings in SQL, for the oracles.
CTE = {
    "snaps": "snaps AS (SELECT user_id AS post_id, event_id AS id, ts AS captured_at, value AS views, CAST(json_extract(props, '$.k') AS BIGINT) AS likes, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS retweets, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS replies, event_type = 'error' AS unavailable, event_type FROM events)",
    "ok": "ok AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at DESC, id DESC) AS r FROM snaps WHERE NOT unavailable)",
    "vel": "vel AS (SELECT post_id, count(*) AS n, max(CASE WHEN r = 1 THEN views END) AS views, "
    "max(CASE WHEN r = 1 THEN epoch_us(captured_at) END) AS t1, max(CASE WHEN r = 2 THEN epoch_us(captured_at) END) AS t2, max(CASE WHEN r = 3 THEN epoch_us(captured_at) END) AS t3, "
    "max(CASE WHEN r = 1 THEN views END) AS v1, max(CASE WHEN r = 2 THEN views END) AS v2, max(CASE WHEN r = 3 THEN views END) AS v3, "
    "max(CASE WHEN r = 1 THEN likes + 2 * retweets + replies END) AS e1, max(CASE WHEN r = 2 THEN likes + 2 * retweets + replies END) AS e2 FROM ok WHERE r <= 3 GROUP BY post_id)",
    "speed": "speed AS (SELECT post_id, n, views, CASE WHEN t1 > t2 THEN (v1 - v2) / ((t1 - t2) / 60000000) END AS views_velocity, "
    "CASE WHEN t1 > t2 AND t2 > t3 THEN (v1 - v2) / ((t1 - t2) / 60000000) - (v2 - v3) / ((t2 - t3) / 60000000) END AS views_acceleration, "
    "CASE WHEN t1 > t2 THEN (e1 - e2) / ((t1 - t2) / 60000000) END AS engagement_velocity FROM vel)",
    "posts": "posts AS (SELECT doc_id AS post_id, source AS narrative_id, source AS handle, CASE lang WHEN 'en' THEN 'x' ELSE 'tt' END AS platform, text, n_chars AS views, n_chars % 100 AS likes, n_chars % 7 AS retweets, n_chars % 3 AS replies, "
    "TIMESTAMP '2024-01-30 00:00:00' + to_minutes(doc_id % 1400) AS posted_at, TIMESTAMP '2024-01-30 00:05:00' + to_minutes(doc_id % 1400) AS first_seen_at FROM documents)",
    "scores": "scores AS (SELECT doc_id AS post_id, CASE WHEN quality = 1 THEN 0.8 ELSE 0.4 END AS meme_score, toxic FROM labels)",
    "trades": "trades AS (SELECT l_partkey AS mint, l_suppkey AS wallet, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS id, l_quantity AS amount, l_extendedprice AS usd, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_linestatus AS venue FROM lineitem)",
    "rated": "rated AS (SELECT d.doc_id AS id, (d.n_chars % 100) / 100 AS score, l.quality = 1 AS coined, d.lang, d.source, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)",
}


def query(sql: str | None = None, *ctes: str):
    """Register a function under its name, with its oracle; ctes are bindings that the SQL reads."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(CTE[c] for c in ctes) + " " if ctes else "") + sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as snapshots of posts: a user is a post, errors are unavailable ones."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("post_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("value").alias("views"),
        k.alias("likes"), (k % 7).alias("retweets"), (k % 3).alias("replies"), (F.col("event_type") == "error").alias("unavailable"), "event_type")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts; a source is a handle and a narrative."""
    minute = F.make_dt_interval(mins=(F.col("doc_id") % 1400).cast("int"))
    at = F.lit("2024-01-30 00:00:00").cast("timestamp")
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("source").alias("narrative_id"), F.col("source").alias("handle"), F.when(F.col("lang") == "en", "x").otherwise("tt").alias("platform"), "text",
        n.alias("views"), (n % 100).alias("likes"), (n % 7).alias("retweets"), (n % 3).alias("replies"), (at + minute).alias("posted_at"), (at + F.expr("INTERVAL 5 MINUTES") + minute).alias("first_seen_at"), F.lit(None).cast("string").alias("sound_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("post_id"), F.when(F.col("quality") == 1, 0.8).otherwise(0.4).alias("meme_score"), "toxic", F.lit(None).cast("string").alias("suggested_ticker"), F.lit(None).cast("string").alias("suggested_name"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: a part is a token, a supplier a wallet, returns are sales."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("wallet"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("amount"),
        F.col("l_extendedprice").alias("usd"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_linestatus").alias("venue"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score in 0 ... 0.99 and whether they are labelled good."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100).alias("score"), (F.col("quality") == 1).alias("coined"), "lang", "source", "n_chars")


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)
