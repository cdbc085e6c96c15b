"""Diagnostics: pipeline health, coverage, spend, and the lab's composite reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pipeline_health(posts: DataFrame, scores: DataFrame, narratives: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    """(metric, value): posts and recent ones, scored share, open and eligible narratives (S4, J4, diagnostics)."""
    recent = F.col("first_seen_at").cast("timestamp") >= now - F.expr(f"INTERVAL {hours} HOURS")
    marked = posts.select("post_id", "first_seen_at").join(scores.select("post_id", F.lit(1).alias("scored")).distinct(), "post_id", "left")
    a = marked.agg(F.count(F.lit(1)).alias("posts"), F.count_if(recent).alias("recent_posts"), F.count_if(recent & F.col("scored").isNotNull()).alias("recent_scored"))
    b = narratives.agg(F.count(F.lit(1)).alias("narratives"), F.count_if(F.col("gate_reason") == "eligible").alias("eligible"))
    flat = lambda d: d.unpivot([], d.columns, "metric", "value")
    return flat(a).unionByName(flat(b))


def gate_counts(narratives: DataFrame) -> DataFrame:
    """(gate_reason, n)."""
    return narratives.groupBy("gate_reason").agg(F.count(F.lit(1)).alias("n"))


def billed(rows: DataFrame, reads: str = "reads", per_request: int = 20, price: float = 0.00015) -> DataFrame:
    """rows with reads that were counted as requests made posts, and their cost (billing backfill)."""
    fixed = F.when(F.col("unit") == "requests", F.col(reads) * per_request).otherwise(F.col(reads))
    return rows.withColumns({"cost_usd": fixed * price, reads: fixed})


def spend_projection(rows: DataFrame, ts: str, amount: str, now: Column, daily: float) -> DataFrame:
    """(spent, share_of_day, projected, over): today's spend carried on to midnight (spend projection)."""
    day = F.to_date(now)
    passed = (F.unix_micros(now) - F.unix_micros(day.cast("timestamp"))) / 86_400_000_000
    out = rows.where((F.to_date(F.col(ts).cast("timestamp")) == day) & (F.col(ts).cast("timestamp") <= now)).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("spent"))
    out = out.withColumn("share_of_day", passed).withColumn("projected", F.try_divide("spent", F.nullif("share_of_day", F.lit(0.0))))
    return out.withColumn("over", F.coalesce(F.col("projected") > daily, F.lit(False)))


def tag_metrics(rows: DataFrame, text_col: str, pattern: str, coined: str) -> DataFrame:
    """(tagged, tagged_coined, untagged, untagged_coined) for texts that match a pattern."""
    hit = F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    return rows.agg(F.count_if(hit).alias("tagged"), F.count_if(hit & F.col(coined)).alias("tagged_coined"), F.count_if(~hit).alias("untagged"), F.count_if(~hit & F.col(coined)).alias("untagged_coined"))


def balances(accounts: DataFrame, owner: str, amount: str) -> DataFrame:
    """(owner, balance): sum over an owner's accounts."""
    return accounts.groupBy(owner).agg(F.sum(F.col(amount)).alias("balance"))


def visibility(rows: DataFrame, seen: str, outcome: str, views: str) -> DataFrame:
    """(outcome, n, seen, missed, views_p25): what the pipeline saw of each outcome."""
    out = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("seen"), F.percentile(views, F.lit(0.25)).alias("views_p25"))
    return out.withColumn("missed", F.col("n") - F.col("seen"))


def peak_check(ours: DataFrame, theirs: DataFrame, key: str, tolerance: float = 0.25) -> DataFrame:
    """(key, ours, theirs, ratio, agrees): peaks against a second source."""
    out = ours.join(theirs, key).withColumn("ratio", F.try_divide("ours", F.nullif("theirs", F.lit(0.0))))
    return out.withColumn("agrees", F.coalesce(F.abs(F.col("ratio") - 1) <= tolerance, F.lit(False)))


def rescored(posts: DataFrame, scores: DataFrame, group: str = "narrative_id") -> DataFrame:
    """(group, meme_score, max_score, n): a narrative's score is that of its most viewed post."""
    rows = posts.join(scores.select("post_id", "meme_score"), "post_id")
    return rows.groupBy(group).agg(F.max_by("meme_score", F.struct(F.col("views"), -F.col("post_id"))).alias("meme_score"), F.max("meme_score").alias("max_score"), F.count(F.lit(1)).alias("n"))


def purge(rows: DataFrame, payload: str, path: str, least: str) -> DataFrame:
    """Rows whose payload shows that they graduated: a field at or after a value (P20)."""
    found = F.get_json_object(payload, path)
    return rows.where(found.isNotNull() & (found.cast("long") >= F.lit(int(least))))
