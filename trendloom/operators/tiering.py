"""Activity tiers, due times and pruning of tracked posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import micros
from ..session import kept


def global_rank(rows: DataFrame, value: str, key: str, name: str = "rank", per_range: int = 100_000) -> DataFrame:
    """Rank from 1 over all rows by value descending, then key ascending, without bringing them to one task.

    The rows are sorted into ranges by Spark's own sample, of about per_range rows each, as many as the table needs; the
    table is kept with the range's number. Every row is ranked within its range and lifted by the rows of the ranges before,
    of which the counts alone, one a range, meet in one task. The bounds balance the work; the ranks don't depend on
    them. Null values come last. Rows equal in value and key are ranked in any order.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // per_range + 1)
    order = [F.col(value).desc_nulls_last(), F.col(key)]
    spread = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = spread.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("size"))
    below = F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    lifts = sizes.select("_part", F.coalesce(below, F.lit(0)).alias("_below"))
    return within.join(F.broadcast(lifts), "_part").withColumn(name, (F.col("_within") + F.col("_below")).cast("long")).drop("_part", "_within", "_below")


def assign_tiers(posts: DataFrame, velocity: str = "views_velocity", key: str = "post_id", hot: float = 0.2, warm: float = 0.6) -> DataFrame:
    """posts with rank, n and tier: the fastest fifth hot (one at least), up to three fifths warm, the rest cold.

    Unknown velocity counts as zero; ties go by key. Cuts are on the rank, ceil(0.2 n) and ceil(0.6 n), so every post has one tier.
    """
    ranked = global_rank(posts.withColumn("_v", F.coalesce(F.col(velocity), F.lit(0.0))), "_v", key)
    total = posts.agg(F.count(F.lit(1)).alias("n"))
    out = ranked.crossJoin(F.broadcast(total))  # one row
    top = F.greatest(F.lit(1), F.ceil(F.col("n") * hot))
    tier = F.when(F.col("rank") <= top, "hot").when(F.col("rank") <= F.greatest(top, F.ceil(F.col("n") * warm)), "warm").otherwise("cold")
    return out.withColumn("tier", tier).drop("_v")


def interval_minutes(tier: Column, platform: Column, hot: int = 2, warm: int = 8, cold: int = 20, tt_factor: int = 3) -> Column:
    """Minutes between snapshots of a tier; unknown tiers are cold."""
    return F.when(tier == "hot", hot).when(tier == "warm", warm).otherwise(cold) * F.when(platform == "tt", tt_factor).otherwise(1)


def due(tier: Column, platform: Column, last_at: Column, now: Column) -> Column:
    """Whether a post's next snapshot is due."""
    waited = (micros(now) - micros(last_at)) / 60_000_000
    return F.coalesce(waited >= interval_minutes(tier, platform), F.lit(True))


def prunable(tier: Column, first_seen: Column, views: Column, velocity: Column, platform: Column, now: Column, min_views: int = 1000, min_views_tt: int = 1000, slow: float = 500, after_min: int = 10, prune_unknown: bool = False) -> Column:
    """Cold, tracked for long enough, few views and slow.

    Posts of unknown velocity stay, as documented; prune_unknown gives the behaviour that treats it as zero.
    """
    least = F.when(platform == "tt", min_views_tt).otherwise(min_views)
    v = F.coalesce(velocity, F.lit(0.0)) if prune_unknown else velocity
    old = micros(first_seen) <= micros(now) - after_min * 60_000_000
    return F.coalesce((tier == "cold") & old & (F.coalesce(views, F.lit(0)) < least) & (v < slow), F.lit(False))


def score_batch(posts: DataFrame, n: int = 10, key: str = "post_id") -> DataFrame:
    """The n posts to score next: by velocity, or views / 1000 where a fast-lane post has none yet; others have to wait (K1)."""
    urgency = F.coalesce("views_velocity", F.when(F.col("fast_lane"), F.col("views") / 1000))
    return posts.withColumn("urgency", urgency).where("urgency is not null").orderBy(F.col("urgency").desc(), key).limit(n)


def velocity_report(velocity: DataFrame, k: int = 20, key: str = "post_id") -> DataFrame:
    """The k fastest keys with their tiers: the flagship query."""
    return assign_tiers(velocity, key=key).select(key, "n", "rank", "tier", "views", "views_velocity", "views_acceleration", "lifecycle").orderBy("rank").limit(k)
