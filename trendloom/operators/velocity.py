"""Engagement series: latest snapshots, velocities, accelerations, hourly buckets and early windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import lifecycle
from ..functions.values import engagement, micros

METRICS = ("views", "likes", "retweets", "replies")


def latest_snapshots(snaps: DataFrame, n: int = 1, key: str = "post_id", ts: str = "captured_at", tie: str = "id", unavailable: str = "unavailable") -> DataFrame:
    """The n newest available snapshots of each key, with their rank.

    Ranked rows above n are dropped before the shuffle as well as after it (Spark pushes a group limit below the exchange),
    so that a key with a third of all rows sends n rows a task.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return snaps.where(~F.coalesce(F.col(unavailable), F.lit(False))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _per_minute(new: Column, old: Column, field: str) -> Column:
    minutes = (new["us"] - old["us"]) / 60_000_000
    return F.when(minutes > 0, (new[field] - old[field]) / minutes)


def velocities(snaps: DataFrame, key: str = "post_id", ts: str = "captured_at", tie: str = "id", unavailable: str = "unavailable") -> DataFrame:
    """(key, n, views, views_velocity, views_acceleration, engagement_velocity, lifecycle) of each key.

    Per-minute differences of the newest two (three for acceleration) available snapshots, n of them at most three. Null
    with too few snapshots, a null count in one of them, or no time between them. The result doesn't depend on row order.
    """
    eng = engagement(F.col("likes"), F.col("retweets"), F.col("replies"))
    row = F.struct(micros(F.col(ts)).alias("us"), F.col("views").alias("views"), eng.alias("eng"))
    top = latest_snapshots(snaps, 3, key, ts, tie, unavailable).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("rank") == i, row)).alias(f"s{i}") for i in (1, 2, 3)])
    s1, s2, s3 = (F.col(f"s{i}") for i in (1, 2, 3))
    v1, v2 = _per_minute(s1, s2, "views"), _per_minute(s2, s3, "views")
    out = top.select(key, "n", s1["views"].alias("views"), v1.alias("views_velocity"), (v1 - v2).alias("views_acceleration"), _per_minute(s1, s2, "eng").alias("engagement_velocity"))
    return out.withColumn("lifecycle", lifecycle(F.col("views_velocity"), F.col("views_acceleration")))


def missing_views(snaps: DataFrame, **names) -> DataFrame:
    """(checked, missing, pct) over the latest snapshot of each key."""
    return latest_snapshots(snaps, 1, **names).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("views").isNull()).alias("missing"),
    ).withColumn("pct", F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("checked")), F.lit(0.0)))


def flat_views(snaps: DataFrame, key: str = "post_id", least_snapshots: int = 2, least_checked: int = 3, share: float = 0.8) -> DataFrame:
    """(checked, flat, unreliable): keys whose views never change; unreliable if most are flat."""
    per = snaps.where(F.col("views").isNotNull() & ~F.coalesce(F.col("unavailable"), F.lit(False))).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("views").alias("low"), F.max("views").alias("high")).where(F.col("n") >= least_snapshots)
    out = per.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("low") == F.col("high")).alias("flat"))
    return out.withColumn("unreliable", (F.col("checked") >= least_checked) & (F.col("flat") >= share * F.col("checked")))


def bucket_series(snaps: DataFrame, key: str, ts: str = "captured_at", unit: str = "hour", latest_only: bool = False) -> DataFrame:
    """(key, bucket, views): sums by time bucket.

    Every snapshot counts, so several of a post within a bucket add up; latest_only takes the last one of each post instead
    (rows then need post_id).
    """
    rows = snaps.where(~F.coalesce(F.col("unavailable"), F.lit(False))).withColumn("bucket", F.date_trunc(unit, F.col(ts).cast("timestamp")))
    if latest_only:
        rows = rows.groupBy(key, "bucket", "post_id").agg(F.max_by(F.coalesce("views", F.lit(0.0)), F.struct(ts, "id")).alias("views"))
    return rows.groupBy(key, "bucket").agg(F.sum(F.coalesce("views", F.lit(0.0))).alias("views"))


def series_arrays(buckets: DataFrame, key: str) -> DataFrame:
    """(key, series): bucket sums in order of time. A series holds a number an hour, so it is short."""
    return buckets.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "views"))).alias("s")).select(key, F.transform("s", lambda x: x["views"]).alias("series"))


def gain_24(series: Column) -> Column:
    """Last element less the one 24 before it (or the first), not below zero; counts buckets, not hours."""
    n = F.size(series)
    prior = F.get(series, F.greatest(F.lit(0), n - 25))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.get(series, n - 1) - prior)).otherwise(0.0)


def lifecycle_of_series(series: Column) -> Column:
    """Phase from the last four buckets' slope and the middle."""
    n = F.size(series)
    at = lambda i: F.get(series, i)
    slope = (at(n - 1) - at(n - 4)) / F.greatest(at(n - 4), F.lit(1.0))
    mid = (at(F.floor(n / 2).cast("int")) - at(F.lit(0))) / F.greatest(at(F.lit(0)), F.lit(1.0))
    return F.when(n < 4, "peaking").when((slope > 0.12) & (mid < 0.45), "heating").when(slope < -0.07, "cooling").otherwise("peaking")


def tail_direction(series: Column, steep: float = 1.5) -> Column:
    """rising, falling or flat: mean step over the last third of the series, two points of it at least."""
    n = F.size(series)
    tail = F.greatest(F.lit(2), F.floor(n / 3).cast("int"))
    slope = (F.get(series, n - 1) - F.get(series, n - tail)) / (tail - 1)
    return F.when(n < 3, "flat").when(slope > steep, "rising").when(slope < -steep, "falling").otherwise("flat")


def early_features(posts: DataFrame, snaps: DataFrame, window_min: int = 30) -> DataFrame:
    """Features knowable window_min minutes after posting.

    posts(post_id, posted_at), snaps(post_id, captured_at, id, views). Only snapshots from posting to the window's end count;
    a null count there is zero. One snapshot: views over the window's length. Times between are one minute at least.
    Acceleration splits at the middle snapshot, number floor(n / 2) from zero. The range condition rides on the equi join by
    post, and snapshots are thinned to the window before they are gathered.
    """
    p, s = posts.select("post_id", micros(F.col("posted_at")).alias("t0")), snaps.select("post_id", F.col("id").alias("sid"), micros(F.col("captured_at")).alias("us"), F.coalesce("views", F.lit(0.0)).alias("v"))
    inside = p.join(s, "post_id").where((F.col("us") >= F.col("t0")) & (F.col("us") <= F.col("t0") + window_min * 60_000_000))
    got = inside.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("us", "sid", "v"))).alias("s"))
    n = F.size("s")
    first, mid, last = F.get("s", F.lit(0)), F.get("s", F.floor(n / 2).cast("int")), F.get("s", n - 1)
    speed = lambda a, b: (b["v"] - a["v"]) / F.greatest(F.lit(1.0), (b["us"] - a["us"]) / 60_000_000)
    return got.select(
        "post_id", n.cast("long").alias("n_snapshots"), last["v"].alias("views_at_t"),
        F.when(n < 2, last["v"] / window_min).otherwise(speed(first, last)).alias("view_velocity_t"),
        F.when(n >= 3, speed(mid, last) - speed(first, mid)).alias("acceleration_t"),
    )


def monotone(rows: DataFrame, key: str, ts: str, tie: str, metric: str) -> DataFrame:
    """metric with each row's running maximum in order of time added as <metric>_seen."""
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{metric}_seen", F.max(metric).over(w))
