"""Feeds, queues, lanes and the snapshot cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, text
from ..functions.values import millis
from .tiering import assign_tiers, due, prunable
from .velocity import latest_snapshots, velocities

SORTS = {"views": ["combined_views"], "gain": ["gain_24h"], "mcap": ["mcap"], "new": ["created_at"], "trending": ["trend_score", "combined_views"]}


def search_filter(posts: DataFrame, min_likes: int = 0, lang: str | None = None, since_ms: int | None = None, until_ms: int | None = None, phrase: str | None = None) -> DataFrame:
    """What a search query selects, over landed posts."""
    out = posts.where(F.col("likes") >= min_likes)
    for given, rule in ((lang, F.col("lang") == lang), (since_ms, F.col("posted_at") >= F.lit(since_ms)), (until_ms, F.col("posted_at") < F.lit(until_ms)), (phrase, F.lower("text").contains((phrase or "").lower()))):
        if given is not None:
            out = out.where(rule)
    return out


def lanes(posts: DataFrame, floors: dict[str, int], media_col: str = "media_url") -> DataFrame:
    """posts with lane and whether each reaches its lane's floor; the others are near misses."""
    lane = F.when(F.col(media_col).isNotNull(), "media-lane").when(F.col("age_min") > 120, "slow-burn").otherwise("catch-all")
    table = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return posts.withColumn("lane", lane).withColumn("reaches", F.coalesce(F.col("views") >= F.try_element_at(table, F.col("lane")), F.lit(False)))


def force_batch(posts: DataFrame, n: int, ts: str = "posted_at", key: str = "post_id") -> DataFrame:
    """The n newest posts, whatever their speed (K2)."""
    return posts.orderBy(F.col(ts).desc(), key).limit(n)


def recheck_batch(misses: DataFrame, n: int = 50, key: str = "post_id") -> DataFrame:
    """The n most viewed near misses (K7)."""
    return misses.orderBy(F.col("views").desc(), key).limit(n)


def sorted_narratives(rows: DataFrame, mode: str, key: str, pinned: Column | None = None) -> DataFrame:
    """Narratives in a sort mode, pinned ones first; age runs from the youngest."""
    order = [F.col("age_min").asc_nulls_last()] if mode == "age" else [F.col(c).desc_nulls_last() for c in SORTS[mode]]
    return rows.orderBy(*([F.coalesce(pinned, F.lit(False)).desc()] if pinned is not None else []), *order, key)


def latest_run(runs: DataFrame, stage: str = "stage", ts: str = "started_at", tie: str = "id") -> DataFrame:
    """The newest run of each stage."""
    w = Window.partitionBy(stage).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def mistakes(rows: DataFrame, score: str, coined: str, threshold: float, key: str, k: int = 10) -> DataFrame:
    """The k highest scores that came to nothing and the k lowest that did not."""
    over, under = rows.where((F.col(score) >= threshold) & ~F.col(coined)), rows.where((F.col(score) < threshold) & F.col(coined))
    a = over.orderBy(F.col(score).desc(), key).limit(k).withColumn("kind", F.lit("false_positive"))
    return a.unionByName(under.orderBy(F.col(score).asc(), key).limit(k).withColumn("kind", F.lit("false_negative")))


def confirmation_terms(posts: DataFrame, n: int, group: str = "narrative_id") -> DataFrame:
    """Up to n terms to confirm on the other platform: the longest words of the most viewed posts of open narratives."""
    w = Window.partitionBy(group).orderBy(F.col("views").desc(), "post_id")
    top = posts.where("platform = 'x'").withColumn("r", F.row_number().over(w)).where("r = 1")
    terms = top.select("views", text.trend_term(text.matching_tokens(F.col("text"), F.col("handle"))).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.max("views").alias("views")).orderBy(F.col("views").desc(), "term").limit(n)


def snapshot_cycle(posts: DataFrame, snaps: DataFrame, now: Column, **limits) -> DataFrame:
    """posts(post_id, platform, first_seen_at, last_snapshot_at) with tier, pruned and due: one cycle of the tracker.

    Posts are tiered by velocity, slow cold ones pruned, and those whose interval has passed are due, unless pruned.
    """
    rows = posts.join(velocities(snaps).select("post_id", "views", "views_velocity"), "post_id", "left")
    rows = assign_tiers(rows)
    gone = prunable(F.col("tier"), F.col("first_seen_at"), F.col("views"), F.col("views_velocity"), F.col("platform"), now, **limits)
    return rows.withColumn("pruned", gone).withColumn("due", ~F.col("pruned") & due(F.col("tier"), F.col("platform"), F.col("last_snapshot_at"), now))


def open_velocities(members: DataFrame, snaps: DataFrame, group: str = "narrative_id") -> DataFrame:
    """(group, views, views_velocity, accel, lifecycle) of open narratives, without the cross-platform factor."""
    last, speed = latest_snapshots(snaps).select("post_id", F.col("views").alias("v")), velocities(snaps).select("post_id", "views_velocity", "views_acceleration")
    rows = members.select(group, "post_id").join(last, "post_id", "left").join(speed, "post_id", "left")
    zero = F.lit(0.0)
    out = rows.groupBy(group).agg(F.coalesce(F.sum("v"), zero).alias("views"), F.coalesce(F.sum("views_velocity"), zero).alias("views_velocity"), F.coalesce(F.sum("views_acceleration"), zero).alias("accel"))
    return out.withColumn("lifecycle", gates.lifecycle(F.col("views_velocity"), F.col("accel")))


def view_rows(posts: DataFrame, now: Column) -> DataFrame:
    """Rows as a page shows them: short counts and ages."""
    from ..functions.values import format_age, format_count

    age = F.greatest(F.lit(0.0), (millis(now) - millis(F.col("posted_at"))) / 60000)
    return posts.select("post_id", F.concat(F.lit("@"), text.normalize_handle(F.col("handle"))).alias("handle"), text.blurb(F.col("text")).alias("blurb"), format_count(F.col("views")).alias("views"), format_age(age).alias("age"))
