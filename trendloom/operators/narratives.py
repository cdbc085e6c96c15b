"""Narrative rollups: members, signals, replication, tickers, and the derived row with its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, text
from ..functions.values import engagement, millis
from .velocity import bucket_series, gain_24, latest_snapshots, series_arrays, velocities

GROUP = "narrative_id"


def posts_with_metrics(posts: DataFrame, snaps: DataFrame, scores: DataFrame) -> DataFrame:
    """posts(post_id, narrative_id, platform, handle, text, posted_at, first_seen_at, views, likes, retweets, replies) with the
    latest counts, velocities and score of each (J1, J2). Counts fall back to the post's own where there is no snapshot."""
    last = latest_snapshots(snaps).select("post_id", *[F.col(c).alias(f"last_{c}") for c in ("views", "likes", "retweets", "replies")])
    speed = velocities(snaps).select("post_id", "views_velocity", "views_acceleration", "engagement_velocity")
    out = posts.join(last, "post_id", "left").join(speed, "post_id", "left").join(scores.select("post_id", "meme_score", "suggested_ticker", "suggested_name"), "post_id", "left")
    for c in ("views", "likes", "retweets", "replies"):
        out = out.withColumn(c, F.coalesce(f"last_{c}", c, F.lit(0))).drop(f"last_{c}")
    return out.withColumn("meme_score", F.coalesce("meme_score", F.lit(0.0)))


def author_counts(posts: DataFrame, now, group: str = GROUP) -> DataFrame:
    """(group, distinct_authors, new_authors): handles, and those first seen in the last hour."""
    per = posts.withColumn("h", text.normalize_handle(F.col("handle"))).where("h <> ''").groupBy(group, "h").agg(F.min("first_seen_at").alias("first"))
    fresh = F.col("first") >= now - F.expr("INTERVAL 1 HOUR")
    return per.groupBy(group).agg(F.count(F.lit(1)).alias("distinct_authors"), F.count_if(fresh).alias("new_authors"))


def member_span(posts: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, oldest, newest): when each group's first and last post was written; posts without a time don't count."""
    return posts.groupBy(group).agg(F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"))


def sound_authors(posts: DataFrame, now, window_min: int = 120) -> DataFrame:
    """(sound_id, creators, per_hour): creators that used a sound within the window."""
    recent = posts.where("platform = 'tt' and sound_id is not null").where(F.col("first_seen_at") >= now - F.expr(f"INTERVAL {window_min} MINUTES"))
    per = recent.select("sound_id", text.normalize_handle(F.col("handle")).alias("h")).where("h <> ''").distinct()
    return per.groupBy("sound_id").agg(F.count(F.lit(1)).alias("creators")).withColumn("per_hour", F.col("creators") / (window_min / 60))


def replication(posts: DataFrame, now, group: str = GROUP) -> DataFrame:
    """(group, distinct_authors, author_velocity): the larger of member and sound counts (A10)."""
    members = author_counts(posts, now, group)
    sounds = posts.where("sound_id is not null").select(group, "sound_id").distinct().join(sound_authors(posts, now), "sound_id")
    best = sounds.groupBy(group).agg(F.max("creators").alias("creators"), F.max("per_hour").alias("per_hour"))
    joined = members.join(best, group, "full")
    zero = F.lit(0)
    return joined.select(
        group, F.greatest(F.coalesce("distinct_authors", zero), F.coalesce("creators", zero)).alias("distinct_authors"),
        F.round(F.greatest(F.coalesce("new_authors", zero).cast("double"), F.coalesce("per_hour", F.lit(0.0))), 2).alias("author_velocity"),
    )


def signals(posts: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, ticker_proposals, ct_pickup, proposal_tickers) over the members' texts."""
    return posts.groupBy(group).agg(
        F.sum(text.proposal_count(F.col("text"))).alias("ticker_proposals"), F.bool_or(text.is_pickup(F.col("text"))).alias("ct_pickup"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(text.ticker_mentions(F.col("text")))))).alias("proposal_tickers"),
    )


def tickers(posts: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, ticker, name, meme_score, endorsed_by, canonical): symbols of each group's posts.

    Cashtags score zero; suggestions bring the best score of their posts, and the name and handle of the last one by post_id.
    The symbol with the highest score is canonical, ties in order of symbol.
    """
    tags = posts.select(group, F.explode(text.cashtags(F.col("text"))).alias("ticker")).distinct()
    tags = tags.select(group, "ticker", F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("h"), F.lit(-1).cast("long").alias("o"))
    found = posts.where("suggested_ticker is not null").select(
        group, F.upper(F.regexp_replace("suggested_ticker", r"^\$", "")).alias("ticker"), F.col("meme_score").alias("s"), F.col("suggested_name").alias("n"), F.col("handle").alias("h"), F.col("post_id").alias("o"))
    plain = F.concat(F.upper(F.substring("ticker", 1, 1)), F.lower(F.substring("ticker", 2, 100)))
    out = tags.unionByName(found).groupBy(group, "ticker").agg(
        F.max("s").alias("meme_score"), F.max_by("n", F.when(F.col("n").isNotNull(), F.col("o"))).alias("n"), F.max_by("h", F.when(F.col("h").isNotNull(), F.col("o"))).alias("endorsed_by"))
    w = Window.partitionBy(group).orderBy(F.col("meme_score").desc(), "ticker")
    return out.select(group, "ticker", F.coalesce("n", plain).alias("name"), "meme_score", "endorsed_by", (F.row_number().over(w) == 1).alias("canonical"))


def derive(posts: DataFrame, snaps: DataFrame, scores: DataFrame, now, min_views: float = 200_000, group: str = GROUP) -> DataFrame:
    """One row a narrative: sums, velocity, rates, scores, platforms, replication, signals, gate and organic score.

    Velocity of cross-platform narratives is raised by a fifth and rounded. A narrative without views takes its last bucket's.
    """
    rows = posts_with_metrics(posts, snaps, scores)
    eng = engagement(F.col("likes"), F.col("retweets"), F.col("replies"))
    agg = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum("views").alias("sum_views"), F.sum(eng).alias("sum_eng"),
        F.coalesce(F.sum("views_velocity"), F.lit(0.0)).alias("vv"), F.coalesce(F.sum("views_acceleration"), F.lit(0.0)).alias("accel"), F.avg("engagement_velocity").alias("engagement_velocity"),
        F.max_by("meme_score", F.struct(F.col("views"), -F.col("post_id"))).alias("meme_score"), F.max("meme_score").alias("max_meme_score"), F.avg("meme_score").alias("avg_meme"),
        F.max_by("post_id", F.struct(F.col("views"), -F.col("post_id"))).alias("top_post_id"),
        F.array_sort(F.collect_set("platform")).alias("platforms"), F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"),
    )
    own = snaps.join(posts.select("post_id", group), "post_id")
    series = series_arrays(bucket_series(own, group), group)
    out = agg.join(series, group, "left").join(replication(rows, now, group), group, "left").join(signals(rows, group), group, "left")
    s = F.coalesce("series", F.array().cast("array<double>"))
    cross = gates.has(F.col("platforms"), "x") & gates.has(F.col("platforms"), "tt")
    minutes = lambda c: F.greatest(F.lit(0.0), (millis(now) - millis(F.col(c))) / 60000)
    out = out.withColumns({
        "combined_views": F.coalesce(F.nullif("sum_views", F.lit(0)), F.get(s, F.size(s) - 1), F.lit(0)).cast("double"), "gain_24h": gain_24(s), "cross_platform": cross,
        "views_velocity": F.when(cross & (F.col("vv") > 0), F.floor(F.col("vv") * 1.2 + 0.5).cast("double")).otherwise(F.col("vv")),
        "age_min": F.greatest(F.lit(1), F.floor(minutes("oldest") + 0.5).cast("long")), "engagement_rate": F.when(F.col("sum_views") > 0, F.col("sum_eng") / F.col("sum_views")),
    })
    out = out.withColumns({
        "lifecycle": gates.lifecycle(F.col("views_velocity"), F.col("accel")), "bought_reach": gates.bought_reach(F.col("combined_views"), F.col("engagement_rate")),
        "gate_reason": gates.gate_reason(F.col("combined_views"), F.col("meme_score"), F.col("views_velocity"), F.col("platforms"), minutes("newest"), F.col("distinct_authors"), F.col("author_velocity"), F.col("ticker_proposals"), F.col("ct_pickup"), min_views),
        "organic_score": gates.organic_score(F.col("avg_meme"), F.size("platforms"), F.col("n_posts"), F.col("gain_24h"), cross, F.col("author_velocity")),
    })
    keep = "n_posts combined_views views_velocity accel engagement_velocity engagement_rate meme_score max_meme_score top_post_id platforms cross_platform gain_24h lifecycle bought_reach age_min distinct_authors author_velocity ticker_proposals ct_pickup gate_reason organic_score"
    return out.select(group, *keep.split()).withColumn("display_eligible", F.col("gate_reason") == "eligible").withColumn("lead_time_min", F.when(F.col("display_eligible"), F.col("age_min")))


def closing_reason(narratives: DataFrame, members: DataFrame, now, max_age_x: int = 720, max_age_tt: int = 4320) -> DataFrame:
    """narratives with closing: aged_out by its newest member, empty without members, else null."""
    newest = members.groupBy(GROUP).agg(F.max("posted_at").alias("newest"), F.collect_set("platform").alias("platforms"))
    age = (millis(now) - millis(F.col("newest"))) / 60000
    limit = F.when(gates.has(F.col("platforms"), "tt") & ~gates.has(F.col("platforms"), "x"), max_age_tt).otherwise(max_age_x)
    out = narratives.join(newest, GROUP, "left")
    return out.withColumn("closing", F.when(F.col("newest").isNull(), "empty").when(age > limit, "aged_out")).drop("newest", "platforms")


def copy_is_due(existing_title: Column, members_added: Column, match: Column) -> Column:
    """Whether a narrative's title and blurb are written anew: no title that says something, new members, or a new narrative."""
    title = F.lower(F.trim(F.coalesce(existing_title, F.lit(""))))
    return (title == "") | title.isin(text.GENERIC_TITLES) | (F.coalesce(members_added, F.lit(0)) > 0) | F.coalesce(match == "new", F.lit(False))
