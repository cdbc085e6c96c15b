"""CSV and JSON sources and sinks, and parsers of landed payloads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

X_POST = "id string, text string, createdAt string, likeCount long, retweetCount long, replyCount long, quoteCount long, viewCount long, lang string, author struct<userName:string,followers:long,description:string>, extendedEntities struct<media:array<struct<type:string,media_url_https:string>>>"
TT_POST = "id string, aweme_id string, text string, desc string, createTime long, playCount long, diggCount long, commentCount long, shareCount long, stats struct<playCount:long,diggCount:long,commentCount:long,shareCount:long>, authorMeta struct<name:string,fans:long,signature:string>, author struct<uniqueId:string,followers:long>, musicMeta struct<musicId:string>, music struct<id:string>, videoMeta struct<coverUrl:string>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields that may span lines, and comment lines that begin with #."""
    reader = spark.read.options(header=True, comment="#", multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """Rows as CSV files with a header; meta goes to a JSON file beside them, as CSV has no room for it.

    Arrays, maps and structs become JSON text. The folder must not exist.
    """
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.options(header=True, quote='"', escape='"').csv(path)
    if meta is not None:
        rows.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """What write_csv wrote beside its rows; nothing where it wrote none."""
    found = spark.read.text(f"{path}.meta").first()
    return json.loads(found[0]) if found else {}


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet folder, which need not exist."""
    rows.write.mode("append").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    """A stage's state as JSON lines, in place of what was there."""
    state.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stage's state as it was written last."""
    return spark.read.schema(schema).json(path)


def canonical(rows: DataFrame, aliases: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """rows with the given columns: each the first filled one of itself and its aliases, blanks as null."""
    def pick(c: str) -> Column:
        found = [a for a in [c, *aliases.get(c, [])] if a in rows.columns]
        filled = [F.when(F.trim(F.col(a).cast("string")) != "", F.trim(F.col(a).cast("string"))) for a in found]
        return (F.coalesce(*filled) if filled else F.lit(None).cast("string")).alias(c)

    return rows.select(*[pick(c) for c in columns])


def parse_x_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    """Canonical posts from JSON lines of one platform (S9). Unreadable lines and those without an id drop out."""
    j = raw.select(F.from_json(column, X_POST).alias("j")).where("j.id is not null")
    media = F.get(F.col("j.extendedEntities.media"), F.lit(0))
    posted = F.coalesce(F.unix_millis(F.col("j.createdAt").try_cast("timestamp")), F.unix_millis(F.try_to_timestamp("j.createdAt", F.lit("yyyy-MM-dd HH:mm:ss Z"))))
    return j.select(
        F.lit("x").alias("platform"), F.col("j.id").alias("platform_post_id"), F.col("j.author.userName").alias("handle"), F.coalesce("j.text", F.lit("")).alias("text"), F.col("j.author.followers").alias("followers"),
        *[F.coalesce(F.col(f"j.{a}"), F.lit(0)).alias(b) for a, b in (("viewCount", "views"), ("likeCount", "likes"), ("retweetCount", "retweets"), ("replyCount", "replies"), ("quoteCount", "quotes"))],
        posted.alias("posted_at"), media["media_url_https"].alias("media_url"), media["type"].alias("media_type"), F.lit(None).cast("string").alias("sound_id"))


def parse_tt_posts(raw: DataFrame, column: str = "value", zero_as_null: bool = False) -> DataFrame:
    """Canonical posts from JSON lines of the other platform, whose counts come in one of two places.

    zero_as_null: counts of zero are unknown, as snapshots want them.
    """
    j = raw.select(F.from_json(column, TT_POST).alias("j")).withColumn("pid", F.coalesce("j.id", "j.aweme_id")).where("pid is not null")

    def count(a: str, b: str) -> Column:
        found = F.coalesce(F.col(f"j.{a}"), F.col(f"j.stats.{a}"))
        return (F.nullif(found, F.lit(0)) if zero_as_null else F.coalesce(found, F.lit(0))).alias(b)

    return j.select(
        F.lit("tt").alias("platform"), F.col("pid").alias("platform_post_id"), F.coalesce("j.authorMeta.name", "j.author.uniqueId").alias("handle"), F.coalesce("j.text", "j.desc", F.lit("")).alias("text"),
        F.coalesce("j.authorMeta.fans", "j.author.followers").alias("followers"), count("playCount", "views"), count("diggCount", "likes"), count("shareCount", "retweets"), count("commentCount", "replies"), F.lit(0).cast("long").alias("quotes"),
        F.when(F.col("j.createTime") > 0, F.when(F.col("j.createTime") < 10**12, F.col("j.createTime") * 1000).otherwise(F.col("j.createTime"))).alias("posted_at"),
        F.col("j.videoMeta.coverUrl").alias("media_url"), F.lit("video").alias("media_type"), F.coalesce("j.musicMeta.musicId", "j.music.id").alias("sound_id"))


def with_includes(posts: DataFrame, users: DataFrame, media: DataFrame) -> DataFrame:
    """posts(id, author_id, media_keys) with the author's and the first medium's fields."""
    first = posts.select("id", F.get("media_keys", F.lit(0)).alias("media_key")).join(media, "media_key", "left").select("id", F.col("url").alias("media_url"), F.col("type").alias("media_type"))
    who = users.select(F.col("id").alias("author_id"), F.col("username").alias("handle"), "followers")
    return posts.join(who, "author_id", "left").join(first, "id", "left")


def parse_trend(raw: DataFrame, term: str, payload: str) -> DataFrame:
    """(term, series, peak) of {"interest_over_time": {"timeline_data": [{"values": [{"extracted_value": n}]}]}}.

    A point takes the first value that is extracted, else zero. Payloads without a point, or with zeros only, drop out.
    """
    kind = "array<struct<values:array<struct<extracted_value:double>>>>"
    points = F.from_json(payload, f"interest_over_time struct<timeline_data:{kind}>")["interest_over_time"]["timeline_data"]
    first = lambda t: F.coalesce(F.get(F.filter(t["values"], lambda v: v["extracted_value"].isNotNull()), F.lit(0))["extracted_value"], F.lit(0.0))
    out = raw.select(term, F.transform(F.coalesce(points, F.array().cast(kind)), first).alias("series"))
    return out.withColumn("peak", F.array_max("series")).where(F.exists("series", lambda v: v != 0))


def parse_candles(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, unixTime, o, h, l, c, v) from JSON rows [t, o, h, l, c, v] or objects with those names.

    Rows without a time or with a close of zero drop out.
    """
    arrays = F.from_json(payload, "array<array<double>>")
    objects = F.from_json(payload, "array<struct<unixTime:long,unix_time:long,o:double,h:double,l:double,c:double,v:double>>")
    row = "struct<unixTime:bigint,o:double,h:double,l:double,c:double,v:double>"
    at = lambda r, i: F.get(r, F.lit(i))
    from_arrays = F.transform(arrays, lambda r: F.struct(at(r, 0).cast("long").alias("unixTime"), *[at(r, i).alias(n) for i, n in enumerate("ohlcv", 1)]))
    from_objects = F.transform(objects, lambda r: F.struct(F.coalesce(r["unixTime"], r["unix_time"]).alias("unixTime"), *[r[n].alias(n) for n in "ohlcv"]))
    bars = F.when(F.trim(payload).rlike(r"^\[\s*\["), from_arrays).otherwise(from_objects).cast(f"array<{row}>")
    return raw.select(key, F.inline(bars)).where("unixTime is not null and c > 0")


def map_pairs(raw: DataFrame, column: str = "value") -> DataFrame:
    """Token pairs from JSON, numbers in text or not."""
    j = F.from_json(column, "chainId string, dexId string, pairAddress string, pairCreatedAt long, priceUsd string, fdv double, marketCap double, liquidity struct<usd:double>, volume struct<h24:double>, baseToken struct<address:string,symbol:string,name:string>, quoteToken struct<address:string,symbol:string>")
    j = raw.select(j.alias("j")).where("j.pairAddress is not null")
    return j.select(
        F.col("j.baseToken.address").alias("mint"), F.upper("j.baseToken.symbol").alias("symbol"), F.col("j.baseToken.name").alias("name"), F.col("j.pairAddress").alias("pair"), F.col("j.dexId").alias("dex"),
        (F.upper("j.quoteToken.symbol").isin("SOL", "WSOL")).alias("sol_quote"), F.col("j.priceUsd").try_cast("double").alias("price"), F.coalesce("j.marketCap", "j.fdv").alias("mcap"),
        F.col("j.liquidity.usd").alias("liquidity"), F.col("j.volume.h24").alias("volume"), F.col("j.pairCreatedAt").alias("created_ms"))


def sheet(rows: DataFrame, columns: list[str], longest: int = 500) -> DataFrame:
    """Cells as short text: no line breaks, cut with an ellipsis, times as dates."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if kinds[c].startswith(("timestamp", "date")):
            return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
        s = F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
        return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 1), F.lit("…"))).otherwise(s).alias(c)

    return rows.select(*[cell(c) for c in columns])
