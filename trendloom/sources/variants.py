"""Landed payloads as VARIANT values: each is parsed once, and every path is read from the parsed value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(raw: DataFrame, column: str = "value", name: str = "v") -> DataFrame:
    """raw with its JSON text as a variant, null where it can't be read."""
    return raw.withColumn(name, F.try_parse_json(column))


def first_of(v, kind: str, *paths: str) -> Column:
    """The first of the paths that holds a value of the kind, numbers in text among them; null if none does."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def tt_posts(raw: DataFrame, column: str = "value", zero_as_null: bool = False) -> DataFrame:
    """What files.parse_tt_posts gives, from variants (S10). Counts may also come as text."""
    j = parsed(raw.select(column), column).withColumn("pid", first_of("v", "string", "$.id", "$.aweme_id")).where("pid is not null")
    get = lambda kind, *paths: first_of("v", kind, *paths)

    def count(a: str, b: str) -> Column:
        found = get("bigint", f"$.{a}", f"$.stats.{a}")
        return (F.nullif(found, F.lit(0)) if zero_as_null else F.coalesce(found, F.lit(0))).alias(b)

    at = get("bigint", "$.createTime")
    return j.select(
        F.lit("tt").alias("platform"), F.col("pid").alias("platform_post_id"), get("string", "$.authorMeta.name", "$.author.uniqueId").alias("handle"), F.coalesce(get("string", "$.text", "$.desc"), F.lit("")).alias("text"),
        get("bigint", "$.authorMeta.fans", "$.author.followers").alias("followers"), count("playCount", "views"), count("diggCount", "likes"), count("shareCount", "retweets"), count("commentCount", "replies"), F.lit(0).cast("long").alias("quotes"),
        F.when(at > 0, F.when(at < 10**12, at * 1000).otherwise(at)).alias("posted_at"), get("string", "$.videoMeta.coverUrl").alias("media_url"), F.lit("video").alias("media_type"), get("string", "$.musicMeta.musicId", "$.music.id").alias("sound_id"))


def candles(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """What files.parse_candles gives, from variants: rows as arrays and as objects may even mix within a payload."""
    read = raw.select(F.col(key).alias("_key"), F.try_parse_json(payload).alias("_v"))
    rows = read.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is null").select("_key", F.col("value").alias("r"))
    get = lambda kind, i, *names: first_of("r", kind, f"$[{i}]", *[f"$.{n}" for n in names])
    # From a generator, as a filter below a plain projection reads its fields from the variant once more.
    asked = F.inline(F.array(F.struct(get("bigint", 0, "unixTime", "unix_time").alias("unixTime"), get("double", 4, "c").alias("c"))))
    bars = rows.select("_key", "r", asked).where("unixTime is not null and c > 0")
    return bars.select(F.col("_key").alias(key), "unixTime", *["c" if n == "c" else get("double", i, n).alias(n) for i, n in enumerate("ohlcv", 1)])


def reply_fields(raw: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """raw with fields (name -> kind) of the JSON object that a model's reply holds, with or without a fence and words around it."""
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    out = raw.withColumn("_v", F.try_parse_json(body))
    return out.withColumns({n: F.try_variant_get("_v", f"$.{n}", kind) for n, kind in fields.items()}).drop("_v")
