"""Numbers, times and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half rounds up, also below zero."""
    return F.floor(x + 0.5)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp of either kind."""
    return F.unix_millis(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def normalize_posted_at(value: Column) -> Column:
    """Epoch milliseconds from digits (seconds below 1e12), an ISO time or null; zero and less are null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    scaled = F.when(number > 0, F.when(number < 1e12, number * 1000).otherwise(number)).cast("long")
    parsed = F.when(~text.rlike(r"^-?\d+(\.\d+)?$"), F.unix_millis(text.try_cast("timestamp")))
    return F.coalesce(scaled, parsed)


def age_minutes(posted_ms: Column, now_ms: Column) -> Column:
    """Minutes since posting, not below zero; null if unknown."""
    return F.greatest(F.lit(0.0), (now_ms - posted_ms) / 60000)


def within_max_age(posted_ms: Column, max_age_min: float | None, now_ms: Column) -> Column:
    """Young enough; unknown ages are not, and a limit of zero or less admits all (P5)."""
    if max_age_min is None or max_age_min <= 0:
        return F.lit(True)
    return F.coalesce(posted_ms > now_ms - F.lit(int(max_age_min * 60_000)), F.lit(False))


def hours_between(earlier: Column, later: Column) -> Column:
    """Hours from one time to another, two decimals."""
    return F.round((micros(later) - micros(earlier)) / 3_600_000_000, 2)


def millis_to_midnight(ts: Column) -> Column:
    """Milliseconds until the next midnight, UTC."""
    return F.lit(86_400_000) - F.pmod(millis(ts), F.lit(86_400_000))


def cycle_budget(left: Column, ms_left: Column, cycle_ms: int) -> Column:
    """Even share of what is left for each cycle until midnight."""
    return F.floor(left / F.greatest(F.ceil(ms_left / cycle_ms), F.lit(1)))


def parse_count(text: Column) -> Column:
    """1.2K, 3M and 4B as numbers; null if it is none."""
    clean = F.upper(F.regexp_replace(F.trim(text.cast("string")), ",", ""))
    pattern = r"^([0-9.]+)([KMB]?)$"
    unit = F.regexp_extract(clean, pattern, 2)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return js_round(F.regexp_extract(clean, pattern, 1).try_cast("double") * factor).cast("long")


def _decimals(n: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", n.cast("double"))


def format_count(n: Column) -> Column:
    """1234 as 1.2K, 12345 as 12K, 2000000 as 2M."""
    whole = js_round(n.cast("double"))
    short = lambda x, large, unit: F.concat(F.when(large, _decimals(x, 0)).otherwise(F.regexp_replace(_decimals(x, 1), r"\.0$", "")), F.lit(unit))
    return F.when(whole >= 1e6, short(whole / 1e6, whole >= 1e7, "M")).when(whole >= 1e3, short(whole / 1e3, whole >= 1e4, "K")).otherwise(whole.cast("string"))


def format_usd(n: Column) -> Column:
    """Dollars in B, M (two decimals) and K (one decimal)."""
    part = lambda x, digits, unit: F.concat(F.lit("$"), _decimals(x, digits), F.lit(unit))
    return F.when(n >= 1e9, part(n / 1e9, 2, "B")).when(n >= 1e6, part(n / 1e6, 2, "M")).when(n >= 1e3, part(n / 1e3, 1, "K")).otherwise(part(n, 0, ""))


def format_rate(n: Column) -> Column:
    """A count a minute; a dash if unknown."""
    part = lambda x, digits, unit: F.concat(_decimals(x, digits), F.lit(unit))
    return F.when(n >= 1e6, part(n / 1e6, 2, "M/min")).when(n >= 1e3, part(n / 1e3, 1, "k/min")).when(n.isNotNull(), F.concat(js_round(n.cast("double")).cast("string"), F.lit("/min"))).otherwise("—")


def format_age(minutes: Column) -> Column:
    """Days from a day on, hours from an hour on, else minutes."""
    whole = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    return F.when(minutes >= 1440, whole(minutes / 1440, "d")).when(minutes >= 60, whole(minutes / 60, "h")).when(minutes.isNotNull(), whole(minutes, "m"))


def engagement(likes: Column, retweets: Column, replies: Column) -> Column:
    """likes + 2 * retweets + replies, missing ones zero."""
    zero = F.lit(0)
    return F.coalesce(likes, zero) + 2 * F.coalesce(retweets, zero) + F.coalesce(replies, zero)


def engagement_rate(likes: Column, retweets: Column, replies: Column, views: Column) -> Column:
    """Engagement over views; null without views."""
    return F.when(views > 0, engagement(likes, retweets, replies) / views)


def plain_engagement_rate(likes: Column, replies: Column, retweets: Column, quotes: Column, views: Column) -> Column:
    """All four counts with equal weight over views; null without views (the early-window variant)."""
    zero = F.lit(0)
    return F.when(views > 0, (F.coalesce(likes, zero) + F.coalesce(replies, zero) + F.coalesce(retweets, zero) + F.coalesce(quotes, zero)) / views)


def ternary(value: Column) -> Column:
    """yes, no, unclear or missing."""
    s = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(s.isin("yes", "y", "1", "true"), "yes").when(s.isin("no", "n", "0", "false"), "no").when(s != "", "unclear").otherwise("missing")


def number(value: Column) -> Column:
    """A finite number, or null."""
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def model_reply(reply: Column) -> Column:
    """struct(score in 0..1, ticker, reason) of the first JSON object in a reply, with or without a code fence."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(found, "meme_score double, suggested_ticker string, reason string")
    return F.struct(F.least(F.greatest(parsed["meme_score"], F.lit(0.0)), F.lit(1.0)).alias("score"), parsed["suggested_ticker"].alias("ticker"), parsed["reason"].alias("reason"))


def token_cost(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column, input_price: float = 3.0, output_price: float = 15.0) -> Column:
    """Dollars for a model call, prices per million tokens; reads from a cache cost a tenth, writes a quarter more."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.greatest(F.lit(0.0), (n(input_tokens) * input_price + n(output_tokens) * output_price + n(cache_read) * input_price * 0.1 + n(cache_write) * input_price * 1.25) / 1e6)


# Seconds of the known timeframes.
TIMEFRAMES = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1H": 3600, "1h": 3600, "2H": 7200, "4H": 14400, "6H": 21600, "8H": 28800, "12H": 43200, "1D": 86400, "1d": 86400}


def timeframe_seconds(name: Column) -> Column:
    """A timeframe as seconds; anything else is an hour."""
    table = F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(name)), F.lit(3600))


def quote_kind(symbol: Column) -> Column:
    """sol, stable or other by the quote's symbol."""
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    return F.when(s.isin("SOL", "WSOL"), "sol").when(s.isin("USDC", "USDT", "USD"), "stable").otherwise("other")


def safety(mint_authority: Column, freeze_authority: Column, lp_locked: Column, lp_locked_pct: Column, top10_pct: Column) -> Column:
    """struct(mint_revoked, freeze_revoked, lp_burned, top10): no authority is a revoked one; unknown liquidity stays unknown."""
    locked = F.coalesce(lp_locked, F.lit(False)) | F.coalesce(lp_locked_pct >= 95, F.lit(False))
    return F.struct(
        mint_authority.isNull().alias("mint_revoked"), freeze_authority.isNull().alias("freeze_revoked"),
        F.when(lp_locked.isNotNull() | lp_locked_pct.isNotNull(), locked).alias("lp_burned"), top10_pct.cast("double").alias("top10"))
