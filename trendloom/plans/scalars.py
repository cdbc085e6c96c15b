"""Wide queries over the scalar functions that other queries don't reach, with their SQL.

Texts are made of part names, so that SQL can state what a function must give without repeating its patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text, values
from .registry import NOW, now, posts, query, r6, table


def _choice(column, options):
    """One of a few literals by a number's remainder."""
    return F.get(F.array(*map(F.lit, options)), (F.col(column) % len(options)).cast("int"))


def _choice_sql(column: str, options) -> str:
    return f"list_extract({list(options)!r}, ({column} % {len(options)} + 1)::INT)"


@query(
    f", t AS (SELECT post_id, views, likes, epoch_us(posted_at) AS p, epoch_us(TIMESTAMP '{NOW}') AS n FROM posts), a AS (SELECT *, (n - p) / 60000000 AS age, 86400000 - (p // 1000) % 86400000 AS left_ms FROM t) "
    "SELECT post_id, age, round((n - p) / 3600000000, 2) AS hours, left_ms, floor(views / greatest(ceil(left_ms / 120000), 1))::BIGINT AS share, n - p < 43200000000 AS young, views >= 1000 AND age <= 600 AS fast, "
    "greatest(CASE WHEN views % 250 <= 100 THEN 30 ELSE 300 END, least(100000, floor(greatest(views % 250, views) * least(greatest(age, 1) / 60, 1.0) + 0.5)))::BIGINT AS least_likes FROM a", "posts")
def post_timing(spark, sf_dir):
    """F21, F22, F23, F42, P5, P7."""
    p = posts(spark, sf_dir)
    posted, clock = values.millis(F.col("posted_at")), values.millis(now())
    age, left = values.age_minutes(posted, clock), values.millis_to_midnight(F.col("posted_at"))
    return p.select(
        "post_id", age.alias("age"), values.hours_between(F.col("posted_at"), now()).alias("hours"), left.alias("left_ms"), values.cycle_budget(F.col("views"), left, 120_000).alias("share"),
        values.within_max_age(posted, 720, clock).alias("young"), gates.fast_lane(F.col("views"), age, 1000, 600).alias("fast"),
        gates.effective_floor(F.col("views"), age, F.col("views") % 250, F.lit(500)).alias("least_likes"))


COUNTS = ["1,234", " 5k ", "2.5M", "3b", "x", "", "12", "1.2.3"]
FRAMES = ["1m", " 4H ", "1d", "2 weeks", "30m"]
QUOTES = ["sol", "WSOL ", "usdc", "USD", "bonk", ""]


@query(
    f"SELECT p_partkey, nullif({_choice_sql('p_partkey', [1234, 5000, 2500000, 3000000000, -1, -1, 12, -1])}, -1)::BIGINT AS parsed, "
    f"{_choice_sql('p_partkey', [60, 14400, 86400, 3600, 1800])} AS seconds, {_choice_sql('p_partkey', ['sol', 'sol', 'stable', 'stable', 'other', 'other'])} AS quote FROM part")
def parsed_values(spark, sf_dir):
    """F24, F46, F47."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", values.parse_count(_choice("p_partkey", COUNTS)).alias("parsed"), values.timeframe_seconds(_choice("p_partkey", FRAMES)).alias("seconds"), values.quote_kind(_choice("p_partkey", QUOTES)).alias("quote"))


#: One decimal of a whole number over a unit, halves up; without a zero decimal.
_ONE = "(({n} + {u} // 20) // ({u} // 10) // 10) || CASE WHEN ({n} + {u} // 20) // ({u} // 10) % 10 > 0 THEN '.' || ({n} + {u} // 20) // ({u} // 10) % 10 ELSE '' END"


@query(
    "WITH t AS (SELECT o_orderkey, (o_orderkey * 7919 % 60000000)::BIGINT AS n, (o_orderkey * 31 % 4000)::BIGINT AS m FROM orders) SELECT o_orderkey, "
    f"CASE WHEN n >= 10000000 THEN (n + 500000) // 1000000 || 'M' WHEN n >= 1000000 THEN {_ONE.format(n='n', u=1000000)} || 'M' WHEN n >= 10000 THEN (n + 500) // 1000 || 'K' WHEN n >= 1000 THEN {_ONE.format(n='n', u=1000)} || 'K' ELSE n::VARCHAR END AS count_text, "
    "CASE WHEN m >= 1440 THEN m // 1440 || 'd' WHEN m >= 60 THEN m // 60 || 'h' ELSE m || 'm' END AS age_text, "
    "CASE WHEN m < 1000 THEN '$' || m ELSE '$' || (m + 50) // 100 // 10 || '.' || (m + 50) // 100 % 10 || 'K' END AS usd_text, CASE WHEN m < 1000 THEN m || '/min' ELSE (m + 50) // 100 // 10 || '.' || (m + 50) // 100 % 10 || 'k/min' END AS rate_text FROM t")
def formatted_numbers(spark, sf_dir):
    """F25."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 60_000_000).alias("n"), (F.col("o_orderkey") * 31 % 4000).alias("m"))
    return o.select("o_orderkey", values.format_count(F.col("n")).alias("count_text"), values.format_age(F.col("m")).alias("age_text"), values.format_usd(F.col("m")).alias("usd_text"), values.format_rate(F.col("m")).alias("rate_text"))


@query(
    "SELECT l_orderkey, l_linenumber, round(least(l_extendedprice / greatest(l_quantity * 1000, 1) / 3, 1) * 0.4 + least(l_partkey / 4800, 1) * 0.25 + least(greatest(l_quantity - 20, 0) / 85, 1) * 0.2 + least(l_discount * 10 / 55, 1) * 0.15, 6) AS trend, "
    "round((l_partkey * 3 + l_suppkey * 15 + l_linenumber * 0.3 + l_orderkey * 3.75) / 1000000, 9) AS cost, "
    "l_quantity >= 10 AND l_extendedprice >= 20000 AS won, l_quantity < 1.5 AND l_linenumber >= 1 AS lost, l_quantity <= 40 AND l_extendedprice <= 50000 AND l_returnflag <> 'R' AS sane, "
    "CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag WHEN l_linestatus IN ('A', 'N') THEN l_linestatus ELSE 'A' END AS cohort, "
    "l_returnflag <> 'A' AS mint_revoked, l_returnflag <> 'N' AS freeze_revoked, CASE WHEN l_linenumber > 1 THEN l_quantity >= 25 END AS lp_burned FROM lineitem")
def token_checks(spark, sf_dir):
    """F29, F40, F41, F44, P10, P11."""
    l = table(spark, sf_dir, "lineitem")
    c = F.col
    safe = values.safety(F.when(c("l_returnflag") == "A", "x"), F.when(c("l_returnflag") == "N", "x"), F.lit(None).cast("boolean"), F.when(c("l_linenumber") > 1, c("l_quantity") * 3.8), c("l_quantity"))
    trend = gates.trend_score(c("l_extendedprice"), c("l_quantity") * 1000, c("l_partkey"), c("l_quantity") - 20, c("l_discount") * 10)
    found = l.select(
        "l_orderkey", "l_linenumber", trend.alias("trend"), values.token_cost(c("l_partkey"), c("l_suppkey"), c("l_linenumber"), c("l_orderkey")).alias("cost"),
        gates.strict_winner(c("l_quantity"), c("l_extendedprice"), 10.0, 20_000).alias("won"), gates.strict_loser(c("l_quantity"), c("l_linenumber")).alias("lost"),
        gates.passes_sanity(c("l_quantity"), c("l_extendedprice"), c("l_returnflag"), ["R"], 40, 50_000).alias("sane"), gates.cohort(c("l_returnflag"), c("l_linestatus"), ["A", "N"]).alias("cohort"), safe.alias("s"))
    return found.select("l_orderkey", "l_linenumber", r6("trend"), F.round("cost", 9).alias("cost"), "won", "lost", "sane", "cohort", "s.mint_revoked", "s.freeze_revoked", "s.lp_burned")


_WORD = "split_part(p_name, ' ', {})"
_TITLE = "upper(left({w}, 1)) || substr({w}, 2)"


@query(
    f"SELECT p_partkey, 'Look At ' || {_TITLE.format(w=_WORD.format(1))} || ' ' || {_TITLE.format(w=_WORD.format(2))} AS title, 'Look at ' || p_name || '! more' AS blurb, p_size % 2 = 0 AS noise, "
    "array_to_string(CASE WHEN p_size % 2 = 0 THEN [split_part(p_name, ' ', 1) || '_fan', split_part(p_name, ' ', 1), 'fan'] ELSE ['brandful'] END, ',') AS handle_words, "
    "CASE p_size % 3 WHEN 0 THEN upper(split_part(p_name, ' ', 2)) WHEN 1 THEN p_name ELSE 'kept' END AS subject, "
    "CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS proposals, p_size % 3 = 0 AS pickup, p_size % 5 = 0 AS own_mint, p_size % 5 = 1 AS wrong_mint, CASE WHEN p_size % 3 = 1 THEN least(p_size / 50, 0.3) ELSE p_size / 50 END AS capped, "
    "'https://ipfs.io/ipfs/Qm' || p_partkey AS image FROM part")
def text_rules(spark, sf_dir):
    """F4, F7, F12, F14, F16, F17, F45."""
    p, even, third = table(spark, sf_dir, "part"), F.col("p_size") % 2 == 0, F.col("p_size") % 3
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    post = F.concat(F.lit("Look at "), F.col("p_name"), F.lit("! https://x.co/1 @someone #tag more"))
    handle = F.when(even, F.concat(F.lit("@"), F.initcap(first), F.lit("_fan"))).otherwise("@Brandful")
    title = text.first_clause_title(post)
    mint, other = "9xQeWvG816bUx9EPjHmaT23yvVM2ZWbrrpZb9PusVFin", "So11111111111111111111111111111111111111112"
    letters = F.regexp_replace(F.upper(last), "[^A-Z]", "")
    ticker = F.when(third == 0, letters)
    call = F.concat(F.lit("someone deploy "), F.when(third == 0, F.concat(F.lit("$"), letters, F.lit(" now"))).otherwise(""), F.when(F.col("p_size") % 5 == 0, f" {mint}").when(F.col("p_size") % 5 == 1, f" {other}").otherwise(""))
    return p.select(
        "p_partkey", title.alias("title"), text.blurb(post).alias("blurb"), text.title_is_noise(title, F.when(even, F.array(first)).otherwise(F.array(F.lit("absent")))).alias("noise"),
        F.array_join(text.handle_tokens(handle), ",").alias("handle_words"), text.subject_entity(ticker, F.when(third == 1, F.col("p_name")), F.lit("kept"), post, handle).alias("subject"),
        text.proposal_count(call).alias("proposals"), text.is_pickup(call).alias("pickup"), text.mentions_own(call, F.lit(mint)).alias("own_mint"), text.mentions_wrong(call, F.lit(mint)).alias("wrong_mint"),
        text.nameability_capped(F.col("p_size") / 50, F.when(third == 1, "MOON").otherwise("ZORBLE"), F.lit("a zorble")).alias("capped"),
        text.ipfs_url(F.concat(F.when(even, "ipfs://").otherwise("https://other.host/ipfs/"), F.lit("Qm"), F.col("p_partkey"))).alias("image"))


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN 0.0 WHEN 0 THEN 1.0 ELSE p_size / 100 END AS score, CASE WHEN p_size % 4 <> 3 THEN upper(split_part(p_name, ' ', 2)) END AS ticker, CASE WHEN p_size % 4 <> 3 THEN p_name END AS reason FROM part")
def model_replies(spark, sf_dir):
    """plain, fenced and broken replies; scores held to 0 ... 1, none is 0."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 4
    body = F.to_json(F.struct(F.when(kind == 0, 7.5).otherwise(F.col("p_size") / 100).alias("meme_score"), F.upper(F.split("p_name", " ")[1]).alias("suggested_ticker"), F.col("p_name").alias("reason")))
    reply = F.when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n"))).when(kind == 3, "no answer").otherwise(body)
    got = values.model_reply(reply)
    return p.select("p_partkey", got["score"].alias("score"), got["ticker"].alias("ticker"), got["reason"].alias("reason"))


@query(
    ", t AS (SELECT post_id, views * 100 AS v, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us(posted_at)) / 60000000 AS age, post_id % 4 AS k FROM posts) SELECT post_id, CASE WHEN age > 900 THEN 'too_old' WHEN v < 20000 THEN 'below_views' WHEN k = 0 THEN 'ct_pickup' WHEN k = 1 THEN 'ticker_proposal' WHEN post_id % 3 >= 2 THEN 'replication' ELSE 'no_signal' END AS gate FROM t", "posts")
def video_gate(spark, sf_dir):
    """the first rule that fits."""
    p = posts(spark, sf_dir)
    said = F.when(F.col("post_id") % 4 == 0, "a memecoin").when(F.col("post_id") % 4 == 1, "wen coin").otherwise("a cat")
    age = values.age_minutes(values.millis(F.col("posted_at")), values.millis(now()))
    return p.select("post_id", gates.vision_gate(age, F.col("views") * 100, said, F.col("post_id") % 3, 20_000, 900).alias("gate"))
