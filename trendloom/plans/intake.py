"""Queries over parsers, sinks, lookups and composites, whose inputs are made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text, values
from ..operators import budget, feeds, market, narratives, reports, tables
from ..sources import files
from ..streaming import pipelines
from .market import BARS
from .registry import now, query, r6, table, trades

WORDS = "split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2"
ROW = "l_orderkey * 10 + l_linenumber"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("SELECT o_orderkey::VARCHAR AS id, c_name AS handle, c_custkey AS followers, CASE WHEN p_partkey IS NOT NULL THEN p_name END AS media_url FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING' LEFT JOIN part ON o_orderstatus = 'F' AND p_partkey = o_orderkey")
def official_posts(spark, sf_dir):
    """Authors and media of posts, each missing for some."""
    o, c, p = (table(spark, sf_dir, n) for n in ("orders", "customer", "part"))
    posts = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("author_id"), F.when(F.col("o_orderstatus") == "F", F.array("o_orderkey")).alias("media_keys"))
    users = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_custkey").alias("followers"))
    return files.with_includes(posts, users, p.select(F.col("p_partkey").alias("media_key"), F.col("p_name").alias("url"), F.lit("photo").alias("type"))).select("id", "handle", "followers", "media_url")


@query("SELECT event_id, greatest(value, k) AS peak, value AS first, k AS last FROM (SELECT event_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) WHERE value <> 0 OR k <> 0")
def trend_payloads(spark, sf_dir):
    """The first extracted value of each point, zero for none."""
    k = F.get_json_object("props", "$.k").cast("double")
    point = lambda *v: F.struct(F.array(*[F.struct(x.alias("extracted_value")) for x in v]).alias("values"))
    none = F.lit(None).cast("double")
    line = F.array(point(none, F.col("value")), point(none, none), point(k, F.lit(7.0)))
    raw = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct(line.alias("timeline_data")).alias("interest_over_time"))).alias("p"))
    return files.parse_trend(raw, "event_id", "p").where("series[1] = 0").select("event_id", "peak", F.col("series")[0].alias("first"), F.col("series")[2].alias("last"))


@query(f"SELECT {ROW} AS id, epoch_us(l_shipdate) // 1000000 AS t, l_quantity AS o, l_extendedprice AS c, l_tax AS v FROM lineitem UNION ALL SELECT {ROW}, epoch_us(l_shipdate) // 1000000 + 60, l_extendedprice, l_discount, 1.0 FROM lineitem WHERE l_discount > 0")
def candle_payloads(spark, sf_dir):
    """Rows as arrays or as objects, without those that close at zero."""
    c, t = F.col, F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    bars = [(t, c("l_quantity"), c("l_extendedprice"), c("l_tax")), (t + 60, c("l_extendedprice"), c("l_discount"), F.lit(1.0))]
    arrays = F.to_json(F.array(*[F.array(a.cast("double"), o, o, o, x, v) for a, o, x, v in bars]))
    objects = F.to_json(F.array(*[F.struct(a.alias("unix_time"), o.alias("o"), o.alias("h"), o.alias("l"), x.alias("c"), v.alias("v")) for a, o, x, v in bars]))
    raw = _lines(spark, sf_dir).select("id", F.when(c("l_linenumber") % 2 == 0, arrays).otherwise(objects).alias("p"))
    return files.parse_candles(raw, "id", "p").select("id", F.col("unixTime").alias("t"), "o", "c", "v")


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS token_amount, CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 100 ELSE 0 END AS sol_amount, "
    "CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN l_extendedprice WHEN l_linenumber % 3 <> 0 THEN l_extendedprice ELSE l_extendedprice * 2 END AS usd FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT l_orderkey::VARCHAR AS tx, l_linenumber::VARCHAR AS wallet, side, round(token_amount, 4) AS token_amount, round(sol_amount, 4) AS sol_amount, round(usd, 4) AS usd, round(usd / token_amount, 8) AS price FROM t")
def swap_legs(spark, sf_dir):
    """The value from the native leg, the token leg or the volume."""
    c, none = F.col, F.lit(None).cast("double")
    leg = lambda a, s, u, n, p: F.struct(F.lit(a).alias("address"), s.alias("symbol"), u.alias("uiAmount"), n.alias("amount"), p.alias("price"))
    token = leg("mInTaaaa", F.lit("WIF"), F.when(c("l_linenumber") % 2 == 0, none).otherwise(c("l_quantity")), -c("l_quantity"), F.when(c("l_linenumber") % 3 != 0, c("l_extendedprice") / c("l_quantity")))
    quote = leg("other", F.when(c("l_linestatus") == "O", "sol").otherwise("USDC"), c("l_extendedprice") / 100, none, F.when(c("l_discount") > 0.05, 100.0).otherwise(0.0))
    swaps = table(spark, sf_dir, "lineitem").select(
        F.when(c("l_returnflag") == "R", token).otherwise(quote).alias("from"), F.when(c("l_returnflag") == "A", token).otherwise(quote).alias("to"), F.unix_seconds(c("l_shipdate").cast("timestamp")).alias("blockUnixTime"),
        c("l_linenumber").cast("string").alias("owner"), (c("l_extendedprice") * 2).alias("volumeUSD"), c("l_orderkey").cast("string").alias("txHash"))
    return market.swap_trades(swaps, "MintAAAA").select("tx", "wallet", "side", *[F.round(x, 4).alias(x) for x in ("token_amount", "sol_amount", "usd")], F.round("price", 8).alias("price"))


@query(f"SELECT 'm' || p_partkey AS mint, upper(w2) AS symbol, p_name AS name, p_size % 3 = 0 AS sol_quote, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN p_size * 2.0 ELSE p_size * 10.0 END AS mcap, p_size * 1.0 AS liquidity FROM (SELECT *, {WORDS} FROM part) WHERE p_size % 5 <> 0")
def pair_payloads(spark, sf_dir):
    """Pairs without an address drop out; the market value falls back to the diluted one."""
    size = F.col("p_size")
    mint = F.struct(F.concat(F.lit("m"), F.col("p_partkey")).alias("address"), F.split("p_name", " ")[1].alias("symbol"), F.col("p_name").alias("name"))
    body = F.struct(
        F.when(size % 5 != 0, "pair").alias("pairAddress"), F.col("p_retailprice").cast("string").alias("priceUsd"), F.when(size % 2 == 0, size * 2.0).alias("marketCap"), (size * 10.0).alias("fdv"),
        F.struct(size.cast("double").alias("usd")).alias("liquidity"), mint.alias("baseToken"), F.struct(F.when(size % 3 == 0, "wsol").otherwise("USDC").alias("symbol")).alias("quoteToken"))
    return files.map_pairs(table(spark, sf_dir, "part").select(F.to_json(body).alias("value"))).select("mint", "symbol", "name", "sol_quote", "price", "mcap", "liquidity")


@query("SELECT p_partkey, p_name || ' says \"hi\", ' || chr(10) || p_brand AS note, p_retailprice AS price, 42 AS seed FROM part")
def csv_round_trip(spark, sf_dir):
    """Quotes, commas and line breaks, written and read again, with the meta file beside them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' says "hi", \n'), "p_brand").alias("note"), F.col("p_retailprice").alias("price"))
    folder = pipelines.new_folder(spark, "csv")
    files.write_csv(p, folder, {"seed": 42})
    return files.read_csv(spark, folder, "p_partkey long, note string, price double").withColumn("seed", F.lit(files.read_meta(spark, folder)["seed"]))


@query("SELECT o_orderpriority AS stage, max(o_orderkey) AS last, count(*) AS n FROM orders GROUP BY 1")
def stage_state(spark, sf_dir):
    """A stage's state, written twice and read as it was last."""
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.max("o_orderkey").alias("last"), F.count(F.lit(1)).alias("n"))
    folder = pipelines.new_folder(spark, "state")
    files.write_state(state.withColumn("n", F.lit(0)), folder)
    files.write_state(state, folder)
    return files.read_state(spark, folder, state.schema)


@query("SELECT event_id, event_type FROM events")
def appended_log(spark, sf_dir):
    """A log that two writers add to."""
    e, folder = table(spark, sf_dir, "events").select("event_id", "event_type"), pipelines.new_folder(spark, "log")
    files.append(e.where("event_type = 'error'"), folder)
    files.append(e.where("event_type <> 'error' or event_type is null"), folder)
    return spark.read.schema(e.schema).parquet(folder)


@query("SELECT o_orderkey::VARCHAR AS row_id, CASE WHEN o_orderkey % 3 <> 2 THEN 'c' || o_custkey END AS author, NULL::VARCHAR AS missing, CASE o_orderkey % 4 WHEN 0 THEN 12.5 WHEN 3 THEN -3.0 END AS amount FROM orders")
def canonical_rows(spark, sf_dir):
    """Aliases and blanks, numbers that are none."""
    key, name = F.col("o_orderkey"), F.concat(F.lit(" c"), F.col("o_custkey"))
    raw = table(spark, sf_dir, "orders").select(
        key.alias("Row"), F.when(key % 3 == 0, name).otherwise("  ").alias("author"), F.when(key % 3 == 1, name).alias("by_line"), F.get(F.array(*map(F.lit, (" 12.5 ", "NaN", "Infinity", "-3"))), (key % 4).cast("int")).alias("amount"))
    rows = files.canonical(raw, {"row_id": ["Row"], "author": ["by_line"]}, ["row_id", "author", "missing", "amount"])
    return rows.withColumn("amount", values.number(F.col("amount")))


@query(
    f"SELECT p_partkey, p_size % 4 <> 3 AND (p_size % 4 <> 1 OR p_size % 2 = 0 OR p_size % 5 = 0) AND (p_size % 4 <> 2 OR w2 LIKE '%in%' OR w1 LIKE '%in%') AS pair_hit, "
    f"p_size % 3 = 0 OR (p_size % 3 = 1 AND length(w1) >= 4) AS term_hit FROM (SELECT *, {WORDS} FROM part)")
def seed_matches(spark, sf_dir):
    """By symbol, name or address, and by a term's length."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    mint = F.when(size % 5 == 0, F.lit("9" * 40)).otherwise("9" * 20)
    asked = F.when(size % 4 == 0, F.concat(F.lit(" "), F.upper(last))).when(size % 4 == 1, "9").when(size % 4 == 2, "IN").otherwise("  ")
    term = F.when(size % 3 == 0, F.concat(F.lit("$"), last)).when(size % 3 == 1, F.initcap(first)).otherwise("")
    return p.select("p_partkey", text.pair_matches(F.concat(F.lit("$"), last), F.col("p_name"), mint, asked).alias("pair_hit"), text.hit_matches(F.upper(last), F.col("p_name"), term).alias("term_hit"))


@query("SELECT o_orderkey AS mint, o_custkey % 50 = 0 AS is_seed FROM orders ORDER BY is_seed DESC, o_orderdate DESC, o_orderkey LIMIT 500")
def discovery_order(spark, sf_dir):
    """The first 500 tokens to work on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mint"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("launch_ms"), "o_custkey")
    return market.discovery_order(o.drop("o_custkey"), o.where("o_custkey % 50 = 0"), "mint").limit(500).select("mint", "is_seed")


@query(
    "WITH o AS (SELECT o_custkey AS g, o_orderkey AS k FROM orders), t AS (SELECT DISTINCT g, 'WIF' AS ticker, 0.0::DOUBLE AS s, NULL AS n, NULL AS h, -1 AS o FROM o WHERE k % 3 IN (0, 2) UNION ALL SELECT DISTINCT g, 'BONK', 0.0, NULL, NULL, -1 FROM o WHERE k % 3 = 2 "
    "UNION ALL SELECT g, CASE WHEN k % 4 = 0 THEN 'WIF' ELSE 'POPCAT' END, (k % 10) / 10, CASE WHEN k % 5 > 0 THEN 'name' || (k % 7) END, 'h' || (k % 11), k FROM o WHERE k % 4 < 2), "
    "a AS (SELECT g, ticker, max(s) AS meme_score, arg_max(n, o) FILTER (WHERE n IS NOT NULL) AS n, arg_max(h, o) FILTER (WHERE h IS NOT NULL) AS endorsed_by FROM t GROUP BY ALL) "
    "SELECT g AS narrative_id, ticker, coalesce(n, upper(left(ticker, 1)) || lower(substr(ticker, 2))) AS name, meme_score, endorsed_by, row_number() OVER (PARTITION BY g ORDER BY meme_score DESC, ticker) = 1 AS canonical FROM a")
def ticker_rollup(spark, sf_dir):
    """Cashtags and suggestions of each narrative's posts."""
    k = F.col("o_orderkey")
    posts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("narrative_id"), k.alias("post_id"), F.when(k % 3 == 0, "buy $wif now").when(k % 3 == 1, "no tags").otherwise("$BONK and $WIF").alias("text"), F.when(k % 4 == 0, "$wif").when(k % 4 == 1, "POPCAT").alias("suggested_ticker"),
        F.when(k % 5 > 0, F.concat(F.lit("name"), k % 7)).alias("suggested_name"), F.concat(F.lit("h"), k % 11).alias("handle"), ((k % 10) / 10).alias("meme_score"))
    return narratives.tickers(posts)


@query(f"SELECT p_brand AS narrative_id, sum(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS ticker_proposals, bool_or(p_size % 3 = 0) AS ct_pickup, coalesce(string_agg(DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(w2) END, ',' ORDER BY CASE WHEN p_size % 3 = 0 THEN upper(w2) END), '') AS tickers FROM (SELECT *, {WORDS} FROM part) GROUP BY p_brand")
def proposal_signals(spark, sf_dir):
    """A12."""
    call = F.concat(F.lit("someone deploy "), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("$"), F.split("p_name", " ")[1], F.lit(" now"))).otherwise(""))
    s = narratives.signals(table(spark, sf_dir, "part").select(F.col("p_brand").alias("narrative_id"), call.alias("text")))
    return s.select("narrative_id", "ticker_proposals", "ct_pickup", F.array_join("proposal_tickers", ",").alias("tickers"))


@query(
    "WITH f AS (SELECT o_orderpriority AS p, count(*) AS t, count(*) FILTER (WHERE o_totalprice >= 100000) AS a, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_orderstatus = 'O') AS b, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_orderstatus = 'O' AND o_orderkey % 20 = 0) AS c FROM orders GROUP BY 1) "
    "SELECT p AS priority, array_to_string(list_filter([CASE WHEN t > 0 AND a / t < 0.45 THEN 'large' END, CASE WHEN a > 0 AND b / a < 0.45 THEN 'open' END, CASE WHEN b > 0 AND c / b < 0.45 THEN 'chosen' END], lambda x: x IS NOT NULL), ',') AS weak FROM f")
def funnel_bottlenecks(spark, sf_dir):
    """The steps of a funnel that keep too little."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    f = budget.funnel(o, ["priority"], {"large": F.col("o_totalprice") >= 100_000, "open": F.col("o_orderstatus") == "O", "chosen": F.col("o_orderkey") % 20 == 0})
    return budget.bottlenecks(f, ["large", "open", "chosen"], 0.45).select("priority", F.array_join("bottlenecks", ",").alias("weak"))


@query("SELECT o_orderkey, least(greatest(o_orderkey % 61 + CASE WHEN o_custkey % 3 > o_orderkey % 3 THEN 5 WHEN o_custkey % 3 < o_orderkey % 3 THEN -5 ELSE 0 END, 15), 45) AS share_pct FROM orders")
def media_share(spark, sf_dir):
    """In per cent."""
    share = budget.lane_share((F.col("o_orderkey") % 61) / 100, F.col("o_custkey") % 3, F.col("o_orderkey") % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(share * 100).cast("long").alias("share_pct"))


@query(
    f"WITH p AS (SELECT *, {WORDS}, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part WHERE p_size % 2 = 0), t AS (SELECT p_partkey AS v, CASE WHEN length(w1) < 4 THEN CASE WHEN length(w2) < 4 THEN '' ELSE w2 END WHEN length(w2) < 4 THEN w1 WHEN length(w1) > length(w2) OR (length(w1) = length(w2) AND w1 < w2) THEN w1 || ' ' || w2 ELSE w2 || ' ' || w1 END AS term FROM p WHERE r = 1) "
    "SELECT term, max(v) AS views FROM t WHERE term <> '' GROUP BY term ORDER BY views DESC, term LIMIT 10")
def confirmation_terms(spark, sf_dir):
    """The top ten."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("narrative_id"), F.col("p_partkey").alias("post_id"), F.col("p_partkey").alias("views"), F.concat(F.lit("a "), F.col("p_name")).alias("text"), F.lit("zz").alias("handle"), F.when(F.col("p_size") % 2 == 0, "x").otherwise("tt").alias("platform"))
    return feeds.confirmation_terms(p, 10)


@query("WITH f AS (SELECT user_id, ts, value, min(ts) OVER (PARTITION BY user_id) AS first FROM events) SELECT user_id AS post_id FROM f WHERE epoch_us(ts) // 1000 - epoch_us(first) // 1000 <= 43200000 GROUP BY user_id HAVING max(floor(value)) >= 150")
def stream_near_misses(spark, sf_dir):
    """T6 as a stream: posts that reach the floor within their time to live."""
    e = table(spark, sf_dir, "events")
    rows = pipelines.source(spark, f"{sf_dir}/events.parque[t]", e.schema).select(F.col("user_id").alias("post_id"), F.floor("value").alias("views"), F.col("ts").cast("timestamp").alias("at"))
    out = pipelines.replayed(pipelines.near_misses(rows, 150, late="60 days").where("outcome = 'promoted'").select("post_id"), None, "near-misses")
    return spark.read.schema("post_id long").parquet(out)


@query(
    "WITH t AS (SELECT p_partkey, p_size % 6 AS v, p_size % 3 AS late, p_size % 2 = 0 AS named, p_size % 5 = 0 AS own, p_size % 5 = 1 AS alien, p_size % 7 = 0 AS large FROM part), "
    "s AS (SELECT *, named AND alien AS wrong, CASE WHEN named THEN 0.39 ELSE 0 END + [0.15, 0.05, -0.35][late + 1] + CASE WHEN own THEN 0.4 ELSE 0 END + CASE WHEN named AND alien THEN -0.6 WHEN named THEN 0.2 ELSE 0 END + [-0.25, -0.1, 0.05, 0.25, 0.3, 0.4][v + 1] + CASE WHEN NOT named THEN 0.05 ELSE 0 END + CASE WHEN large THEN 0.1 ELSE 0 END AS raw FROM t), "
    "c AS (SELECT *, CASE WHEN wrong THEN least(raw, 0.2) ELSE raw END AS one FROM s) SELECT p_partkey, wrong AS wrong_address, round(least(greatest(CASE WHEN NOT own AND v < 3 THEN least(one, 0.34) ELSE one END, 0), 1), 6) AS score FROM c")
def match_scores(spark, sf_dir):
    """points of a post as the source of a token."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    mint, other = "9xQeWvG816bUx9EPjHmaT23yvVM2ZWbrrpZb9PusVFin", "So11111111111111111111111111111111111111112"
    said = F.concat(F.when(size % 2 == 0, "look zorble quux $ZRBL").otherwise("look here"), F.when(size % 5 == 0, f" {mint}").when(size % 5 == 1, f" {other}").otherwise(""))
    views = F.get(F.array(*map(F.lit, (500, 5_000, 20_000, 60_000, 600_000, 2_000_000))), (size % 6).cast("int"))
    late = F.get(F.array(*map(F.lit, (0, 30, 120))), (size % 3).cast("int")) * 60_000
    post = {"text": said, "posted_ms": late, "views": views, "media": F.when(size % 2 == 1, "photo"), "followers": F.when(size % 7 == 0, 600_000).otherwise(10)}
    found = gates.match_confidence(post, {"ticker": F.lit("$ZRBL"), "name": F.lit("Zorble Quux"), "mint": F.lit(mint), "launch_ms": F.lit(0)})
    return p.select("p_partkey", found["wrong_address"].alias("wrong_address"), F.round(found["score"], 6).alias("score"))


@query("SELECT p_partkey AS post_id, '@' || lower(p_brand) AS handle, 'Look at ' || p_name || '! more' AS blurb, p_size::VARCHAR AS views, CASE WHEN p_size >= 24 THEN p_size // 24 || 'd' ELSE p_size || 'h' END AS age FROM part WHERE p_size > 0")
def view_rows(spark, sf_dir):
    """P18."""
    p = table(spark, sf_dir, "part").where("p_size > 0")
    return feeds.view_rows(p.select(F.col("p_partkey").alias("post_id"), F.concat(F.lit("@"), "p_brand").alias("handle"), F.concat(F.lit("Look at "), "p_name", F.lit("! https://x.co/1 @someone #tag more")).alias("text"), F.col("p_size").alias("views"), (now() - F.make_dt_interval(hours=F.col("p_size"))).alias("posted_at")), now())


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 48)")
def unlabelled_tokens(spark, sf_dir):
    """J8, U4."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return tables.without_known(table(spark, sf_dir, "part").select("p_partkey"), done, "p_partkey")


@query("SELECT l_orderkey, l_linenumber, s_name AS name, round(s_acctbal, 2) AS balance FROM lineitem LEFT JOIN supplier ON l_partkey = s_suppkey")
def candidate_tokens(spark, sf_dir):
    """Each candidate with its token, where there is one: part numbers read as suppliers', of which there are fewer."""
    tokens = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mint"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("mint"))
    return tables.embed_parent(rows, tokens, "mint", "token").select("l_orderkey", "l_linenumber", "token.name", F.round("token.balance", 2).alias("balance"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN 0 WHEN split_part(p_name, ' ', 2) = 'ring' THEN 1 ELSE 1 / 3 END, 6) AS overlap FROM part")
def token_overlap(spark, sf_dir):
    """Of a name's words with its first and one other."""
    words = F.split("p_name", " ")
    other = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(words[0], F.lit("ring")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(words, other), 6).alias("overlap"))


@query(
    f"WITH t AS (SELECT l_partkey AS mint, {ROW} AS pool, l_extendedprice - 20000 AS reserve, l_extendedprice - 20000 + CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice * 0.02 END + CASE WHEN l_returnflag = 'R' THEN 50000 ELSE 0 END - least(CASE WHEN l_linestatus = 'F' THEN 0 ELSE abs(epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1998-01-01')) / 60000000 END, 10000) AS s FROM lineitem), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY round(s, 4) DESC, pool) AS k FROM t WHERE reserve > 0) SELECT mint, pool, round(s, 4) AS score FROM r WHERE k = 1")
def best_pools(spark, sf_dir):
    """K9."""
    c = F.col
    pools = _lines(spark, sf_dir).select(
        c("l_partkey").alias("mint"), c("id").alias("pool"), (c("l_extendedprice") - 20_000).alias("reserve"), F.when(c("l_linenumber") != 1, c("l_extendedprice") * 2).alias("volume"), (c("l_returnflag") == "R").alias("is_pump"),
        F.unix_millis(c("l_shipdate").cast("timestamp")).alias("created_ms"), F.when(c("l_linestatus") != "F", F.unix_millis(F.lit("1998-01-01 00:00:00").cast("timestamp"))).alias("launch_ms"))
    return market.best_pool(pools).select("mint", "pool", F.round("score", 4).alias("score"))


SORTED = "(SELECT p_partkey, '{m}' AS mode FROM part ORDER BY p_brand = 'Brand#13' DESC, {o}, p_partkey LIMIT 20)"


@query(" UNION ALL ".join(SORTED.format(m=m, o=o) for m, o in (("views", "p_size DESC"), ("gain", "CASE WHEN p_size % 4 > 0 THEN p_retailprice END DESC NULLS LAST"), ("age", "p_size"))))
def narrative_sorts(spark, sf_dir):
    """The first twenty of three modes, pinned ones first."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("combined_views"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("gain_24h"), F.col("p_size").alias("age_min"))
    first = lambda mode: feeds.sorted_narratives(p, mode, "p_partkey", F.col("p_brand") == "Brand#13").limit(20).select("p_partkey", F.lit(mode).alias("mode"))
    return first("views").union(first("gain")).union(first("age"))


@query("WITH t AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)) SELECT p_name FROM t WHERE ((i - 30) % n + n) % n < 10")
def hashtag_batch(spark, sf_dir):
    """The fourth batch of ten terms."""
    return tables.round_robin(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", 3, 10)


@query(
    BARS + ", k AS (SELECT mint, max_by(c, t) AS current_mcap, greatest(min_by(o, t), max(h)) / min_by(o, t) AS m, greatest(min_by(o, t), max(h)) AS peak FROM b GROUP BY mint), "
    f"q AS (SELECT l_suppkey AS mint, {ROW} AS pair, l_extendedprice AS liquidity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linestatus = 'O' DESC, l_quantity DESC, l_extendedprice DESC, {ROW}) AS r FROM lineitem) "
    "SELECT k.mint, pair, liquidity, round(m, 6) AS peak_multiple, CASE WHEN m >= 1.5 AND coalesce(liquidity >= 60000, false) AND NOT (m < 1.2 OR liquidity IS NULL) THEN 'winner' WHEN (m < 1.2 OR liquidity IS NULL) AND NOT (m >= 1.5 AND coalesce(liquidity >= 60000, false)) THEN 'loser' ELSE 'ignored' END AS outcome FROM k LEFT JOIN q ON k.mint = q.mint AND q.r = 1 WHERE m <= 3 AND peak <= 2500 AND k.mint <> 7", "trades")
def classified_tokens(spark, sf_dir):
    """B1 over monthly candles: peaks, best pair (that of the supplier of the same number, if there is one), plausibility and outcome; the market value is that of one unit."""
    order = F.struct("ts", "id")
    bars = trades(spark, sf_dir).groupBy("mint", F.date_trunc("month", "ts").alias("t")).agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.max_by("price", order).alias("c"))
    pairs = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("mint"), F.col("id").alias("pair"), (F.col("l_linestatus") == "O").alias("sol_quote"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("liquidity"))
    found = market.classified_tokens(bars, pairs, [7], 1.0, 3.0, 2500.0, win_multiple=1.5, lose_multiple=1.2, win_usd=60_000)
    return found.select("mint", "pair", "liquidity", r6("peak_multiple"), "outcome")


@query(
    "WITH t AS (SELECT l_quantity / 5 AS m, l_extendedprice AS a, l_returnflag <> 'N' AS viral, l_discount * 100 AS hours, l_returnflag AS media, l_linestatus = 'O' AS f1, l_linenumber % 3 AS f2 FROM lineitem), o AS (SELECT *, CASE WHEN m >= 5 THEN 'ran' WHEN m < 2 THEN 'fizzled' ELSE 'middle' END AS outcome FROM t), "
    "g AS (SELECT CASE WHEN viral THEN 'viral' ELSE 'other' END AS grp, count(*)::DOUBLE AS n, median(m)::DOUBLE AS median_peak, median(a)::DOUBLE AS median_mcap, count(*) FILTER (WHERE m >= 5) * 100.0::DOUBLE / count(*) AS ran_pct FROM t GROUP BY 1), v AS (SELECT * FROM o WHERE viral AND outcome <> 'middle'), "
    "u AS (SELECT 'outcomes' AS section, outcome AS grp, 'n' AS metric, count(*)::DOUBLE AS value FROM o GROUP BY outcome UNION ALL SELECT 'groups', grp, metric, value FROM g UNPIVOT (value FOR metric IN (n, median_peak, median_mcap, ran_pct)) "
    "UNION ALL SELECT 'labels', outcome, 'listed', count(*) FILTER (WHERE f1) * 100.0 / count(*) FROM v GROUP BY outcome UNION ALL SELECT 'labels', outcome, 'said', count(*) FILTER (WHERE f2 = 0) * 100.0 / nullif(count(*) FILTER (WHERE f2 <> 1), 0) FROM v GROUP BY outcome "
    "UNION ALL SELECT 'timing', outcome, 'hours', median(hours) FROM v GROUP BY outcome UNION ALL SELECT 'media', outcome, media, count(*) FROM v GROUP BY outcome, media) SELECT section, grp, metric, round(value, 6) AS value FROM u")
def reveal_report(spark, sf_dir):
    """What set the rows apart once the answers are known."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        (c("l_quantity") / 5).alias("peak_multiple"), c("l_extendedprice").alias("ath_mcap"), (c("l_returnflag") != "N").alias("viral"), (c("l_discount") * 100).alias("hours"), c("l_returnflag").alias("media"),
        F.when(c("l_linestatus") == "O", "yes").otherwise("No").alias("listed"), F.get(F.array(*map(F.lit, ("Y", "unclear", "no"))), (c("l_linenumber") % 3).cast("int")).alias("said"))
    return reports.reveal(rows, ["listed", "said"]).select("section", "grp", "metric", r6("value"))
