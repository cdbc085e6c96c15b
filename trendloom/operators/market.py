"""Trades, holders, candles and token pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates
from ..session import kept

#: Fixed value: the address of the wrapped native coin.
SOL_MINT = "So11111111111111111111111111111111111111112"
LEG = "struct<address:string,symbol:string,uiAmount:double,amount:double,price:double>"


def swap_trades(swaps: DataFrame, mint: str) -> DataFrame:
    """Swaps with legs `from` and `to` -> (side, ts, wallet, token_amount, sol_amount, usd, price, tx) of one token.

    Value comes from the native leg, else from the token leg, else from the swap's volume. Swaps without the token or without a
    time drop out.
    """
    src, dst = F.col("from"), F.col("to")
    ours = lambda leg: F.lower(F.coalesce(leg["address"], F.lit(""))) == mint.lower()
    native = lambda leg: (F.lower(leg["address"]) == SOL_MINT.lower()) | (F.upper(leg["symbol"]) == "SOL")
    size = lambda leg: F.abs(F.coalesce(leg["uiAmount"], leg["amount"], F.lit(0.0)))
    worth = lambda leg: F.when((size(leg) > 0) & (leg["price"] > 0), size(leg) * leg["price"]).otherwise(0.0)
    buys = ours(dst)
    token, quote = F.when(buys, dst).otherwise(src), F.when(buys, src).otherwise(dst)
    rows = swaps.where(buys | ours(src)).select(
        F.when(buys, "buy").otherwise("sell").alias("side"), (F.col("blockUnixTime") * 1000).cast("long").alias("ts"), F.coalesce("owner", F.lit("")).alias("wallet"),
        size(token).alias("token_amount"), F.when(F.coalesce(native(quote), F.lit(False)), size(quote)).otherwise(0.0).alias("sol_amount"),
        F.coalesce(F.nullif(F.when(F.coalesce(native(quote), F.lit(False)), worth(quote)).otherwise(0.0), F.lit(0.0)), F.nullif(worth(token), F.lit(0.0)), F.col("volumeUSD"), F.lit(0.0)).alias("usd"), F.coalesce("txHash", F.lit("")).alias("tx"))
    return rows.where("ts > 0").withColumn("price", F.when((F.col("token_amount") > 0) & (F.col("usd") > 0), F.col("usd") / F.col("token_amount")))


FOLD = "struct<held:double,a:double,b:double,g:double,d:double>"


def _trade_fold(trades: Column, held: Column) -> Column:
    """What a run of trades does to a position that begins with `held`: cost becomes a * cost + b, profit grows by g * cost + d.

    Held amounts don't depend on cost, so that cost and profit are linear in the cost that a run begins with.
    """
    start = F.struct(held.alias("held"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("g"), F.lit(0.0).alias("d")).cast(FOLD)

    def step(acc: Column, x: Column) -> Column:
        covered = F.least(x["q"], acc["held"])
        taken = lambda c: F.when((acc["held"] > 0) & (x["q"] > 0), acc[c] / acc["held"] * covered).otherwise(0.0)
        return F.struct(
            F.when(x["buy"], acc["held"] + x["q"]).otherwise(acc["held"] - F.when(x["q"] > 0, covered).otherwise(0.0)).alias("held"),
            F.when(x["buy"], acc["a"]).otherwise(acc["a"] - taken("a")).alias("a"),
            F.when(x["buy"], acc["b"] + x["u"]).otherwise(acc["b"] - taken("b")).alias("b"),
            F.when(x["buy"], acc["g"]).otherwise(acc["g"] - taken("a")).alias("g"),
            F.when(x["buy"], acc["d"]).otherwise(acc["d"] + F.when(x["q"] > 0, x["u"] - taken("b")).otherwise(0.0)).alias("d"))

    return F.aggregate(trades, start, step)


def wallet_pnl(trades: DataFrame, keys: list[str], order: list[str], side: str = "side", amount: str = "token_amount", usd: str = "usd", most: int = 100_000) -> DataFrame:
    """Average-cost profit of each wallet: a fold over its trades in order.

    Buys raise inventory and cost. A sale takes the average cost of what the inventory covers; the part that it doesn't cover
    is all profit, as is a sale without inventory. Missing amounts and values count as zero.

    The order matters, but no key is gathered whole: all trades are sorted by key and order into ranges of about `most` rows,
    whose boundaries cut a busy key. What a range does to a position is told by a few numbers: the inventory it ends with, by
    its sum and its lowest running sum, and then, with the inventory it begins with known, two linear rules for cost and
    profit. Ranges of a key are put together in order. A range continues one key at most, so what it begins with is a
    table of a row a range at most, which is broadcast.
    """
    t = F.struct(*order, (F.col(side) == "buy").alias("buy"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("q"), F.coalesce(F.col(usd).cast("double"), F.lit(0.0)).alias("u"))
    rows = trades.select(*keys, t.alias("_t"), F.coalesce(F.col(side) == "buy", F.lit(False)).alias("_buy"), F.col(usd).alias("_usd"))
    spark = trades.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), trades.count() // most + 1)
    dealt = rows.repartitionByRange(ranges, *keys, "_t").withColumn("_part", F.spark_partition_id())
    runs = kept(dealt.groupBy(*keys, "_part").agg(
        F.sort_array(F.collect_list("_t")).alias("_ts"), F.count_if("_buy").alias("_buys"), F.count_if(~F.col("_buy")).alias("_sells"),
        F.sum(F.when(F.col("_buy"), F.col("_usd"))).alias("_bought"), F.sum(F.when(~F.col("_buy"), F.col("_usd"))).alias("_sold")), "trade_runs")

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"))
    moved = lambda acc, x: acc["sum"] + F.when(x["buy"], x["q"]).otherwise(-F.greatest(x["q"], F.lit(0.0)))
    walk = F.aggregate("_ts", zero, lambda acc, x: F.struct(moved(acc, x).alias("sum"), F.least(acc["low"], moved(acc, x)).alias("low")))
    # A key of several ranges is the last of one and the first of another: two rows a range at most.
    ends = runs.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_a"), F.max(F.struct(*keys)).alias("_b"))
    ends = ends.select("_part", F.explode(F.array("_a", "_b")).alias("_k")).distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ends = kept(ends.select(*[F.col("_k")[k].alias(f"_k{i}") for i, k in enumerate(keys)]), "cut_keys")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m._k{i}")) for i, k in enumerate(keys)]
    sums = ["buys", "sells", "buy_usd", "sell_usd"]
    told = [F.col("_buys").alias("buys"), F.col("_sells").alias("sells"), F.coalesce("_bought", F.lit(0.0)).alias("buy_usd"), F.coalesce("_sold", F.lit(0.0)).alias("sell_usd")]
    whole = runs.alias("r").join(F.broadcast(ends.alias("m")), same, "left_anti").select(*keys, *told, _trade_fold(F.col("_ts"), F.lit(0.0)).alias("_f"))
    whole = whole.select(*keys, *sums, F.col("_f.d").alias("realized"), F.col("_f.held").alias("held"), F.col("_f.b").alias("cost"))

    cut = runs.alias("r").join(F.broadcast(ends.alias("m")), same, "left_semi").withColumn("_w", walk)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Inventory is the sum so far less the lowest sum so far, as it never falls below nothing.
    level = kept(cut.select(*keys, "_part", F.col("_w.sum").alias("_sum"), F.col("_w.low").alias("_low")), "cut_runs").withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    begun = level.withColumn("_held", F.col("_base") - F.least(F.lit(0.0), F.coalesce(F.min(F.col("_base") + F.col("_low")).over(before), F.lit(0.0))))
    begun = begun.select("_part", "_held", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    here = [F.col("r._part") == F.col("m._part"), *same]
    folded = cut.alias("r").join(F.broadcast(begun.alias("m")), here).select("r.*", _trade_fold(F.col("r._ts"), F.col("m._held")).alias("_f"))  # two rows a range at most
    parts = folded.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_part", "_f"))).alias("_fs"), F.sum("_buys").alias("buys"), F.sum("_sells").alias("sells"), F.coalesce(F.sum("_bought"), F.lit(0.0)).alias("buy_usd"), F.coalesce(F.sum("_sold"), F.lit(0.0)).alias("sell_usd"))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("pnl"))
    total = F.aggregate("_fs", start, lambda acc, x: F.struct((x["_f"]["a"] * acc["cost"] + x["_f"]["b"]).alias("cost"), (acc["pnl"] + x["_f"]["g"] * acc["cost"] + x["_f"]["d"]).alias("pnl")))
    return whole.union(parts.select(*keys, *sums, total["pnl"].alias("realized"), F.element_at("_fs", -1)["_f"]["held"].alias("held"), total["cost"].alias("cost")))


def top_traders(trades: DataFrame, token: str, wallet: str, ts: str, tie: str, price: str, period: str = "INTERVAL 24 HOURS", k: int = 10, accumulators: int = 5) -> DataFrame:
    """Best wallets of each token by realised profit, and its largest pure buyers.

    Trades within the period before the token's last trade count; all of a token's trades have one there at least.
    """
    last = trades.groupBy(token).agg(F.max(ts).alias("last"), F.max_by(price, F.struct(ts, tie)).alias("price_now"))
    pool = trades.join(last, token).where(F.col(ts) >= F.col("last") - F.expr(period))
    stats = wallet_pnl(pool, [token, wallet], [ts, tie]).join(last.select(token, "price_now"), token)
    stats = stats.withColumn("unrealized", F.when(F.col("held") > 0, F.col("held") * F.col("price_now") - F.col("cost")))
    ranked = lambda rows, col, n, kind: rows.withColumn("rank", F.row_number().over(Window.partitionBy(token).orderBy(F.col(col).desc(), wallet))).where(F.col("rank") <= n).withColumn("kind", F.lit(kind))
    return ranked(stats.where("sells > 0"), "realized", k, "trader").unionByName(ranked(stats.where("sells = 0"), "buy_usd", accumulators, "accumulating"))


def holder_concentration(accounts: DataFrame, owner: str, amount: str, top: int = 20, by: list[str] | None = None) -> DataFrame:
    """(rank, owner, amount, pct, holders, top10_pct) of the largest holders.

    Amounts are whole numbers of up to 38 digits; percentages are cut, not rounded, to two decimals before they are added.
    """
    by = by or []
    per = accounts.where(F.col(amount) != 0).groupBy(*by, owner).agg(F.sum(F.col(amount).cast("decimal(38,0)")).cast("decimal(38,0)").alias("amount"))
    total = per.groupBy(*by).agg(F.sum("amount").cast("decimal(38,0)").alias("total"), F.count(F.lit(1)).alias("holders"))
    w = Window.partitionBy(*by).orderBy(F.col("amount").desc(), owner)
    best = per if by else per.orderBy(F.col("amount").desc(), owner).limit(top)  # a window over all owners would be one task
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out = ranked.join(total, by) if by else ranked.crossJoin(F.broadcast(total))  # one row
    share = F.when(F.col("total") > 0, F.expr("cast(amount * 10000 div total as double)") / 100).otherwise(0.0)
    out = out.withColumn("pct", share)
    top10 = out.where("rank <= 10").groupBy(*by).agg(F.round(F.sum("pct"), 2).alias("top10_pct"))
    out = out.join(top10, by) if by else out.crossJoin(F.broadcast(top10))  # one row
    return out.select(*by, "rank", owner, "amount", "pct", "holders", "top10_pct")


def candles(trades: DataFrame, token: str, ts: str, tie: str, price: str, volume: str, width: str = "1 hour") -> DataFrame:
    """(token, t, o, h, l, c, v) per window: first, highest, lowest and last price, and volume (candle building)."""
    order = F.struct(ts, tie)
    return trades.groupBy(token, F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.sum(volume).alias("v"),
    ).select(token, F.col("w.start").alias("t"), "o", "h", "l", "c", "v")


def peak_metrics(bars: DataFrame, token: str, supply: float = 1e9) -> DataFrame:
    """(token, launch_price, peak_price, current_price, peak_multiple, peak_mcap, current_mcap) from candles.

    The launch price is the first open, else the first close; the peak is never below it.
    """
    out = bars.groupBy(token).agg(
        F.min_by(F.coalesce(F.nullif("o", F.lit(0.0)), F.col("c"), F.lit(0.0)), "t").alias("launch_price"), F.max("h").alias("high"), F.max_by("c", "t").alias("last"))
    out = out.withColumn("peak_price", F.greatest("launch_price", F.coalesce("high", F.lit(0.0)))).withColumn("current_price", F.coalesce(F.nullif("last", F.lit(0.0)), "launch_price"))
    return out.select(
        token, "launch_price", "peak_price", "current_price", F.when(F.col("launch_price") > 0, F.col("peak_price") / F.col("launch_price")).otherwise(1.0).alias("peak_multiple"),
        (F.col("peak_price") * supply).alias("peak_mcap"), (F.col("current_price") * supply).alias("current_mcap"))


def graduations(migrations: DataFrame, creations: DataFrame, suffix: str | None = None) -> DataFrame:
    """(mint, graduated_at, created_at, ticker, name): first migration and creation of each token."""
    rows = migrations.where(F.col("mint").endswith(suffix)) if suffix else migrations
    first = rows.groupBy("mint").agg(F.min("at").alias("graduated_at"))
    made = creations.groupBy("mint").agg(F.min("at").alias("created_at"), F.max("symbol").alias("ticker"), F.max("name").alias("name"))
    return first.join(made, "mint", "left")


def day_windows(days: int, step: int = 30) -> list[tuple[int, int]]:
    """(from, to) in days before now, newest first: how a long lookback is cut into windows."""
    return [(a, min(days, a + step)) for a in range(0, days, step)]


def over_windows(spark: SparkSession, text: str, days: int, key: str, step: int = 30, **tables: DataFrame) -> DataFrame:
    """The rows of a SQL text with the parameters :newest and :oldest, days before now, run for each window; of a key's rows that of the oldest window counts.

    tables are named in braces in the text. All windows are one plan, whose scans Spark prunes by the windows' conditions.
    """
    out = None
    for i, (newest, oldest) in enumerate(day_windows(days, step)):
        part = spark.sql(text, args={"newest": newest, "oldest": oldest}, **tables).withColumn("_window", F.lit(i))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(key).orderBy(F.col("_window").desc())
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_window")


def peak_multiples(tokens: DataFrame, trades: DataFrame, venues: list[str], least_usd: float = 10, near: float = 0.9, supply: float = 1e9) -> DataFrame:
    """Peak over the price at graduation for each token.

    tokens(mint, graduated_at), trades(mint, at, id, venue, usd, amount): both legs of swaps, joined by the caller with a
    union. price_at_graduation is that of the first trade on a venue, of least_usd or more, at or after graduation;
    trades_near_peak counts those of at least `near` times the highest price.
    """
    priced = trades.where("usd > 0 and amount > 0").select("mint", "at", "id", "venue", "usd", (F.col("usd") / F.col("amount")).alias("price")).join(tokens.select("mint", "graduated_at"), "mint")
    after = F.col("at") >= F.col("graduated_at")
    fit = after & F.col("venue").isin(venues) & (F.col("usd") >= least_usd)
    order = F.struct("at", "id")
    agg = priced.groupBy("mint").agg(
        F.max("price").alias("max_price"), F.min_by("price", F.when(after, order)).alias("price_after"), F.min_by("price", F.when(fit, order)).alias("price_at_graduation"),
        F.min_by("price", order).alias("first_price"), F.count(F.lit(1)).alias("trade_count"))
    support = priced.join(agg.select("mint", "max_price"), "mint").where(F.col("price") >= F.col("max_price") * near).groupBy("mint").agg(F.count(F.lit(1)).alias("trades_near_peak"))
    out = tokens.join(agg, "mint", "left").join(support, "mint", "left")
    return out.select(
        "mint", "graduated_at", "first_price", "price_after", "price_at_graduation", "max_price", F.try_divide("max_price", F.nullif("price_after", F.lit(0.0))).alias("peak_multiple_old"),
        F.try_divide("max_price", F.nullif("price_at_graduation", F.lit(0.0))).alias("peak_multiple"), (F.col("max_price") * supply).alias("ath_mcap"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.coalesce("trades_near_peak", F.lit(0)).alias("trades_near_peak"))


def best_pair(pairs: DataFrame, mint: str = "mint", pair: str = "pair", quote_is_sol: str = "sol_quote", volume: str = "volume", liquidity: str = "liquidity") -> DataFrame:
    """One pair for each token: native quotes first, then volume, then liquidity, then the smallest pair id (K8)."""
    w = Window.partitionBy(mint).orderBy(F.col(quote_is_sol).desc(), F.col(volume).desc_nulls_last(), F.col(liquidity).desc_nulls_last(), pair)
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_pool(pools: DataFrame, mint: str = "mint") -> DataFrame:
    """One pool with a reserve for each token: by reserve, a hundredth of volume, a bonus for launch pads, and nearness to launch in minutes (K9)."""
    minutes = F.abs(F.col("created_ms") - F.col("launch_ms")) / 60_000
    score = F.col("reserve") + F.coalesce("volume", F.lit(0.0)) * 0.01 + F.when(F.col("is_pump"), 50_000.0).otherwise(0.0) - F.least(F.coalesce(minutes, F.lit(0.0)), F.lit(10_000.0))
    w = Window.partitionBy(mint).orderBy(F.col("score").desc(), "pool")
    return pools.where("reserve > 0").withColumn("score", score).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def dedup_by_ticker(tokens: DataFrame, seeds: DataFrame | None = None, ticker: str = "ticker") -> DataFrame:
    """One token of each symbol: most liquid, then newest, then smallest id; seeds all stay."""
    w = Window.partitionBy(F.upper(ticker)).orderBy(F.col("liquidity").desc_nulls_last(), F.col("launch_at").desc_nulls_last(), "mint")
    out = tokens.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return out if seeds is None else seeds.unionByName(out.join(seeds.select("mint"), "mint", "left_anti"))


def discovery_order(hits: DataFrame, seeds: DataFrame, mint: str = "mint", launch: str = "launch_ms") -> DataFrame:
    """Discovered tokens in the order of work: seeds first, then the newest launches, then by id."""
    known = seeds.select(mint).distinct().withColumn("is_seed", F.lit(True))
    marked = hits.join(known, mint, "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return marked.orderBy(F.col("is_seed").desc(), F.col(launch).desc_nulls_last(), mint)


def classified_tokens(bars: DataFrame, pairs: DataFrame, excluded: list[str], supply: float = 1e9, most_multiple: float = 10_000, most_mcap: float = 1e10, **thresholds) -> DataFrame:
    """(mint, pair, liquidity, peak_multiple, current_mcap, outcome): tokens with their best pair, classed by their peak (B1).

    Tokens without a plausible peak drop out; those without a pair have no liquidity.
    """
    peaks = peak_metrics(bars, "mint", supply)
    sane = peaks.where(gates.passes_sanity(F.col("peak_multiple"), F.col("peak_mcap"), F.col("mint"), excluded, most_multiple, most_mcap))
    out = sane.join(best_pair(pairs).select("mint", "pair", "liquidity"), "mint", "left")
    kind = gates.outcome(F.col("peak_multiple"), F.col("liquidity"), F.col("current_mcap"), F.col("liquidity").isNull(), **thresholds)
    return out.select("mint", "pair", "liquidity", "peak_multiple", "current_mcap", kind.alias("outcome"))


def by_symbol_or_mint(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left(mint, symbol) with right's value by mint, else by symbol: two equi joins in place of an OR."""
    by_mint = right.groupBy("mint").agg(F.max(value).alias("_m"))
    by_symbol = right.groupBy("symbol").agg(F.max(value).alias("_s"))
    return left.join(by_mint, "mint", "left").join(by_symbol, "symbol", "left").withColumn(value, F.coalesce("_m", "_s")).drop("_m", "_s")


def first_after(anchors: DataFrame, launches: DataFrame, grace_min: int = 5) -> DataFrame:
    """anchors(id, term, anchor_ms) with the first launch(term, mint, launch_ms) at or after anchor - grace."""
    hit = anchors.join(launches, "term").where(F.col("launch_ms") >= F.col("anchor_ms") - grace_min * 60_000)
    first = hit.groupBy("id").agg(F.min(F.struct("launch_ms", "mint")).alias("f"))
    return anchors.join(first, "id", "left").select("id", "term", "anchor_ms", F.col("f.mint").alias("mint"), F.col("f.launch_ms").alias("launch_ms"), F.col("f").isNotNull().alias("coined"))
