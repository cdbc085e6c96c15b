"""Hand-computed cases of the operators, with ties, nulls and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.operators import budget, market, narratives, reports, similarity, tables, tiering, velocity

SNAP = "post_id long, id long, captured_at timestamp, views double, likes long, retweets long, replies long, unavailable boolean"


def snaps(spark, rows):
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 10) + __import__("datetime").timedelta(minutes=m)
    return spark.createDataFrame([(p, i, at(m), v, 1, 0, 0, bool(u)) for i, (p, m, v, u) in enumerate(rows)], SNAP)


def test_velocity(spark):
    rows = [(1, 0, 1000.0, 0), (1, 10, 3000.0, 0), (1, 20, 7000.0, 0), (1, 30, 9.0, 1), (2, 0, 5.0, 0), (3, 0, 1.0, 0), (3, 0, 2.0, 0), (4, 0, 1.0, 0), (4, 5, None, 0)]
    want = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = {r["post_id"]: r for r in velocity.velocities(snaps(spark, rows)).collect()}
        assert (got[1]["views_velocity"], got[1]["views_acceleration"], got[1]["lifecycle"]) == (400.0, 200.0, "heating")
        assert got[2]["views_velocity"] is None and got[3]["views_velocity"] is None and got[4]["views_velocity"] is None
        want = want or got[1]
        assert got[1] == want


def test_missing_and_flat_views(spark):
    s = snaps(spark, [(1, 0, 1.0, 0), (1, 1, None, 0), (2, 0, 3.0, 0), (2, 1, 3.0, 0), (3, 0, 5.0, 0), (3, 1, 5.0, 0), (4, 0, 5.0, 0), (4, 1, 5.0, 0)])
    assert tuple(velocity.missing_views(s).first()) == (4, 1, 25.0)
    assert tuple(velocity.flat_views(s).first()) == (3, 3, True)
    assert tuple(velocity.missing_views(s.limit(0)).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("n,want", [(1, ["hot"]), (7, ["hot"] * 2 + ["warm"] * 3 + ["cold"] * 2)])
def test_tiers(spark, n, want):
    p = spark.range(n).select(F.col("id").alias("post_id"), (-F.col("id")).cast("double").alias("views_velocity"))
    assert [r["tier"] for r in tiering.assign_tiers(p).orderBy("post_id").collect()] == want


def test_global_rank_over_many_ranges(spark):
    p = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    got = [(r["v"], r["id"], r["rank"]) for r in tiering.global_rank(p, "v", "id", per_range=500).collect()]
    want = sorted(((v, i) for v, i, _ in got), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(v, i, k) for k, (v, i) in enumerate(want, 1)]


def test_due_and_prune(spark, one):
    at = lambda s: F.lit(f"2024-01-01 {s}:00").cast("timestamp")
    assert one(tiering.due(F.lit("warm"), F.lit("x"), at("10:00"), at("10:08"))) and not one(tiering.due(F.lit("warm"), F.lit("tt"), at("10:00"), at("10:08")))
    assert one(tiering.due(F.lit("cold"), F.lit("x"), F.lit(None).cast("timestamp"), at("10:08")))
    p = lambda v, **k: one(tiering.prunable(F.lit("cold"), at("09:00"), F.lit(5), F.lit(v).cast("double"), F.lit("x"), at("10:00"), **k))
    assert p(1.0) and not p(600.0) and not p(None) and p(None, prune_unknown=True)


def test_series(spark):
    up = spark.createDataFrame([(1, [float(i) for i in range(26)]), (2, [9.0, 5.0, 1.0]), (3, [])], "k int, series array<double>")
    got = {r[0]: r[1:] for r in up.select("k", velocity.gain_24(F.col("series")), velocity.lifecycle_of_series(F.col("series")), velocity.tail_direction(F.col("series"))).collect()}
    assert got[1] == (24.0, "peaking", "flat") and got[2] == (0.0, "peaking", "falling") and got[3] == (0.0, "peaking", "flat")


def test_early_features(spark):
    s = snaps(spark, [(1, -1, 9.0, 0), (1, 5, 10.0, 0), (1, 30, 60.0, 0), (1, 31, 99.0, 0), (2, 3, 600.0, 0)])
    p = spark.sql("select cast(id as long) post_id, timestamp'2024-01-01 10:00:00' posted_at from range(1, 4)")
    got = {r["post_id"]: r for r in velocity.early_features(p, s).collect()}
    assert (got[1]["n_snapshots"], got[1]["views_at_t"], got[1]["view_velocity_t"]) == (2, 60.0, 2.0)
    assert got[2]["view_velocity_t"] == 20.0 and 3 not in got


def test_wallet_pnl(spark):
    t = spark.createDataFrame([("a", 1, "buy", 10.0, 100.0), ("a", 2, "sell", 4.0, 80.0), ("a", 3, "sell", 10.0, 50.0), ("b", 1, "sell", 1.0, 7.0), ("c", 1, "sell", 0.0, 9.0)], "w string, ts int, side string, token_amount double, usd double")
    got = {r["w"]: r for r in market.wallet_pnl(t, ["w"], ["ts"]).collect()}
    assert (got["a"]["realized"], got["a"]["held"], got["a"]["cost"]) == (pytest.approx(30.0), 0.0, pytest.approx(0.0))
    assert got["b"]["realized"] == 7.0 and got["c"]["realized"] == 0.0
    assert market.wallet_pnl(t.limit(0), ["w"], ["ts"]).count() == 0


def test_swap_trades(spark):
    sol = market.SOL_MINT
    leg = lambda a, n, p: (a, None, n, None, p)
    rows = [(leg(sol, 2.0, 100.0), leg("M", 50.0, None), "w", 10, "t1", 1.0), (leg("M", 5.0, 3.0), leg("U", 1.0, None), "w", 11, "t2", 1.0), (leg("U", 1.0, 1.0), leg("V", 1.0, 1.0), "w", 12, "t3", 1.0)]
    s = spark.createDataFrame(rows, f"`from` {market.LEG}, `to` {market.LEG}, owner string, blockUnixTime long, txHash string, volumeUSD double")
    got = {r["tx"]: r for r in market.swap_trades(s, "m").collect()}
    assert set(got) == {"t1", "t2"} and got["t1"]["usd"] == 200.0 and got["t1"]["price"] == 4.0 and got["t1"]["side"] == "buy" and got["t2"]["usd"] == 15.0


def test_holders_and_peaks(spark):
    h = spark.createDataFrame([(o, 1) for o in "abc"] + [("z", 0)], "o string, n long")
    got = market.holder_concentration(h, "o", "n").collect()
    assert [r["pct"] for r in got] == [33.33] * 3 and got[0]["top10_pct"] == 99.99 and got[0]["holders"] == 3
    c = spark.createDataFrame([("m", 1, 1.0, 2.0, 1.5), ("m", 2, 1.5, 6.0, 3.0)], "k string, t int, o double, h double, c double")
    r = market.peak_metrics(c, "k").first()
    assert (r["peak_multiple"], r["current_price"]) == (6.0, 3.0)


def test_pairs(spark):
    p = spark.createDataFrame([("m", "p1", False, 9.0, 1.0), ("m", "p2", True, 1.0, 1.0), ("m", "p3", True, 1.0, 1.0)], "mint string, pair string, sol_quote boolean, volume double, liquidity double")
    assert market.best_pair(p).first()["pair"] == "p2"
    pools = spark.createDataFrame([("m", "a", 10.0, 0.0, False, 0, 0), ("m", "b", 1.0, 0.0, True, 0, 0), ("m", "c", 0.0, 1e9, True, 0, 0)], "mint string, pool string, reserve double, volume double, is_pump boolean, created_ms long, launch_ms long")
    assert market.best_pool(pools).first()["pool"] == "b"


def test_narrative_tickers_and_signals(spark):
    p = spark.createDataFrame([("n", 1, "@A", "go $AAA solana", 0.2, None, None), ("n", 2, "B", "x", 0.9, "$bbb", "Bee"), ("n", 3, "C", "x", 0.5, "BBB", None)], "narrative_id string, post_id long, handle string, text string, meme_score double, suggested_ticker string, suggested_name string")
    got = {r["ticker"]: r for r in narratives.tickers(p).collect()}
    assert (got["BBB"]["name"], got["BBB"]["meme_score"], got["BBB"]["endorsed_by"], got["BBB"]["canonical"]) == ("Bee", 0.9, "C", True) and got["AAA"]["name"] == "Aaa"
    s = narratives.signals(p).first()
    assert (s["ticker_proposals"], s["ct_pickup"], s["proposal_tickers"]) == (1, True, ["AAA"])


def brute_overlap(sets, t):
    keys = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize("t", [0.28, 0.6])
def test_overlap_pairs_against_brute_force(spark, t):
    rng = random.Random(3)
    sets = {i: {f"word{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(0, 12))} for i in range(120)}
    d = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>")
    got = {(r["a"], r["b"]): r["overlap"] for r in similarity.overlap_pairs(similarity.token_rows(d, "id", F.col("w")), "id", t).collect()}
    want = brute_overlap(sets, t)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


@pytest.mark.parametrize("tile", [3, 20])
def test_tiles_of_hot_tokens_change_nothing(spark, tile):
    import random

    rng = random.Random(11)
    sets = {i: {f"word{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randrange(0, 10))} | {"every"} for i in range(90)}
    d = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>")
    rows = similarity.token_rows(d, "id", F.col("w")).select("id", "token", "size")
    got = {(r["a"], r["b"]): r["overlap"] for r in similarity.overlap_join(rows, "a", rows, "b", 0.3, same=True, tile=tile).collect()}
    want = brute_overlap(sets, 0.3)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_few_pairs_that_only_share_common_words_are_verified(spark, monkeypatch):
    """Sets of one vocabulary of common words share some of them nearly always; candidates are about the pairs that overlap enough."""
    rng = random.Random(5)
    sets = {i: {f"word{int(1000 * rng.random() ** 3)}" for _ in range(60)} for i in range(200)} | {200 + i: {f"word{j}" for j in range(i, 50 + i)} for i in range(5)}
    d = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>")
    seen, candidates = [], similarity.overlap_candidates
    monkeypatch.setattr(similarity, "overlap_candidates", lambda *a: seen.append(candidates(*a)) or seen[-1])
    got = {(r["a"], r["b"]) for r in similarity.overlap_pairs(similarity.token_rows(d, "id", F.col("w")), "id", 0.28).collect()}
    assert got == brute_overlap(sets, 0.28).keys()
    assert len(got) <= seen[0].distinct().count() <= len(got) + 1500 < 205 * 204 / 2 / 10


def test_phrases_split_each_text_once(spark):
    from trendloom.functions import text
    from trendloom.operators import tables

    d = spark.createDataFrame([("g", 1, "giant dragon seen again"), ("g", 2, "giant dragon"), ("h", 3, "word")], "k string, id long, t string")
    out = tables.dominant_phrases(d, ["k"], text.tokens(F.col("t")), "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in out.collect()] == [("g", "giant dragon", 2)]


def test_overlap_at_the_threshold_itself(spark):
    """7 of 25 words is 0.28 exactly, which 25 * 0.28 in floating point overshoots; also where the shared words are the commonest."""
    sets = {0: {f"w{i:02}" for i in range(25)}, 1: {f"w{i:02}" for i in range(18, 25)}, 2: {"w24"}, 3: set()}
    d = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>")
    rows = similarity.token_rows(d, "id", F.col("w"))
    pairs = {(r["a"], r["b"]) for r in similarity.overlap_pairs(rows, "id", 0.28).collect()}
    assert pairs == brute_overlap(sets, 0.28).keys() == {(0, 1)}
    two = similarity.overlap_join(rows.where("id = 1").select("id", "token", "size"), "post", rows.where("id <> 1").select("id", "token", "size"), "member", 0.14)
    assert {(r["post"], r["member"], r["shared"]) for r in two.collect()} == {(1, 0, 7), (1, 2, 1)}


def test_matching_and_greedy(spark):
    posts = spark.createDataFrame([(10, "@me", "giant dragon spotted flying"), (11, "@z", "nothing alike here today"), (12, "@z", "about $WIF"), (13, "@a", "giant dragon spotted london")], "post_id long, handle string, text string")
    members = spark.createDataFrame([(1, 1, "@a", "giant dragon spotted london"), (2, 2, "@b", "all in $wif")], "narrative_id long, post_id long, handle string, text string")
    got = {r["post_id"]: (r["narrative_id"], r["reason"]) for r in similarity.match_narratives(posts, members).collect()}
    assert got == {10: (1, "keyword"), 12: (2, "cashtag")}
    rows = [("s", 1, "@a", 0.9, [], ["giant", "dragon"]), ("s", 2, "@b", 0.8, [], ["giant", "dragon", "seen"]), ("s", 3, "@a", 0.7, [], ["giant", "dragon"]), ("s", 4, "@c", 0.6, ["WIF"], ["else"])]
    g = similarity.greedy_cluster(spark.createDataFrame(rows, "shard string, post_id long, handle string, score double, tags array<string>, words array<string>"), "shard")
    assert {r["post_id"]: (r["narrative_id"], r["reason"]) for r in g.collect()} == {1: (1, "new"), 2: (1, "keyword"), 3: (3, "new"), 4: (4, "new")}


def test_matching_by_filters_and_without(spark):
    """Words met in tiles without a filter, and by the filters: the same matches."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"word{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n))
    posts = spark.createDataFrame([(i, f"@p{i % 9}", say(rng.randint(0, 14))) for i in range(200)], "post_id long, handle string, text string")
    members = spark.createDataFrame([(i % 5, i, f"@p{i}", say(rng.randint(1, 14))) for i in range(30)], "narrative_id long, post_id long, handle string, text string")
    got = [{(r["post_id"], r["narrative_id"], r["reason"], round(r["score"], 9)) for r in similarity.match_narratives(posts, members, 0.3, 0.4, few=few).collect()} for few in (0, 10**6)]
    assert got[0] == got[1] and {r[2] for r in got[0]} == {"keyword", "embedding"}


def test_pairs_of_one_centroid_are_many_tasks(spark):
    """Pairs are verified in tiles, however few vectors one side has."""
    a = spark.range(300).selectExpr("id AS a", "explode(array('x', 'y' || id)) AS token", "sqrt(0.5D) AS weight")
    b = spark.sql("SELECT 1L AS b, 'x' AS token, 1.0D AS weight")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        got = similarity.cosine_pairs(a, "a", b, "b", 0.5, tile=30).select("a", "cosine", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["a"] for r in got) == list(range(300)) and {round(r["cosine"], 9) for r in got} == {round(0.5**0.5, 9)}
    assert len({r["p"] for r in got}) > 1


def test_groups_form(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 9)], "a long, b long")
    got = {r[0]: r[1] for r in similarity.form_narratives(spark.range(1, 10).toDF("post_id"), pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 1}


def test_reports(spark):
    d = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 10)], "k string, v double")
    r = reports.distribution(d, ["k"], "v").first()
    assert (r["median"], r["min"], r["max"]) == (2.5, 1.0, 10.0)
    assert d.select(F.percentile("v", F.lit(0.9))).first()[0] == pytest.approx(7.9)
    rows = [(0.71, i < 151) for i in range(207)] + [(0.1, i < 8) for i in range(422)]
    e = reports.elbow(spark.createDataFrame(rows, "s double, c boolean"), "s", "c").first()
    assert e["threshold"] == 0.7 and e["above_n"] == 207
    b = reports.score_bands(spark.createDataFrame([(0.95, True)], "s double, c boolean"), "s", "c").collect()
    assert len(b) == 7 and sum(x["n"] for x in b) == 1
    s = reports.separation(spark.createDataFrame([("winner", 10.0), ("winner", 12.0), ("loser", 1.0), ("loser", 3.0)], "outcome string, f double"), ["f"]).first()
    assert s["separation"] == pytest.approx(9.0)
    hits = spark.createDataFrame([(1, 1, 0.9, 10, True), (1, 2, 0.5, 5, False), (1, 3, 0.4, 50, False), (2, 4, 0.1, 5, False)], "k long, post_id long, confidence double, views long, wrong_address boolean")
    assert {r["k"]: r["post_id"] for r in reports.best_match(hits, "k", F.lit(True)).collect()} == {1: 3, 2: 4}


def test_sampling_is_independent_of_partitions(spark):
    rows = spark.range(1000).withColumn("w", F.col("id") % 3 == 0)
    a = reports.case_control(rows, "id", F.col("w"), ~F.col("w"), 42, 20)
    b = reports.case_control(rows.repartition(7), "id", F.col("w"), ~F.col("w"), 42, 20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 40
    assert {r["group"]: r["count"] for r in a.groupBy("group").count().collect()} == {"winner": 20, "loser": 20}


def test_budget(one, spark):
    f = lambda base, raw, reads, target, zero, low: one(budget.next_floor(*map(F.lit, (base, raw, reads, target, zero, low))))
    assert f(1000, 0, 0, 10, False, 100) == 600 and f(120, 0, 0, 10, False, 100) == 100
    assert f(1000, 5, 20, 10, False, 100) == 1200 and f(1000, 5, 20, 10, True, 100) == 1000 and f(1000, 5, 5, 10, False, 100) == 800
    assert one(budget.decayed_floor(F.lit(1000), F.lit(100), F.lit(0.2), F.lit(None).cast("double"))) == 900
    assert one(budget.lane_share(F.lit(0.44), F.lit(0.5), F.lit(0.1))) == 0.45
    b = budget.bottlenecks(spark.createDataFrame([(100, 50, 5)], "total int, a int, b int"), ["a", "b"]).first()
    assert b["bottlenecks"] == ["b"]


def test_tables(spark):
    t = spark.createDataFrame([(1, 1, "a", "old", False), (2, 1, "b", "old", True)], "k int, v int, first string, x string, pruned boolean")
    c = spark.createDataFrame([(1, 2, "z", "mid", False), (1, 3, "z", "new", False), (2, 9, "z", "new", False), (3, 1, "n", "new", False)], t.schema)
    got = {r["k"]: (r["first"], r["x"]) for r in tables.upsert(t, c, ["k"], "v", ("first",), F.col("pruned")).collect()}
    assert got == {1: ("a", "new"), 2: ("b", "old"), 3: ("n", "new")}
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, x string")
    e = {r["k"]: [x["x"] for x in r["kids"]] for r in tables.embed_children(spark.createDataFrame([(1,), (2,)], "k int"), kids, "k", "kids", ["n"]).collect()}
    assert e == {1: ["a", "b"], 2: []}
    items = spark.createDataFrame([(c,) for c in "abcde"], "t string")
    assert sorted(r[0] for r in tables.round_robin(items, "t", 1, 3).collect()) == ["a", "d", "e"]


def test_schema_registry(spark):
    assert schemas.checked("post_snapshots", "views") == ["views"]
    with pytest.raises(KeyError):
        schemas.checked("post_snapshots", "nope")
    for t in schemas.TABLES:
        assert schemas.empty(spark, t).columns == schemas.columns(t)


def test_feeds(spark, one):
    from trendloom.operators import feeds, health

    n = spark.createDataFrame([(1, 5.0, 9), (2, 7.0, 1), (3, 7.0, 5)], "id int, combined_views double, age_min int")
    assert [r["id"] for r in feeds.sorted_narratives(n, "views", "id").collect()] == [2, 3, 1]
    assert [r["id"] for r in feeds.sorted_narratives(n, "age", "id", F.col("id") == 1).collect()] == [1, 2, 3]
    p = spark.createDataFrame([(1, "n", "@A", "the giant elephants run", 10, "x"), (2, "n", "b", "short", 5, "x"), (3, "m", "c", "zebras", 1, "tt")], "post_id long, narrative_id string, handle string, text string, views long, platform string")
    assert [r["term"] for r in feeds.confirmation_terms(p, 5).collect()] == ["elephants giant"]
    v = feeds.view_rows(p.withColumn("posted_at", F.lit("2024-01-01 00:00:00").cast("timestamp")), F.lit("2024-01-01 02:00:00").cast("timestamp")).orderBy("post_id").first()
    assert (v["handle"], v["age"], v["views"]) == ("@a", "2h", "10")
    b = health.billed(spark.createDataFrame([(2, "requests"), (2, "posts")], "reads long, unit string"), price=1.0).collect()
    assert [(r["reads"], r["cost_usd"]) for r in b] == [(40, 40.0), (2, 2.0)]


def test_discovery_order_and_embedded_parents(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("d", 5), ("e", 5)], "mint string, launch_ms long")
    seeds = spark.createDataFrame([("c",), ("c",), ("z",)], "mint string")
    assert [(r["mint"], r["is_seed"]) for r in market.discovery_order(hits, seeds).collect()] == [("c", True), ("b", False), ("d", False), ("e", False), ("a", False)]
    assert market.discovery_order(hits, seeds.limit(0)).first()["mint"] == "b" and market.discovery_order(hits.limit(0), seeds).isEmpty()
    got = tables.embed_parent(hits, spark.createDataFrame([("a", "A")], "mint string, name string"), "mint", "token")
    assert {r["mint"]: r["token"] and r["token"]["name"] for r in got.collect()} == {"a": "A", "b": None, "c": None, "d": None, "e": None}
