"""Landing source, variants, sketches, partitioned tables, and joins and folds whose hot keys are cut."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trendloom.functions import gates
from trendloom.operators import market, reports, similarity, sketches, tables, tiering
from trendloom.sources import files, landing, variants
from trendloom.streaming import pipelines


def land(folder, lane, name, lines):
    to = folder / f"lane={lane}"
    to.mkdir(parents=True, exist_ok=True)
    (to / name).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


def test_landed_batch_and_stream_agree(spark, tmp_path):
    landing.register(spark)
    folder, out, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    stream = lambda: pipelines.replayed(spark.readStream.format("landed_posts").option("path", str(folder)).load(), None, "land", out=out, marks=marks)
    read = lambda **o: spark.read.format("landed_posts").options(path=str(folder), **o).load()
    land(folder, "media", "001.jsonl", ["a", "", "é1"])
    land(folder, "fast", "001.jsonl", ["b"])
    land(folder, "fast", "_temporary", ["no"])
    stream()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["a", "b", "é1"]
    land(folder, "media", "002.jsonl", ["c"])
    land(folder, "slow", "000.jsonl", ["d" * 3_000_000, "e"])
    stream()
    stream()
    rows = sorted(map(tuple, read().collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("lane", "file", "line", "value").collect())) == rows and len(rows) == 6
    assert {(r["file"], r["line"]) for r in read().where("value = 'é1'").collect()} == {("001.jsonl", 2)}
    assert {r["value"] for r in read(lanes="fast, media", budget="1").collect()} == {"b", "c"}
    asked = read().where("lane = 'media' and value <> 'a'")
    assert {r["value"] for r in asked.collect()} == {"é1", "c"}
    reader = landing.LandedReader(str(folder), None, None)
    left = list(reader.pushFilters([landing.EqualTo(("lane",), "media"), landing.EqualTo(("value",), "a")]))
    assert len(left) == 1 and {p.lane for p in reader.partitions()} == {"media"}


def test_variant_candles_read_each_field_once(spark):
    """Neither does a filter read a bar's fields again, nor does a key's name matter."""
    bars = spark.createDataFrame([(1, '[[1, 2, 3, 1, 2, 9], 5, null, {"unix_time": 6, "c": "2"}, [2, 1, 1, 1, 0, 1]]'), (2, '{"unixTime": 5, "c": 1}'), (3, None)], "k int, p string")
    for key in ("k", "v", "r", "key"):
        got = variants.candles(bars.withColumnRenamed("k", key), key, "p")
        assert got.columns == [key, "unixTime", *"ohlcv"]
        assert sorted(map(tuple, got.collect())) == [(1, 1, 2.0, 3.0, 1.0, 2.0, 9.0), (1, 6, None, None, None, 2.0, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"$[{i}]") for i in range(6)] == [1] * 6


def test_variants_equal_declared_structs(spark):
    posts = [
        {"id": "1", "text": "t", "authorMeta": {"name": "n", "fans": 5}, "playCount": 7, "createTime": 1_700_000_000, "musicMeta": {"musicId": "m"}, "videoMeta": {"coverUrl": "u"}},
        {"aweme_id": "2", "desc": "d", "author": {"uniqueId": "q", "followers": 3}, "stats": {"playCount": 0, "diggCount": 2}, "createTime": 1_700_000_000_000, "music": {"id": "z"}}, {"text": "no id"}]
    raw = spark.createDataFrame([(json.dumps(p),) for p in posts] + [("not json",), (None,), ("[1]",)], "value string")
    for zero in (False, True):
        assert sorted(map(str, variants.tt_posts(raw, zero_as_null=zero).collect())) == sorted(map(str, files.parse_tt_posts(raw, zero_as_null=zero).collect()))
    text = spark.createDataFrame([('{"id": "3", "playCount": "12"}',)], "value string")
    assert variants.tt_posts(text).first()["views"] == 12
    bars = spark.createDataFrame([(1, "[[1, 2, 3, 1, 2, 9], [2, 1, 1, 1, 0, 1]]"), (2, '[{"unixTime": 5, "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}, {"unix_time": 6, "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}, {"o": 1, "c": 1}]'), (3, "[]"), (4, None), (5, "{")], "k int, p string")
    assert sorted(map(tuple, variants.candles(bars, "k", "p").collect())) == sorted(map(tuple, files.parse_candles(bars, "k", "p").collect()))
    replies = spark.createDataFrame([('Sure:\n```json\n{"score": 0.7, "reason": "x"}\n```',), ("no json",), (None,), ('{"score": "0.5"}',)], "r string")
    assert [tuple(r)[1:] for r in variants.reply_fields(replies, "r", {"score": "double", "reason": "string"}).collect()] == [(0.7, "x"), (None, None), (None, None), (0.5, None)]


def test_sketches_stay_within_their_error(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-01 {h:02}:10:00", rng.randrange(30_000), rng.gauss(0, 1)) for h in range(6) for _ in range(8000)]
    d = spark.createDataFrame(rows, "ts string, who long, v double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.lit("a"))
    hours = sketches.hourly(d, ["k"], "ts", "v", "who")
    whole = sketches.estimates(sketches.merged(hours, ["k"]), [0.5, 0.9]).first()
    exact = len({w for _, w, _ in rows})
    assert abs(whole["distinct"] - exact) <= 4 * 0.0163 * exact and whole["n"] == len(rows)
    values = sorted(v for _, _, v in rows)
    for s in (0.5, 0.9):
        assert abs(sum(v <= whole[f"q{round(100 * s)}"] for v in values) / len(values) - s) <= 2 * sketches.RANK_ERROR
    back = {r["hour"].hour: r for r in sketches.estimates(sketches.lookback(hours, ["k"], 2), []).collect()}
    for h in range(6):
        near = {w for t, w, _ in rows if int(t[11:13]) in (h - 1, h)}
        assert abs(back[h]["distinct"] - len(near)) <= 4 * 0.0163 * len(near)


def test_exact_lookback_counts_every_member(spark):
    """More members than a sketch counts exactly, some in many hours, hours without rows, rows without a member or a time."""
    rng = random.Random(4)
    rows = [(h, rng.randrange(3000) if rng.random() < 0.97 else None) for h in (0, 1, 2, 5, 6, 9, 30) for _ in range(1500)] + [(12, None)]
    d = spark.createDataFrame([(h, w, "a") for h, w in rows] + [(None, 1, "a"), (3, 7, None)], "h int, who long, k string").withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp_ntz") + F.make_dt_interval(hours="h"))
    got = {(r["k"], (r["hour"].day - 1) * 24 + r["hour"].hour): (r["n"], r["distinct"]) for r in sketches.exact_lookback(d, ["k"], "ts", "who", 4).collect()}
    near = lambda h: [w for t, w in rows if h - 4 < t <= h]
    assert got == {("a", h): (len(near(h)), len({*near(h)} - {None})) for h in {t for t, _ in rows}} | {(None, 3): (1, 1)}


def test_lookback_query_equals_its_sql_with_many_members(spark, tmp_path):
    import duckdb

    from trendloom import plans

    path = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT 'view' AS event_type, TIMESTAMP '2024-01-01' + to_minutes(i % 3000) AS ts, i * 7919 % 9001 AS user_id, 1.0 AS value FROM range(20000) t(i)) TO '{path}' (FORMAT parquet)")
    want = duckdb.sql(plans.ORACLES["lookback_members"].replace("FROM events", f"FROM '{path}'").replace("JOIN events", f"JOIN '{path}'")).fetchall()
    got = plans.QUERIES["lookback_members"](spark, str(tmp_path)).collect()
    assert len(want) == 50 and sorted(map(tuple, got)) == sorted(want)


def test_groups_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_groups(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "v int, g string"), path, "g")
    before = {f.name for f in (tmp_path / "t" / "g=b").iterdir()}
    for _ in range(2):
        tables.write_groups(spark.createDataFrame([(9, "a"), (8, "d")], "v int, g string"), path, "g")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(3, "b"), (4, "c"), (8, "d"), (9, "a")]
    assert {f.name for f in (tmp_path / "t" / "g=b").iterdir()} == before


def plain_pnl(trades):
    held = cost = pnl = 0.0
    for _, side, q, u in sorted(trades):
        if side == "buy":
            held, cost = held + q, cost + u
        elif q > 0:
            covered = min(q, held)
            taken = cost / held * covered if held > 0 else 0.0
            held, cost, pnl = held - covered, cost - taken, pnl + u - taken
    return pnl, held, cost


@pytest.mark.parametrize("most", [7, 1000])
def test_profit_of_keys_cut_into_ranges(spark, most):
    rng = random.Random(8)
    rows = [("hot", i, rng.choice(["buy", "buy", "sell"]), float(rng.randrange(0, 9)), float(rng.randrange(1, 99))) for i in range(300)]
    rows += [("sold", i, "sell" if i % 3 else "buy", float(rng.randrange(1, 9)), 5.0) for i in range(200)]
    rows += [(f"k{i % 17}", i, rng.choice(["buy", "sell"]), float(rng.randrange(1, 5)), float(rng.randrange(1, 99))) for i in range(150)] + [(None, 1, "buy", 2.0, 8.0), (None, 2, "sell", 1.0, 9.0), ("n", 1, "buy", None, 3.0)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "w string, ts int, side string, token_amount double, usd double")
    got = {r["w"]: r for r in market.wallet_pnl(d, ["w"], ["ts"], most=most).collect()}
    assert got.keys() == {r[0] for r in rows}
    for w, r in got.items():
        mine = [(t, s, q or 0.0, u) for k, t, s, q, u in rows if k == w]
        assert (r["realized"], r["held"], r["cost"]) == pytest.approx(plain_pnl(mine), abs=1e-6), w
        assert (r["buys"], r["sells"]) == (sum(s == "buy" for _, s, _, _ in mine), sum(s == "sell" for _, s, _, _ in mine))


def vectors(spark, seed, n, tokens=60):
    rng = random.Random(seed)
    docs = {i: [f"w{min(tokens - 1, int(rng.expovariate(0.08)))}" for _ in range(rng.randrange(0, 14))] + (["common"] if i % 3 else []) for i in range(n)}
    rows = spark.createDataFrame([(i, w) for i, w in docs.items()], "id long, w array<string>")
    return docs, similarity.tf_vectors(similarity.token_rows(rows, "id", F.col("w")), "id")


@pytest.mark.parametrize("threshold,tile", [(0.42, 4096), (0.42, 5), (0.8, 8), (0.1, 50)])
def test_cosine_join_equals_all_pairs(spark, threshold, tile):
    docs, v = vectors(spark, 4, 110)
    unit = {}
    for i, w in docs.items():
        tf = {t: w.count(t) for t in set(w)}
        unit[i] = {t: n / math.sqrt(sum(x * x for x in tf.values())) for t, n in tf.items()}
    want = {}
    for a, x in unit.items():
        for b, y in unit.items():
            c = sum(v * y.get(t, 0.0) for t, v in x.items())
            if a < b and c >= threshold + 1e-9:
                want[a, b] = c
    left, right = v.withColumnRenamed("id", "a"), v.withColumnRenamed("id", "b")
    found = {(r["a"], r["b"]) for r in similarity.cosine_candidates(left, "a", right, "b", threshold, tile).collect()}
    assert want.keys() <= found
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.cosine_pairs(left, "a", right, "b", threshold, F.col("a") < F.col("b")).collect()}
    assert want.keys() <= got.keys() and all(c >= threshold - 1e-9 for c in got.values()) and all(math.isclose(got[k], c) for k, c in want.items())


def test_a_common_token_makes_few_candidates(spark):
    """A word of every post, and each post's own words: not all pairs become candidates."""
    rows = spark.createDataFrame([(i, ["common", f"own{i}", f"more{i}", f"pair{i // 2}", f"pair{i // 2}"]) for i in range(300)], "id long, w array<string>")
    v = similarity.tf_vectors(similarity.token_rows(rows, "id", F.col("w")), "id")
    n = similarity.cosine_candidates(v.withColumnRenamed("id", "a"), "a", v.withColumnRenamed("id", "b"), "b").where("a < b").count()
    assert 150 <= n < 300


def test_long_paths_and_hubs_form_groups(spark):
    path, hub = [(i, i + 1) for i in range(1, 200)], [(1000, 1000 + i) for i in range(1, 300)]
    pairs = spark.createDataFrame(path + hub + [(1, 2), (2, 1), (5, 5)], "a long, b long")
    posts = spark.range(1, 1400).toDF("post_id")
    got = {r[0]: r[1] for r in similarity.form_narratives(posts, pairs).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[300] == 300 and len(got) == 1399
    assert {r[1] for r in similarity.form_narratives(posts.limit(3), pairs.limit(0)).collect()} == {1, 2, 3}


def test_ranks_with_nulls_and_ties(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 5)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: r["rank"] for r in tiering.global_rank(d, "v", "id", per_range=30).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == {i: k for k, (i, _) in enumerate(order, 1)}
    assert tiering.global_rank(d.limit(0), "v", "id").count() == 0


def test_stories_and_accounts(one):
    mint = "9xQeWvG816bUx9EPjHmaT23yvVM2ZWbrrpZb9PusVFin"

    def score(text, handle="", followers=0, ticker="zzz", **more):
        post = {"text": F.lit(text), "posted_ms": F.lit(0), "views": F.lit(60_000), "media": F.lit(None).cast("string"), "followers": F.lit(followers), "handle": F.lit(handle)}
        found = gates.match_confidence(post, {"ticker": F.lit(ticker), "name": F.lit("Giant Dragon"), "mint": F.lit(mint), "launch_ms": F.lit(0)}, **more)
        return round(one(found["score"]), 6), one(found["reasons"])

    assert score("nothing")[0] == 0.4 and score("a dragon")[0] == 0.52 and score("a wyrm", synonyms={"dragon": ["dragon", "wyrm"]})[0] == 0.52
    story = [{"reason": "sky", "points": 0.2, "name": ["dragon"], "text": ["wyrm"], "any": ["seen", "flying"], "followers": 10}]
    assert score("wyrm seen", followers=10, stories=story) == (0.6, ["posted before launch", "viral views", "sky"])
    assert score("wyrm seen", followers=9, stories=story)[0] == 0.4 and score("wyrm", followers=10, stories=story)[0] == 0.4
    account = [{"reason": "own", "points": 0.1, "handle": "me", "text": ["hi"]}]
    assert score("hi", "ME", accounts=account)[0] == 0.5 and score("ho", "me", accounts=account)[0] == 0.4
    assert score("my diary", ticker="$diary")[0] == 0.4 and score("buy $diary", ticker="$diary")[0] == 0.6


@pytest.mark.parametrize("target,stop,status", [(1, 3, "done"), (2, 6, "done"), (3, 9, "short"), (0, 0, "done")])
def test_a_cohort_search_stops_where_both_groups_are_full(spark, target, stop, status):
    kinds = ["winner", "ignored", "loser", "winner", "winner", "loser", "ignored", "winner", "winner"]
    d = spark.createDataFrame([(i, float(-i), k) for i, k in enumerate(kinds)], "id long, v double, outcome string")
    got = reports.cohort_until(d, "v", "id", "outcome", target).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(stop)) and {r["status"] for r in got} <= {status}
    assert reports.cohort_until(d.limit(0), "v", "id", "outcome", 1).count() == 0


def test_sql_over_windows(spark):
    assert market.day_windows(90) == [(0, 30), (30, 60), (60, 90)] and market.day_windows(40) == [(0, 30), (30, 40)]
    d = spark.createDataFrame([(1, 5, "new"), (2, 35, "old"), (3, 95, "gone"), (1, 45, "older")], "k int, age int, v string")
    got = market.over_windows(spark, "SELECT k, v FROM {d} WHERE age >= :newest AND age < :oldest", 60, "k", d=d)
    assert sorted(map(tuple, got.collect())) == [(1, "older"), (2, "old")]


def test_cached_and_single(spark):
    cache = spark.createDataFrame([("a", 1, "2024-01-01 11:59:00"), ("b", 2, "2024-01-01 11:50:00"), ("c", 3, "2024-01-01 10:00:00"), ("a", 0, "2024-01-01 09:00:00")], "k string, value int, fetched_at string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    got = {r["k"]: (r["value"], r["state"], r["refresh"]) for r in tables.cached(asked, cache, "k", F.lit("2024-01-01 12:00:00").cast("timestamp"), 300, 600).collect()}
    assert got == {"a": (1, "fresh", False), "b": (2, "stale", True), "c": (None, "missing", True), "d": (None, "missing", True)}
    assert tables.maybe_single(cache, "k", "b").first()["value"] == 2 and tables.maybe_single(cache, "k", "z").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        tables.maybe_single(cache, "k", "a").collect()
