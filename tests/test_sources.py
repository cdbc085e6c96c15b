import json

from pyspark.sql import functions as F

from trendloom.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", you', "a\nb"), (2, "", None)]
    d = spark.createDataFrame(rows, "k int, a string, b string")
    files.write_csv(d, f"{tmp_path}/out", {"seed": 42})
    got = files.read_csv(spark, f"{tmp_path}/out", "k int, a string, b string").orderBy("k").collect()
    assert tuple(got[0]) == rows[0] and got[1]["k"] == 2
    assert json.loads(spark.read.text(f"{tmp_path}/out.meta").first()[0]) == {"seed": 42}


def test_csv_comments_and_aliases(spark, tmp_path):
    (tmp_path / "x.csv").write_text('# made by hand\nrow_id,Author,ath\n1, joe ,5\n2,,\n')
    c = files.canonical(files.read_csv(spark, f"{tmp_path}/x.csv"), {"author": ["Author"]}, ["row_id", "author", "missing"])
    assert [tuple(r) for r in c.orderBy("row_id").collect()] == [("1", "joe", None), ("2", None, None)]


def test_answers_with_comments_are_classed(spark, tmp_path):
    from trendloom.functions.gates import peak_class

    (tmp_path / "answers.csv").write_text("# ANSWER KEY\n# join on row_id\n\nrow_id,ath_price,peak_multiple\n1,0.000053,1.37\n2,0.1,5.0\n3,0.2,2.0\n4,0.3,\n5,0.4,4.99\n6,0.5,1.99\n7,0.6,731.5\n")
    got = files.read_csv(spark, f"{tmp_path}/answers.csv").groupBy(peak_class(F.col("peak_multiple").try_cast("double")).alias("c")).count()
    assert {r["c"]: r["count"] for r in got.collect()} == {"ran": 2, "middle": 2, "fizzled": 2, "unknown": 1}


def test_post_parsers(spark):
    x = {"id": "1", "text": "hi", "createdAt": "2024-01-01T00:00:00Z", "viewCount": 5, "author": {"userName": "joe", "followers": 3}, "extendedEntities": {"media": [{"type": "photo", "media_url_https": "u"}]}}
    got = files.parse_x_posts(spark.createDataFrame([(json.dumps(x),), ("{broken",), ("{}",)], "value string")).collect()
    assert len(got) == 1 and (got[0]["views"], got[0]["likes"], got[0]["posted_at"], got[0]["media_type"]) == (5, 0, 1704067200000, "photo")
    t = [{"aweme_id": "7", "desc": "d", "createTime": 1704067200, "stats": {"playCount": 0, "diggCount": 4}, "author": {"uniqueId": "u"}, "music": {"id": "m"}}, {"id": "8", "text": "t", "playCount": 9, "musicMeta": {"musicId": "n"}}]
    raw = spark.createDataFrame([(json.dumps(v),) for v in t], "value string")
    a, b = files.parse_tt_posts(raw).orderBy("platform_post_id").collect()
    assert (a["views"], a["likes"], a["handle"], a["sound_id"], a["posted_at"]) == (0, 4, "u", "m", 1704067200000) and b["views"] == 9
    assert files.parse_tt_posts(raw, zero_as_null=True).orderBy("platform_post_id").first()["views"] is None


def test_series_parsers(spark):
    raw = spark.createDataFrame([("a", "[[1,1,2,0.5,1.5,9],[2,1,1,1,0,1]]"), ("b", '[{"unix_time":3,"o":1,"h":1,"l":1,"c":2,"v":1}]')], "k string, p string")
    assert sorted((r["k"], r["unixTime"], r["c"]) for r in files.parse_candles(raw, "k", "p").collect()) == [("a", 1, 1.5), ("b", 3, 2.0)]
    tl = spark.createDataFrame([("t", '{"interest_over_time":{"timeline_data":[{"values":[{"value":"3"},{"extracted_value":3}]},{"values":[]}]}}'), ("u", "x")], "term string, p string")
    assert {r["term"]: r["series"] for r in files.parse_trend(tl, "term", "p").collect()} == {"t": [3.0, 0.0]}
    pair = {"pairAddress": "p", "priceUsd": "0.5", "baseToken": {"address": "m", "symbol": "wif"}, "quoteToken": {"symbol": "SOL"}, "liquidity": {"usd": 5}}
    r = files.map_pairs(spark.createDataFrame([(json.dumps(pair),)], "value string")).first()
    assert (r["mint"], r["symbol"], r["sol_quote"], r["price"], r["liquidity"]) == ("m", "WIF", True, 0.5, 5.0)


def test_includes_and_sheet(spark):
    posts = spark.createDataFrame([("1", "u1", ["m1"]), ("2", "u9", None)], "id string, author_id string, media_keys array<string>")
    users, media = spark.createDataFrame([("u1", "joe", 5)], "id string, username string, followers int"), spark.createDataFrame([("m1", "url", "photo")], "media_key string, url string, type string")
    got = {r["id"]: (r["handle"], r["media_url"]) for r in files.with_includes(posts, users, media).collect()}
    assert got == {"1": ("joe", "url"), "2": (None, None)}
    s = files.sheet(spark.sql("select 'a\nb  c' x, timestamp'2024-01-02 03:04:05' t, repeat('z', 9) y, cast(null as string) n"), ["x", "t", "y", "n"], 5).first()
    assert tuple(s) == ("a b c", "2024-01-02", "zzzz…", "")


def test_state_and_log(spark, tmp_path):
    files.write_state(spark.range(5), f"{tmp_path}/state")
    files.write_state(spark.range(2), f"{tmp_path}/state")
    assert sorted(r["id"] for r in files.read_state(spark, f"{tmp_path}/state", "id long").collect()) == [0, 1]
    for _ in range(2):
        files.append(spark.range(3), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
