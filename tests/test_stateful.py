"""Streams with keyed state: equal to batch forms or brute-force replays, resumed between files, and empty in the end."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import budget, similarity
from trendloom.streaming import pipelines, stateful

START = "timestamp'2024-01-01 00:00:00'"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Two tasks of state a stream are enough here, and start faster."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def resumed(spark, tmp_path, parts, make, name):
    """Run a stream once after each part of its input arrives, with one checkpoint; all its output."""
    out, marks = f"{tmp_path}/out", f"{tmp_path}/marks"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pipelines.replayed(make(pipelines.source(spark, f"{tmp_path}/in", part.schema)), None, name, out=out, marks=marks)
    return spark.read.parquet(out)


def at(hours):
    return f"{START} + make_dt_interval(0, 0, 0, {hours} * 3600.0)"


def test_a_restart_reads_nothing_twice(spark, tmp_path):
    rows = [spark.range(i * 10, i * 10 + 10).toDF("k") for i in range(3)]
    out, marks = f"{tmp_path}/out", f"{tmp_path}/marks"
    for i, r in enumerate(rows):
        r.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pipelines.replayed(pipelines.source(spark, f"{tmp_path}/in", r.schema), None, "again", out=out, marks=marks)
        assert sorted(x[0] for x in spark.read.parquet(out).collect()) == list(range(10 * (i + 1)))


def test_misses_are_forgotten(spark, tmp_path):
    rows = spark.sql(f"""select * from values (1L, 50L, {START}), (2L, 10L, {START}), (3L, 500L, {START}), (1L, 150L, {at(2)}), (1L, 900L, {at(3)}), (2L, 900L, {at(20)}),
        (3L, 700L, {at(21)}), (9L, 1L, {at(60)}), (9L, 1L, {at(90)}) as t(post_id, views, at)""")
    parts = [rows.where(c) for c in (f"at < {at(1)}", f"at = {at(2)}", f"at = {at(3)}", f"at > {at(3)} and at < {at(30)}", f"at = {at(60)}", f"at = {at(90)}")]
    got = resumed(spark, tmp_path, parts, lambda s: stateful.near_misses(s, 100), "misses")
    told = [(r["post_id"], r["outcome"], r["views"]) for r in got.collect()]
    assert sorted(told)[:3] == [(1, "promoted", 150), (2, "expired", 10), (3, "promoted", 500)]
    # A count that comes too late tells nothing; what came last is all that is still known.
    assert (9, "expired", 1) in told and len(told) == 4
    kept = spark.read.format("statestore").option("stateVarName", "post").load(f"{tmp_path}/marks")
    assert {r["key"][0] for r in kept.collect()} <= {9}


def test_ledger_equals_running_spend(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice("ab"), i, rng.randrange(0, 3 * 86_400), rng.randrange(1, 9) * 0.5) for i in range(300)], "lane string, tie long, s long, amount double")
    rows = rows.select("lane", F.expr(f"{START} + make_dt_interval(0, 0, 0, s)").alias("at"), "tie", "amount")
    parts = [rows.where(f"at >= {at(a)} and at < {at(b)}") for a, b in ((0, 20), (20, 30), (30, 72))]
    last = spark.sql(f"select 'z' lane, {at(200)} at, 0L tie, 0.0D amount")
    got = resumed(spark, tmp_path, [*parts, last], lambda s: stateful.spend_ledger(s, ["lane"], 6, 90), "ledger")
    batch = budget.running_spend(rows, "at", "tie", "amount", ["lane"])
    want = batch.select("lane", "at", "tie", "hour_spent", "day_spent", budget.blocked(F.col("hour_spent"), F.col("day_spent"), 6, 90).alias("blocked"))
    mine = sorted(map(tuple, got.where("lane <> 'z'").collect()), key=str)
    assert mine == sorted(map(tuple, want.collect()), key=str) and {r[5] for r in mine} == {None, "hour", "day"}
    kept = spark.read.format("statestore").option("stateVarName", "spent").load(f"{tmp_path}/marks")
    assert {r["key"][0] for r in kept.collect()} <= {"z"}


def test_ledger_keeps_the_days_of_a_key_apart(spark, tmp_path):
    rows = spark.range(60).select(F.lit("a").alias("lane"), F.expr(f"{START} + make_dt_interval(0, cast(id as int), 0, 0)").alias("at"), F.col("id").alias("tie"), F.lit(1.0).alias("amount"))
    got = resumed(spark, tmp_path, [rows], lambda s: stateful.spend_ledger(s, ["lane"], 6, 90), "ledger")
    assert sorted((r["tie"], r["day_spent"]) for r in got.collect()) == [(i, 1.0 + i % 24) for i in range(60)]
    kept = spark.read.format("statestore").option("stateVarName", "spent").load(f"{tmp_path}/marks")
    assert {len(r["key"]) for r in kept.collect()} == {2}


def test_alarms_equal_batch_and_sound_in_silence(spark, tmp_path):
    rng = random.Random(4)
    minutes, rows = 0, []
    for i in range(250):
        minutes += rng.choice([5, 20, 40, 70, 200])
        rows.append(("a", i, minutes * 60, rng.choice([0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.9])))
    rows += [("b", 0, 0, 0.1), ("c", 0, 0, None), ("d", 0, 0, 0.1), ("d", 1, 3600, 0.5)]
    d = spark.createDataFrame(rows, "lane string, tie long, s long, share double").select("lane", F.expr(f"{START} + make_dt_interval(0, 0, 0, s)").alias("at"), "tie", "share")
    cuts = [0, 90, 91, 10_000]
    parts = [d.where(f"at >= {at(a)} and at < {at(b)}") for a, b in itertools.pairwise(cuts)]
    end = spark.sql(f"select 'z' lane, {at(1000)} at, 0L tie, 0.9D share")
    later = spark.sql(f"select 'z' lane, {at(1001)} at, 1L tie, 0.9D share")
    got = resumed(spark, tmp_path, [*parts, end, later], lambda s: stateful.underused_alarms(s, ["lane"]), "alarms")
    batch = {(r["lane"], r["at"]) for r in budget.underused_alarms(d, "at", "share", "tie", ["lane"]).where("alarm").collect()}
    assert {(r["lane"], r["at"]) for r in got.where("kind = 'row'").collect()} == batch and batch

    silent = set()
    for lane in "abcd":
        since, at_of = None, [(s, share) for k, _, s, share in sorted(rows, key=lambda r: (r[2], r[1])) if k == lane]
        spells, hours = [], set()
        for s, share in [*at_of, (1000 * 3600, 0.9)]:
            if share is not None and share < 0.3:
                since = s if since is None else since
                spells.append(s)
            elif since is not None:
                hours = {(x - since - 7200) // 3600 for x in spells}
                silent |= {(lane, since + 7200 + (k + 1) * 3600) for k in range((s - since - 7200) // 3600) if k not in hours}
                since, spells = None, []
    told = {(r["lane"], int(r["s"])) for r in got.where("kind = 'silent'").select("lane", (F.unix_seconds("at") - F.unix_seconds(F.expr(START))).alias("s")).collect()}
    assert {x for x in told if x[1] <= 999 * 3600} == {x for x in silent if x[1] <= 999 * 3600} and any(k == "b" for k, _ in told)


def test_requests_equal_a_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("xt"), h, f"term{rng.randrange(8)}", rng.randrange(50)) for h in range(0, 60) for _ in range(6)]
    d = spark.createDataFrame(rows, "platform string, h long, term string, views long").select("platform", F.expr(f"{START} + make_dt_interval(0, 0, h * 20)").alias("at"), "term", "views", "h")
    parts = [d.where(f"h >= {a} and h < {b}").drop("h") for a, b in ((0, 1), (1, 30), (30, 60))]
    end = spark.sql(f"select 'z' platform, {at(100)} at, 'q' term, 1L views")
    got = resumed(spark, tmp_path, [*parts, end], lambda s: stateful.trend_requests(s, "platform", 45, 2, 30), "trends")
    want = []
    for p in "xt":
        fetched, used = {}, {}
        for h in range(60):
            best = {}
            for _, _, t, v in (r for r in rows if r[0] == p and r[1] == h):
                best[t] = max(v, best.get(t, 0))
            asked = 0
            for t, v in sorted(best.items(), key=lambda x: (-x[1], x[0])):
                if asked < 2 and used.get(h // 72, 0) < 30 and fetched.get(t, -9) * 20 < h * 20 - 45:
                    fetched[t], asked = h, asked + 1
                    used[h // 72] = used.get(h // 72, 0) + 1
                    want.append((p, h, t, v))
    mine = got.where("platform <> 'z'").select("platform", ((F.unix_seconds("at") - F.unix_seconds(F.expr(START))) / 1200).cast("long"), "term", "views")
    assert sorted(map(tuple, mine.collect())) == sorted(want)
    kept = spark.read.format("statestore").option("stateVarName", "fetched").load(f"{tmp_path}/marks")
    assert {r["key"][0] for r in kept.collect()} <= {"z"}


def plain_greedy(cycles, keyword=similarity.KEYWORD, cosine=similarity.COSINE, max_age=24 * 60):
    """The assignment by comparing each post with every open narrative; cycles: (minute, posts)."""
    open_, out = [], []
    dot = lambda a, b: sum(v * b.get(w, 0.0) for w, v in a.items())
    unit = lambda v: {w: x / (sum(y * y for y in v.values()) ** 0.5 or 1.0) for w, x in v.items()}

    def centroid(n):
        total = {}
        for m in n["members"]:
            for w, x in m["vec"].items():
                total[w] = total.get(w, 0.0) + x
        return unit(total)

    for minute, posts in cycles:
        open_ = sorted((n for n in open_ if minute - n["newest"] <= max_age), key=lambda n: n["id"])
        for n in open_:
            n["fixed"] = None
        for p in sorted(posts, key=lambda p: (-p["score"], p["post_id"])):
            vec = unit({w: float(p["words"].count(w)) for w in p["words"]})
            me = {"handle": p["handle"].lstrip("@").lower(), "tags": set(p["tags"]), "words": set(p["words"]), "vec": vec}
            hit = next(((n, "cashtag") for n in open_ if any(m["tags"] & me["tags"] for m in n["members"])), None)
            others = [n for n in open_ if not me["handle"] or all(m["handle"] != me["handle"] for m in n["members"])]
            over = lambda n: max((len(m["words"] & me["words"]) / len(m["words"] | me["words"]) for m in n["members"] if m["words"] | me["words"]), default=0.0)
            hit = hit or next(((n, "keyword") for n in others if over(n) >= keyword), None)
            if not hit:
                near = [(round(dot(vec, n["fixed"] or centroid(n)), 12), -i) for i, n in enumerate(others)]
                if near and max(near)[0] >= cosine:
                    hit = others[-max(near)[1]], "embedding"
            if not hit:
                hit = {"id": p["post_id"], "members": [], "fixed": vec, "newest": minute}, "new"
                open_.append(hit[0])
            hit[0]["members"].append(me)
            hit[0]["newest"] = minute
            out.append((p["post_id"], hit[0]["id"], hit[1]))
    return out


def random_posts(seed, n, first=0):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    return [{"post_id": first + i, "handle": rng.choice(["@A", "a", "b", "c", "", "d"]), "score": rng.choice([0.1, 0.5, 0.9]), "tags": rng.sample(["X", "Y", "Z"], rng.choice([0, 0, 0, 1])),
             "words": [words[min(29, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 12))]} for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_comparing_with_all(seed):
    members, got, cycles = {}, [], [(0, random_posts(seed, 80)), (1, random_posts(seed + 50, 80, 100))]
    for _, posts in cycles:
        got += [r[:3] for r in similarity.assign_cycle(posts, members, similarity.KEYWORD, similarity.COSINE)]
    assert got == plain_greedy(cycles) and {r[2] for r in got} == {"new", "keyword", "embedding", "cashtag"}


def test_narratives_over_cycles(spark, tmp_path):
    """Three cycles and one after all narratives have aged out, each in a run of its own, against a replay; two shards."""
    hours, shards = (0, 1, 30, 90), {}
    parts = []
    for i, h in enumerate(hours):
        rows = []
        for s in "pq":
            posts = random_posts(10 * i + ord(s), 40, 1000 * i + (500 if s == "q" else 0))
            shards.setdefault(s, []).append((h * 60, posts))
            rows += [(s, p["post_id"], p["handle"], p["score"], p["tags"], p["words"]) for p in posts]
        d = spark.createDataFrame(rows, "shard string, post_id long, handle string, score double, tags array<string>, words array<string>")
        parts.append(d.withColumn("at", F.expr(at(h))))
    got = resumed(spark, tmp_path, parts, lambda s: stateful.narratives(s, "shard", max_age_min=29 * 60), "narratives")
    for s, cycles in shards.items():
        mine = sorted((r["post_id"], r["narrative_id"], r["reason"]) for r in got.where(F.col("shard") == s).collect())
        assert mine == sorted(plain_greedy(cycles, max_age=29 * 60))
    batch = similarity.greedy_cluster(parts[0], "shard")
    assert sorted(map(str, batch.collect())) == sorted(map(str, got.where(F.col("at") == F.expr(at(0))).drop("at").collect()))


def test_members_from_before(spark):
    cycles = [(0, random_posts(3, 60)), (1, random_posts(33, 60, 100))]
    members = {}
    similarity.assign_cycle(cycles[0][1], members, similarity.KEYWORD, similarity.COSINE)
    schema = "shard string, post_id long, handle string, score double, tags array<string>, words array<string>"
    posts = spark.createDataFrame([("s", p["post_id"], p["handle"], p["score"], p["tags"], p["words"]) for p in cycles[1][1]], schema)
    rows = [("s", n, k, h, t, w) for n, ms in members.items() for k, (h, t, w) in enumerate(ms)]
    old = spark.createDataFrame(rows, "shard string, narrative_id long, post_id long, handle string, tags array<string>, words array<string>")
    got = similarity.greedy_cluster(posts, "shard", members=old)
    assert sorted((r["post_id"], r["narrative_id"], r["reason"]) for r in got.collect()) == sorted(plain_greedy(cycles)[60:])


def test_floor_rules_agree(spark):
    grid = [(b, r, n, t, z, 100) for b in (100, 1000, 99_000) for r in (None, 0, 5) for n in (None, 0, 5, 6, 11) for t in (None, 0, 10) for z in (None, False, True)]
    d = spark.createDataFrame(grid, "b long, r long, n long, t long, z boolean, low long")
    got = [r[0] for r in d.select(budget.next_floor(*(F.col(c) for c in d.columns))).collect()]
    assert got == [budget.next_floor_value(*row) for row in grid]
