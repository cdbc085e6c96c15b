"""Preference pairs against a brute-force version."""

import random

from pyspark.sql import functions as F

from trendloom.llm import preference, queries


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def mask(turns):
    out, at = [], 0
    for r, t in turns:
        start = at + len(f"<|im_start|>{r}\n")
        at = start + len(t) + len("<|im_end|>\n")
        out += [(start, at)] if r == "assistant" else []
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for p in range(60):
        turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "é\U0001f600", "long " * 5]))
        shared = [turn() for _ in range(rng.randrange(0, 4))]
        sides = [shared + [turn() for _ in range(rng.randrange(0, 3))] for _ in range(2)]
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        want[p] = (n, render(sides[0][:n]), render(sides[0][n:]), render(sides[1][n:]), mask(sides[0][n:]), mask(sides[1][n:]))
        for s, turns in enumerate(sides):
            rows += [(2 * p + s, k, r, t, "x") for k, (r, t) in enumerate(turns)]
        if not sides[0] and not sides[1]:
            del want[p]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, side string")
    pairs = preference.gather_turns(d, *preference.even_and_odd(F.col("conv_id")))
    got = {r["pair_id"]: (r["prefix_turns"], r["prompt"], r["chosen"], r["rejected"], [tuple(x) for x in r["chosen_mask"]], [tuple(x) for x in r["rejected_mask"]]) for r in preference.format_preferences(pairs).collect()}
    assert got == want


def test_nulls_and_empty(spark):
    pairs = spark.createDataFrame([(1, None, [(0, "user", "x")]), (2, None, None)], "pair_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>")
    got = {r["pair_id"]: r for r in preference.format_preferences(pairs).collect()}
    assert got[1]["prefix_turns"] == 0 and got[1]["rejected"].endswith("x<|im_end|>\n") and got[2]["prompt"] == ""
    assert preference.format_preferences(pairs.limit(0)).count() == 0


def test_large_ids_and_repeated_turns(spark):
    top = 1 << 60
    rows = [(top + k, 0, "user", f"t{k}") for k in range(8)] * 2 + [(-1, 0, "user", "m"), (None, 0, "user", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(preference.gather_turns(d, *preference.even_and_odd(F.col("conv_id"))).collect(), key=str)
    seen = {r["pair_id"]: ([t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]) for r in got}
    assert seen == {top // 2 + k: ([f"t{2 * k}"], [f"t{2 * k + 1}"]) for k in range(4)} | {-1: ([], ["m"]), None: ([], [])}


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(con.execute(f"SELECT pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask FROM ({queries.oracle_sql()['op7_preference_format']})").fetchall())
    got = sorted(map(tuple, queries.op7_preference_format(spark, "/root/testdata/sf0.001").collect()))
    assert len(got) > 5 and got == want
