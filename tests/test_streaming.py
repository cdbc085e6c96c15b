"""Streams replayed from files give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.streaming import pipelines

START = "timestamp'2024-01-01 00:00:00'"


def test_lane_floors_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(lane, c, rng.choice([0, 3, 9]), rng.randrange(0, 40), 10) for lane in "ab" for c in range(30)]
    cycles = spark.createDataFrame(rows, "lane string, cycle long, raw long, reads long, target long")
    for i in range(3):
        cycles.where((F.col("cycle") >= i * 10) & (F.col("cycle") < (i + 1) * 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = pipelines.source(spark, f"{tmp_path}/in", cycles.schema, files_per_batch=1)
    out = pipelines.replayed(pipelines.lane_floors(stream, 1000, 100), None, "floors")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, pipelines.lane_floors_batch(cycles, 1000, 100).collect())) and len(got) == 60


def test_near_misses(spark, tmp_path):
    rows = spark.sql(f"""select * from values (1L, 50L, {START}), (2L, 10L, {START}), (3L, 500L, {START}), (1L, 150L, {START} + interval 2 hours),
        (2L, 900L, {START} + interval 20 hours), (9L, 1L, {START} + interval 40 hours), (9L, 1L, {START} + interval 41 hours) as t(post_id, views, at)""")
    for i, cond in enumerate(("at < timestamp'2024-01-01 01:00:00'", "hour(at) = 2", "at > timestamp'2024-01-01 03:00:00'")):
        rows.where(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = pipelines.source(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1)
    out = pipelines.replayed(pipelines.near_misses(stream, 100), None, "misses")
    got = {(r["post_id"], r["outcome"]) for r in spark.read.parquet(out).collect()}
    assert {(1, "promoted"), (3, "promoted")} <= got and (2, "promoted") not in got and (9, "promoted") not in got


def test_feed_merges_batches(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, 10.0, True), (2, 1, 5.0, True), (3, 1, 9.0, True)], "id long, version long, views double, eligible boolean")
    b = spark.createDataFrame([(1, 2, 7.0, True), (3, 2, 11.0, False), (4, 1, 1.0, True)], a.schema)
    for d in (a, b):
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    folder = pipelines.new_folder(spark, "t-feed")
    stream = pipelines.source(spark, f"{tmp_path}/in", a.schema, files_per_batch=10)
    pipelines.replayed(stream, pipelines.feed_sink(folder, 2), "feed")
    got = [(r["id"], r["views"]) for r in pipelines.latest_feed(spark, folder).orderBy(F.col("views").desc()).collect()]
    assert got == [(1, 10.0), (2, 5.0)]
    again = pipelines.new_folder(spark, "t-feed")
    pipelines.replayed(pipelines.source(spark, f"{tmp_path}/in", a.schema, files_per_batch=1), pipelines.feed_sink(again, 3), "feed")
    assert {r["id"] for r in pipelines.latest_feed(spark, again).collect()} == {1, 2, 4}
    merged = pipelines.feed_merge(pipelines.feed_merge(None, a, 80), b, 80)
    assert {r["id"] for r in merged.collect()} == {1, 2, 4}


def test_windows_close_after_the_watermark(spark, tmp_path):
    rows = spark.sql(f"select 'k' k, {START} + make_dt_interval(0, cast(id as int)) ts, 1.0 v from range(0, 10)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = pipelines.source(spark, f"{tmp_path}/in", rows.schema)
    out = pipelines.replayed(pipelines.window_sums(stream, ["k"], "ts", "v", late="2 hours"), None, "sums")
    got = spark.read.parquet(out).collect()
    batch = pipelines.window_sums(rows, ["k"], "ts", "v").collect()
    assert {tuple(r) for r in got} <= {tuple(r) for r in batch} and len(batch) == 10 and len(got) >= 7


@pytest.mark.parametrize("slide,windows", [(None, 10), ("30 minutes", 20)])
def test_sliding_windows(spark, slide, windows):
    rows = spark.sql(f"select 'k' k, {START} + make_dt_interval(0, cast(id as int)) ts, 1.0 v from range(0, 10)")
    assert pipelines.window_sums(rows, ["k"], "ts", "v", "1 hour", slide).count() == windows
