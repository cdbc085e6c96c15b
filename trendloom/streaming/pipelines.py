"""Structured Streaming: windows over snapshots, late data, retry queue, lane floors, and a merged feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.budget import next_floor, next_floor_value
from ..session import new_folder
from .stateful import near_misses  # noqa: F401


def replayed(rows: DataFrame, sink: Callable[[DataFrame, int], None] | None, name: str, mode: str = "append", out: str | None = None, marks: str | None = None) -> str:
    """Run a stream over what its source holds now (T1); returns the folder of its output.

    Without a sink the rows are appended as Parquet, exactly once by the file sink's log. marks is the folder of the checkpoint:
    a query that is started again with the same marks and out goes on where the last one stopped and reads nothing twice
    (T11). Folders that aren't given are new ones in the shared folder, for a replay that begins anew.
    """
    spark = rows.sparkSession
    out, marks = out or new_folder(spark, name), marks or new_folder(spark, f"{name}-marks")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return out


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder or glob of Parquet files as a stream; new files are new rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def on_time(rows: DataFrame, event_time: str, arrival: str, max_age_min: int = 360) -> DataFrame:
    """Rows that were young enough when they arrived, under a watermark of the same length (T4).

    The filter decides; the watermark alone bounds state but promises nothing about single rows.
    """
    rows = rows.withWatermark(event_time, f"{max_age_min} minutes")
    return rows.where(F.col(event_time) >= F.col(arrival) - F.expr(f"INTERVAL {max_age_min} MINUTES"))


def first_sight(rows: DataFrame, key: str, event_time: str, horizon: str = "24 hours") -> DataFrame:
    """Each key once within the horizon (T5)."""
    return rows.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def window_sums(rows: DataFrame, by: list[str], event_time: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(by, start, views, n) of tumbling windows, sliding ones with `slide`."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    sums = rows.withWatermark(event_time, late).groupBy(*by, w.alias("w")).agg(F.sum(value).alias("views"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, F.col("w.start").alias("start"), "views", "n")


def active_spells(rows: DataFrame, key: str, event_time: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(key, opened, closed, n): spells of activity that end after a gap without rows."""
    spells = rows.withWatermark(event_time, late).groupBy(key, F.session_window(event_time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return spells.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def lane_floors(cycles: DataFrame, base: int, lane_min: int, floor_max: int = 100_000) -> DataFrame:
    """cycles(lane, cycle long, raw long, reads long, target long[, any_zero boolean]) -> (lane, cycle, floor): the controller with state.

    The rule is budget.next_floor's. any_zero says that another lane found nothing in the cycle, false where the column is missing. Cycles of a
    lane that come in one batch are taken in order. A lane keeps one number for good.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    if "any_zero" not in cycles.columns:
        cycles = cycles.withColumn("any_zero", F.lit(False))

    def step(key, batches, state):
        floor, out = state.get[0] if state.exists else base, []
        for c in pd.concat(list(batches)).sort_values("cycle").itertuples():
            floor = next_floor_value(floor, c.raw, c.reads, c.target, c.any_zero, lane_min, floor_max)
            out.append((key[0], c.cycle, floor))
        state.update((floor,))
        yield pd.DataFrame(out, columns=["lane", "cycle", "floor"])

    return cycles.groupBy("lane").applyInPandasWithState(step, "lane string, cycle long, floor long", "floor long", "append", GroupStateTimeout.NoTimeout)


def lane_floors_batch(cycles: DataFrame, base: int, lane_min: int, floor_max: int = 100_000) -> DataFrame:
    """The same floors over a finished table: a fold over each lane's cycles in order. A lane has a few hundred cycles a day."""
    if "any_zero" not in cycles.columns:
        cycles = cycles.withColumn("any_zero", F.lit(False))
    row = F.struct("cycle", "raw", "reads", "target", "any_zero")
    kind = "struct<f:bigint,out:array<struct<cycle:bigint,floor:bigint>>>"
    start = F.struct(F.lit(base).cast("long").alias("f"), F.array().cast("array<struct<cycle:bigint,floor:bigint>>").alias("out")).cast(kind)

    def step(acc, c):
        f = next_floor(acc["f"], c["raw"], c["reads"], c["target"], c["any_zero"], F.lit(lane_min), floor_max)
        return F.struct(f.alias("f"), F.concat(acc["out"], F.array(F.struct(c["cycle"].alias("cycle"), f.alias("floor")))).alias("out"))

    lanes = cycles.groupBy("lane").agg(F.sort_array(F.collect_list(row)).alias("c"))
    return lanes.select("lane", F.inline(F.aggregate("c", start, step, lambda acc: acc["out"])))


def feed_merge(feed: DataFrame | None, batch: DataFrame, size: int = 80) -> DataFrame:
    """A feed after a batch of changes: one row an id with the newest fields, counts that never fall, and the `size` most viewed.

    feed and batch(id, version, views, eligible). Ids that are no longer eligible leave.
    """
    rows = batch if feed is None else feed.unionByName(batch)
    seen = rows.groupBy("id").agg(F.max("version").alias("version"), F.max("views").alias("views"), F.max_by("eligible", "version").alias("eligible"))
    return seen.where("eligible").orderBy(F.col("views").desc(), "id").limit(size)


def feed_sink(folder: str, size: int = 80) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the feed as one folder a batch; a repeated batch writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/batch={number - 1}") if number else None
        feed_merge(old, batch, size).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed after the last batch."""
    feeds = spark.read.parquet(folder)
    return feeds.join(F.broadcast(feeds.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")  # one row


def top_of_windows(sums: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest windows of each key, for finished sums (batch)."""
    w = Window.partitionBy(by).orderBy(F.col("views").desc(), "start")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
