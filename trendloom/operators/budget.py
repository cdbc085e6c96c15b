"""Spend ledgers, lane floors and conversion, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_spend(rows: DataFrame, ts: str, tie: str, amount: str, by: list[str] | None = None) -> DataFrame:
    """rows with day_spent and hour_spent: what was spent in the row's day and hour up to and with it.

    Rows are added up within seconds; what came before a second, in its hour and its day, comes from the seconds' sums, of which
    a day has 86,400 at most. So a busy hour isn't one task. Rows without a time are in no day and drop out.
    """
    by = by or []
    r = rows.withColumn("_second", F.date_trunc("second", F.col(ts).cast("timestamp")))
    sums = r.groupBy(*by, "_second").agg(F.sum(amount).alias("_s"))
    before = lambda unit: F.coalesce(F.sum("_s").over(Window.partitionBy(*by, F.date_trunc(unit, "_second")).orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_second", before("day").alias("_day"), before("hour").alias("_hour"))
    within = F.sum(amount).over(Window.partitionBy(*by, "_second").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    out = r.withColumn("_spent", within).join(sums, [*by, "_second"])
    return out.withColumn("hour_spent", F.col("_spent") + F.col("_hour")).withColumn("day_spent", F.col("_spent") + F.col("_day")).drop("_second", "_spent", "_hour", "_day")


def blocked(hour_spent: Column, day_spent: Column, hourly: float, daily: float) -> Column:
    """day, hour or null: which limit a read would break."""
    return F.when(day_spent > daily, "day").when(hour_spent > hourly, "hour")


def daily_spend(rows: DataFrame, ts: str, amount: str) -> DataFrame:
    """(day, spent, month_projection): daily sums and the month they would give."""
    per = rows.groupBy(F.to_date(F.col(ts).cast("timestamp")).alias("day")).agg(F.sum(amount).alias("spent"))
    return per.withColumn("month_projection", F.col("spent") * F.day(F.last_day("day")))


def trailing_average(rows: DataFrame, ts: str, amount: str, now: Column, days: int = 7) -> DataFrame:
    """Mean per day over the days before now, days without rows counting as zero."""
    t = F.col(ts).cast("timestamp")
    inside = (t < now) & (t >= now - F.expr(f"INTERVAL {days} DAYS"))
    return rows.agg((F.coalesce(F.sum(F.when(inside, F.col(amount))), F.lit(0.0)) / days).alias("per_day"), F.count_if(inside).alias("n"))


def latest_spend(rows: DataFrame, ts: str, tie: str, amount: str, n: int = 500) -> DataFrame:
    """Sum over the n latest rows (A45; n is the feature)."""
    return rows.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n).agg(F.sum(amount).alias("spent"), F.count(F.lit(1)).alias("n"))


def lane_conversion(rows: DataFrame, lane: str, converted: Column) -> DataFrame:
    """(lane, n, converted, rate)."""
    return rows.groupBy(lane).agg(F.count(F.lit(1)).alias("n"), F.count_if(converted).alias("converted")).withColumn("rate", F.col("converted") / F.col("n"))


def lane_share(share: Column, lane_rate: Column, other_rate: Column, step: float = 0.05, low: float = 0.15, high: float = 0.45) -> Column:
    """A lane's share moved a step toward the better rate, within bounds."""
    moved = F.when(lane_rate > other_rate, share + step).when(lane_rate < other_rate, share - step).otherwise(share)
    return F.round(F.least(F.greatest(moved, F.lit(low)), F.lit(high)), 4)


def next_floor(base: Column, raw: Column, reads: Column, target: Column, any_zero: Column, lane_min: Column, floor_max: int = 100_000) -> Column:
    """A lane's next floor from its own results.

    Nothing found: 40 % less. Another lane empty: held. More reads than the target: 20 % more. Under 60 % of it: 20 % less.
    """
    t = F.greatest(F.coalesce(target, F.lit(1)), F.lit(1))
    low = lambda share: F.greatest(lane_min, F.floor(base * share))
    return (
        F.when(F.coalesce(raw, F.lit(0)) == 0, low(0.6)).when(F.coalesce(any_zero, F.lit(False)), base)
        .when(reads > t, F.least(F.lit(floor_max), F.ceil(base * 1.2))).when(F.coalesce(reads, F.lit(0)) < t * 0.6, low(0.8)).otherwise(base)
    ).cast("long")


def next_floor_value(base: int, raw: int | None, reads: int | None, target: int | None, any_zero: bool | None, lane_min: int, floor_max: int = 100_000) -> int:
    """next_floor of plain numbers, for keyed state; a test holds the two equal."""
    import math

    target, reads = max(1, target or 1), reads or 0
    if not raw:
        return max(lane_min, math.floor(base * 0.6))
    if any_zero:
        return base
    if reads > target:
        return min(floor_max, math.ceil(base * 1.2))
    return max(lane_min, math.floor(base * 0.8)) if reads < target * 0.6 else base


def decayed_floor(base: Column, lane_min: Column, spent_share: Column, hours_since: Column) -> Column:
    """10 % less each hour while under half of the budget is spent."""
    decays = (spent_share < 0.5) & F.coalesce(hours_since >= 1, F.lit(True))
    return F.when(decays, F.greatest(lane_min, F.floor(base * 0.9))).otherwise(base).cast("long")


def underused_alarms(rows: DataFrame, ts: str, share: str, tie: str, by: list[str], least: float = 0.3, hours: float = 2.0) -> DataFrame:
    """rows with alarm: the share has been below `least` for `hours` on end, told once an hour (T10, batch form).

    A spell begins at the first low row after a row that isn't low; the alarm sounds on the first row of each full hour after
    the first two.
    """
    w = Window.partitionBy(*by).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low = F.coalesce(F.col(share) < least, F.lit(False))
    r = rows.withColumn("_us", us).withColumn("_low", low).withColumn("_spell", F.sum(F.when(F.col("_low"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*by, "_spell").orderBy(ts, tie)
    since = F.min(F.when(F.col("_low"), F.col("_us"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(F.col("_low"), F.floor((F.col("_us") - since) / 3_600_000_000.0 - hours))
    r = r.withColumn("_step", step)
    return r.withColumn("alarm", F.coalesce((F.col("_step") >= 0) & (F.col("_step") > F.coalesce(F.lag("_step").over(own), F.lit(-1))), F.lit(False))).drop("_us", "_low", "_spell", "_step")


def funnel(rows: DataFrame, by: list[str], gates: dict[str, Column]) -> DataFrame:
    """(by, total, <gate>...): rows that pass each gate and all before it."""
    passed, counts = F.lit(True), []
    for name, gate in gates.items():
        passed = passed & F.coalesce(gate, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def bottlenecks(funnels: DataFrame, steps: list[str], least: float = 0.2) -> DataFrame:
    """funnels with bottlenecks: the steps that keep less than `least` of what reached them."""
    before = ["total", *steps[:-1]]
    weak = [F.when(F.col(a) > 0, F.when(F.col(b) / F.col(a) < least, F.lit(b))) for a, b in zip(before, steps)]
    return funnels.withColumn("bottlenecks", F.array_compact(F.array(*weak)))
