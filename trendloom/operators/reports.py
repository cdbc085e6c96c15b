"""Distributions, threshold studies and outcome tables of the back-testing lab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Edges of score bands, cumulative thresholds, and candidates for the elbow in order of preference.
BANDS = [0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]
CANDIDATES = [0.7, 0.65, 0.75, 0.6, 0.8]


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, min, p25, median, p75, max), interpolated linearly."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(value).alias("max"))


def unpivoted(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return rows.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def separation(rows: DataFrame, features: list[str], group: str = "outcome", win: str = "winner", lose: str = "loser") -> DataFrame:
    """(feature, separation, ...): gap of the medians over the larger interquartile range, best first.

    All features are measured in one pass; a feature that one side lacks separates nothing.
    """
    d = distribution(unpivoted(rows.where(F.col(group).isin(win, lose)), [group], features), ["feature", group], "value")
    side = lambda name, c: F.max(F.when(F.col(group) == name, F.col(c))).alias(f"{name}_{c}")
    wide = d.groupBy("feature").agg(*[side(g, c) for g in (win, lose) for c in ("median", "p25", "p75")])
    spread = F.greatest(F.col(f"{win}_p75") - F.col(f"{win}_p25"), F.col(f"{lose}_p75") - F.col(f"{lose}_p25"), F.lit(1e-9))
    return wide.select("feature", f"{win}_median", f"{lose}_median", F.coalesce(F.abs(F.col(f"{win}_median") - F.col(f"{lose}_median")) / spread, F.lit(0.0)).alias("separation"))


def confusion(rows: DataFrame, passes: Column, group: str = "outcome") -> DataFrame:
    """(winners_caught, winners_missed, losers_passed, losers_blocked)."""
    p = F.coalesce(passes, F.lit(False))
    win, lose = F.col(group) == "winner", F.col(group) == "loser"
    return rows.agg(F.count_if(win & p).alias("winners_caught"), F.count_if(win & ~p).alias("winners_missed"), F.count_if(lose & p).alias("losers_passed"), F.count_if(lose & ~p).alias("losers_blocked"))


def threshold_pass(views: Column, meme: Column, min_views: float, min_meme: float) -> Column:
    """Views reach the floor and the score its minimum; rows without a score pass, as intended."""
    return F.coalesce(views >= min_views, F.lit(False)) & F.coalesce(meme >= min_meme, F.lit(True))


def score_bands(rows: DataFrame, score: str, coined: str, edges: list[float] | None = None) -> DataFrame:
    """(band, low, high, n, coined, rate) for every band, empty ones too."""
    edges = edges or BANDS
    spark = rows.sparkSession
    bands = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "band int, low double, high double")
    from ..functions.gates import score_band

    got = rows.select(score_band(F.col(score), edges).alias("band"), F.col(coined).alias("c")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("coined"))
    out = bands.join(got, "band", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "coined": F.coalesce("coined", F.lit(0))})
    return out.select("band", "low", "high", "n", "coined", F.try_divide("coined", F.nullif("n", F.lit(0))).alias("rate"))


def cumulative(rows: DataFrame, score: str, coined: str, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, n, coined, rate, share, delta): rows at or above each threshold.

    delta compares with the last threshold that has a rate. One pass: conditional counts, then a row a threshold.
    """
    marks = thresholds or THRESHOLDS
    hit = lambda t: F.col(score) >= t
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(hit(t)).alias(f"n{i}") for i, t in enumerate(marks)], *[F.count_if(hit(t) & F.col(coined)).alias(f"c{i}") for i, t in enumerate(marks)])
    table = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("coined")) for i, t in enumerate(marks)])
    out = one.select("total", F.explode(table).alias("x")).select("total", "x.*")
    out = out.withColumn("rate", F.try_divide("coined", F.nullif("n", F.lit(0)))).withColumn("share", F.try_divide("n", F.nullif("total", F.lit(0))))
    prior = F.last("rate", ignorenulls=True).over(Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1))  # a row a threshold
    return out.select("threshold", "n", "coined", "rate", "share", (F.col("rate") - prior).alias("delta"))


def elbow(rows: DataFrame, score: str, coined: str, candidates: list[float] | None = None, least: int = 15, above: float = 0.65, below: float = 0.05) -> DataFrame:
    """(threshold, above_rate, below_rate, ...) of the first candidate, in the order given, that separates well; or no row."""
    marks = candidates or CANDIDATES
    hit = lambda t: F.col(score) >= t
    counts = rows.agg(*[f(i, t) for i, t in enumerate(marks) for f in (
        lambda i, t: F.count_if(hit(t)).alias(f"an{i}"), lambda i, t: F.count_if(hit(t) & F.col(coined)).alias(f"ac{i}"),
        lambda i, t: F.count_if(~hit(t)).alias(f"bn{i}"), lambda i, t: F.count_if(~hit(t) & F.col(coined)).alias(f"bc{i}"))])
    table = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(t).alias("threshold"), F.col(f"an{i}").alias("above_n"), F.col(f"bn{i}").alias("below_n"), F.try_divide(f"ac{i}", f"an{i}").alias("above_rate"), F.try_divide(f"bc{i}", f"bn{i}").alias("below_rate")) for i, t in enumerate(marks)])
    ok = (F.col("above_n") >= least) & (F.col("below_n") >= least) & (F.col("above_rate") >= above) & (F.col("below_rate") <= below)
    return counts.select(F.explode(table).alias("x")).select("x.*").where(ok).orderBy("priority").limit(1).drop("priority")


def pass_fail(rows: DataFrame, score: str, coined: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Rates of passing and failing rows, and the lift between them."""
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
    out = rows.groupBy(*(by or [])).agg(F.count_if(hit).alias("passed"), F.count_if(hit & F.col(coined)).alias("passed_coined"), F.count_if(~hit).alias("failed"), F.count_if(~hit & F.col(coined)).alias("failed_coined"))
    out = out.withColumn("pass_rate", F.try_divide("passed_coined", F.nullif("passed", F.lit(0)))).withColumn("fail_rate", F.try_divide("failed_coined", F.nullif("failed", F.lit(0))))
    return out.withColumn("lift", F.try_divide("pass_rate", F.nullif("fail_rate", F.lit(0.0))))


def score_shift(rows: DataFrame, old: str, new: str, large: float = 0.2) -> DataFrame:
    """Means of old and new scores, and how many moved far."""
    return rows.agg(F.avg(old).alias("old_mean"), F.avg(new).alias("new_mean"), F.count_if(F.abs(F.col(new) - F.col(old)) >= large).alias("moved"), F.count(F.lit(1)).alias("n"))


def yes_rates(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, label, yes, usable, excluded, rate) of ternary labels."""
    from ..functions.values import ternary

    long = rows.unpivot(by, [F.col(c).cast("string").alias(c) for c in columns], "label", "value").withColumn("t", ternary(F.col("value")))
    out = long.groupBy(*by, "label").agg(F.count_if(F.col("t") == "yes").alias("yes"), F.count_if(F.col("t").isin("yes", "no")).alias("usable"), F.count_if(~F.col("t").isin("yes", "no")).alias("excluded"))
    return out.withColumn("rate", F.try_divide(F.col("yes") * 100.0, F.nullif("usable", F.lit(0))))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n), blanks named, most frequent first."""
    v = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return rows.groupBy(F.when(v == "", "(blank)").otherwise(v).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def group_stats(rows: DataFrame, by: list[str], multiple: str, mcap: str, ran: float = 5.0) -> DataFrame:
    """(by, n, median_peak, median_mcap, ran, ran_pct)."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.median(multiple).alias("median_peak"), F.median(mcap).alias("median_mcap"), F.count_if(F.col(multiple) >= ran).alias("ran"),
    ).withColumn("ran_pct", F.col("ran") * 100.0 / F.col("n"))


def reveal(rows: DataFrame, labels: list[str], ran: float = 5.0, fizzled: float = 2.0) -> DataFrame:
    """(section, grp, metric, value) of a blind study once its answers are joined.

    rows(peak_multiple, ath_mcap, viral, hours, media, <labels>): outcomes of all rows, groups with and without a viral origin,
    and for viral rows that ran or fizzled the yes-rate of each label, the median lead in hours, and the kinds of media.
    """
    from ..functions.gates import peak_class

    marked = rows.withColumn("outcome", peak_class(F.col("peak_multiple"), ran, fizzled))
    line = lambda section, grp, metric, value: [F.lit(section).alias("section"), grp.alias("grp"), metric.alias("metric"), value.cast("double").alias("value")]
    n = F.count(F.lit(1)).alias("n")
    outcomes = marked.groupBy("outcome").agg(n).select(*line("outcomes", F.col("outcome"), F.lit("n"), F.col("n")))
    groups = group_stats(marked.withColumn("grp", F.when(F.col("viral"), "viral").otherwise("other")), ["grp"], "peak_multiple", "ath_mcap", ran)
    groups = groups.unpivot(["grp"], [F.col(c).cast("double").alias(c) for c in ("n", "median_peak", "median_mcap", "ran_pct")], "metric", "value").select(*line("groups", F.col("grp"), F.col("metric"), F.col("value")))
    viral = marked.where("viral and outcome in ('ran', 'fizzled')")
    rates = yes_rates(viral, labels, ["outcome"]).select(*line("labels", F.col("outcome"), F.col("label"), F.col("rate")))
    hours = viral.groupBy("outcome").agg(F.median("hours").alias("m")).select(*line("timing", F.col("outcome"), F.lit("hours"), F.col("m")))
    media = viral.groupBy("outcome", "media").agg(n).select(*line("media", F.col("outcome"), F.col("media"), F.col("n")))
    return outcomes.union(groups).union(rates).union(hours).union(media)


def outcome_windows(rows: DataFrame, age_days: str, winner: Column, loser: Column, windows: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """(days, n, winners, losers) within each window, in one pass."""
    inside = lambda d: F.col(age_days) <= d
    one = rows.agg(*[f.alias(f"{n}{d}") for d in windows for n, f in (("n", F.count_if(inside(d))), ("w", F.count_if(inside(d) & winner)), ("l", F.count_if(inside(d) & loser)))])
    table = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"n{d}").alias("n"), F.col(f"w{d}").alias("winners"), F.col(f"l{d}").alias("losers")) for d in windows])
    return one.select(F.explode(table).alias("x")).select("x.*")


def share_by_wave(rows: DataFrame, wave: str, winner: Column) -> DataFrame:
    """(wave, n, winners, share, base, vs_base): each wave's share of winners against that of all."""
    per = rows.groupBy(wave).agg(F.count(F.lit(1)).alias("n"), F.count_if(winner).alias("winners"))
    base = per.agg((F.sum("winners") / F.sum("n")).alias("base"))
    out = per.crossJoin(F.broadcast(base)).withColumn("share", F.col("winners") / F.col("n"))  # one row
    return out.withColumn("vs_base", F.try_divide("share", F.nullif("base", F.lit(0.0))))


def seeded_order(key: str, seed: int) -> list[Column]:
    """Sort keys of a seeded shuffle: the MD5 of seed and key, then the key."""
    return [F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """n rows (of each group) in the order of a seeded hash of the key: the same on any partitioning."""
    order = seeded_order(key, seed)
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")


def case_control(rows: DataFrame, key: str, winner: Column, loser: Column, seed: int, n: int = 1000) -> DataFrame:
    """As many losers as winners, n of each at most, renumbered from 1 in another seeded order.

    A sampling operator: n bounds what it returns, and only n rows of a group leave each task.
    """
    marked = rows.withColumn("group", F.when(winner, "winner").when(loser, "loser")).where("group is not null")
    w = Window.partitionBy("group").orderBy(*seeded_order(key, seed))
    top = marked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    size = top.agg(F.least(F.count_if(F.col("group") == "winner"), F.count_if(F.col("group") == "loser")).alias("size"))
    picked = top.crossJoin(F.broadcast(size)).where("r <= size").drop("size", "r")  # one row
    return picked.withColumn("row_id", F.row_number().over(Window.orderBy(*seeded_order(key, seed + 1))))


def transitions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """(was, is, n) of two classifications."""
    return rows.groupBy(old.alias("was"), new.alias("now")).agg(F.count(F.lit(1)).alias("n"))


def best_match(hits: DataFrame, key: str, eligible: Column, least: float = 0.35) -> DataFrame:
    """One hit of each key: of eligible ones that with most views, else of those without a wrong address the surest."""
    ok = F.coalesce(eligible & (F.col("confidence") >= least) & ~F.col("wrong_address"), F.lit(False))
    w = Window.partitionBy(key).orderBy(F.col("ok").desc(), F.when(F.col("ok"), F.col("views")).desc_nulls_last(), F.col("confidence").desc(), F.col("views").desc(), "post_id")
    return hits.withColumn("ok", ok).where(F.col("ok") | ~F.col("wrong_address")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def cohort_until(rows: DataFrame, order: str, key: str, outcome: str, target: int, groups: tuple[str, str] = ("winner", "loser")) -> DataFrame:
    """The rows that a search in descending `order` goes through until both groups have `target` rows, with their rank and status.

    The row that fills the second group is the last one; rows of a full group that come before it stay. status is done if both
    groups are filled, else short, and then all rows are gone through. Where a group fills is its target-th rank, so nothing
    but two ranks is needed of the whole order. A search that goes on leaves out what it has seen by an anti join.
    """
    from .tiering import global_rank

    ranked = kept(global_rank(rows, order, key), "ranked")
    ends = [ranked.where(F.col(outcome) == g).orderBy("rank").limit(target).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")) for g in groups]
    one = ends[0].select(F.col("n").alias("n0"), F.col("last").alias("l0")).crossJoin(ends[1])  # one row
    full = (F.col("n0") >= target) & (F.col("n") >= target)
    stop = one.select(F.when(full, F.coalesce(F.greatest("l0", "last"), F.lit(0))).alias("_stop"), F.when(full, "done").otherwise("short").alias("status"))
    return ranked.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop"))).drop("_stop")  # one row
