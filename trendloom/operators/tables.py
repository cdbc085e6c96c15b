"""Table maintenance and relational patterns: upserts, deletes, unions, anti and semi joins, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str, keep_first: tuple[str, ...] = (), locked: Column | None = None) -> DataFrame:
    """target after an upsert by keys: the newest version wins, columns in keep_first stay those of the oldest row.

    Rows of target for which `locked` holds take no changes. changes may repeat a key. The result is the new table, for the
    caller to write.
    """
    w = Window.partitionBy(*keys)
    old = target.withColumn("_new", F.lit(False)).withColumn("_lock", F.coalesce(locked, F.lit(False)) if locked is not None else F.lit(False))
    both = old.unionByName(changes.withColumn("_new", F.lit(True)).withColumn("_lock", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_locked", F.max("_lock").over(w)).where(~F.col("_locked") | ~F.col("_new"))
    newest, oldest = w.orderBy(F.col("_new").desc(), F.col(version).desc()), w.orderBy(F.col("_new").asc(), F.col(version).asc())
    for c in keep_first:
        both = both.withColumn(c, F.first(c, ignorenulls=True).over(oldest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(*target.columns)


def replace_groups(target: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """target with all rows of the groups in fresh replaced by them."""
    return target.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh)


def write_groups(fresh: DataFrame, path: str, group: str) -> None:
    """Write groups into a table partitioned by them: each one in fresh replaces its old rows, no other is touched.

    Written again, the same rows change nothing. Groups are folders, so they are to be few and large: days, platforms, segments.
    """
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def expire(rows: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    """Rows younger than their time to live."""
    return rows.where(F.col(ts).cast("timestamp") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def cached(requests: DataFrame, cache: DataFrame, key: str, now: Column, ttl_s: int, stale_s: int) -> DataFrame:
    """requests with value, state and refresh from cache(key, value, fetched_at).

    state is fresh within the time to live, stale for stale_s more, in which the old value is still served while a new one is
    fetched, else missing, without a value. refresh says which keys to fetch. Of a key's entries the newest counts.
    """
    last = cache.groupBy(key).agg(F.max(F.struct(F.col("fetched_at").cast("timestamp").alias("at"), "value")).alias("_c"))
    age = F.unix_micros(now) - F.unix_micros(F.col("_c.at"))
    state = F.when(age <= ttl_s * 1_000_000, "fresh").when(age <= (ttl_s + stale_s) * 1_000_000, "stale").otherwise("missing")
    out = requests.join(last, key, "left").withColumn("state", state).withColumn("value", F.when(F.col("state") != "missing", F.col("_c.value")))
    return out.withColumn("refresh", F.col("state") != "fresh").drop("_c")


def maybe_single(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key, or none; two rows of a key are an error (S5). For many keys at once, join."""
    found = rows.where(F.col(key) == value).limit(2)
    few = found.agg(F.assert_true(F.count(F.lit(1)) < 2, F.lit(f"more than one row with this {key}")).alias("_ok"))
    return found.join(F.broadcast(few), F.col("_ok").isNull()).drop("_ok")  # one row


def without_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def first_wins(parts: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of tables, one row a key: of the earliest table, then by order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_src", *order)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_src")


def stacked_waves(waves: dict[str, DataFrame], key: str) -> DataFrame:
    """Waves tagged and stacked, rows renumbered by wave and old number."""
    out = None
    for name, rows in waves.items():
        rows = rows.withColumn("source_wave", F.lit(name)).withColumnRenamed(key, "source_row")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("row_key", F.concat_ws(":", "source_wave", F.col("source_row").cast("string")))


def embed_children(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """parents with their children as an ordered array of structs; none is an empty array."""
    rest = [c for c in children.columns if c != key]
    row = F.struct(*order, *[c for c in rest if c not in order])
    kids = children.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias(name))
    kind = dict(kids.dtypes)[name]
    return parents.join(kids, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def coverage(targets: DataFrame, posts: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """targets with status: ingested, near_miss or never_seen."""
    a, b = posts.select(key).distinct().withColumn("_p", F.lit(True)), near.select(key).distinct().withColumn("_n", F.lit(True))
    out = targets.join(a, key, "left").join(b, key, "left")
    return out.withColumn("status", F.when(F.col("_p"), "ingested").when(F.col("_n"), "near_miss").otherwise("never_seen")).drop("_p", "_n")


def cascade(rows: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """rows with the value of the first source that has one, and that source's number."""
    found = []
    for i, s in enumerate(sources):
        per = s.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias(f"_v{i}"))
        rows = rows.join(per, key, "left")
        found.append(F.col(f"_v{i}"))
    which = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(found)])
    return rows.withColumn(value, F.coalesce(*found)).withColumn("source", which).drop(*[f"_v{i}" for i in range(len(sources))])


def with_fallback(rows: DataFrame, exact: DataFrame, loose: DataFrame, keys: list[str], loose_key: str, value: str) -> DataFrame:
    """rows with a value by all keys, else by one of them alone."""
    a = exact.groupBy(*keys).agg(F.max(value).alias("_a"))
    b = loose.groupBy(loose_key).agg(F.max(value).alias("_b"))
    return rows.join(a, keys, "left").join(b, loose_key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def overridden(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by key in which right's columns take precedence."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    return left.drop(*shared).join(right, key)


def embed_parent(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the row of parents that their key names as a struct, null if there is none (J15). Keys of parents are unique."""
    one = parents.select(key, F.struct(*[c for c in parents.columns if c != key]).alias(name))
    return rows.join(one, key, "left")


def sort_order(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with sort_order from 0 within each group."""
    return rows.withColumn("sort_order", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; only k rows of a group leave each task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def round_robin(items: DataFrame, key: str, cycle: int, size: int) -> DataFrame:
    """The batch of `size` items that is due in a cycle, wrapping around (K18). Items are numbered in order of key, range by range."""
    from .tiering import global_rank

    n = items.agg(F.count(F.lit(1)).alias("n"))
    numbered = global_rank(items.withColumn("_zero", F.lit(0.0)), "_zero", key, "i").crossJoin(F.broadcast(n))  # one row
    return numbered.where(F.pmod(F.col("i") - 1 - F.lit(cycle * size), F.col("n")) < size).drop("i", "n", "_zero")


def repaired(rows: DataFrame, ts_ms: str, now_ms: Column) -> DataFrame:
    """Seconds made milliseconds, times in the future set to now."""
    fixed = F.when(F.col(ts_ms) < 10**12, F.col(ts_ms) * 1000).otherwise(F.col(ts_ms))
    return rows.withColumn(ts_ms, F.least(fixed, now_ms))


def dominant_phrases(docs: DataFrame, by: list[str], words: Column, key: str) -> DataFrame:
    """(by, phrase, n): each group's most frequent word pair; ties go to the pair seen first by document and position.

    key is a whole number. It and the position are one decimal, whose minimum a hash aggregate can hold; a struct's would sort all pairs.
    Words are a column of their own, as bigrams names them several times and a generator would work them out as often.
    """
    from ..functions.text import bigrams

    pairs = docs.select(*by, key, words.alias("_words")).select(*by, key, F.posexplode(bigrams(F.col("_words"))).alias("pos", "phrase"))
    place = F.col(key).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    n = pairs.groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return top_k(n, by, [F.col("n").desc(), F.col("first").asc()], 1).select(*by, "phrase", "n")


def trend_batch(terms: DataFrame, cache: DataFrame, term: str, now: Column, ttl_min: int = 45, cap: int = 20) -> DataFrame:
    """The first `cap` terms by their group's most views that have no fresh cached result (T15, K14; cap is the daily budget)."""
    fresh = cache.where(F.col("fetched_at").cast("timestamp") >= now - F.expr(f"INTERVAL {ttl_min} MINUTES"))
    want = terms.groupBy(term).agg(F.max("views").alias("views"), F.count(F.lit(1)).alias("n"))
    return want.join(fresh.select(term).distinct(), term, "left_anti").orderBy(F.col("views").desc(), term).limit(cap)
