"""Relational queries: joins, sets and maintenance of the reference's kind, then common ones beyond it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .registry import posts, query, scores, table


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unscored_anti(spark, sf_dir):
    """J3, J9."""
    return tables.without_known(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def scored_semi(spark, sf_dir):
    """J4, S8."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id", "left_semi")


@query("SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'ingested' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'near_miss' ELSE 'never_seen' END AS status FROM customer")
def coverage_three_way(spark, sf_dir):
    """J17."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return tables.coverage(c, o.where("o_orderstatus = 'O'"), o, "id").select("id", "status")


@query("WITH a AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_orderkey, coalesce(a.v, b.v) AS v FROM orders o LEFT JOIN a ON o.o_custkey = a.o_custkey AND o.o_orderpriority = a.o_orderpriority LEFT JOIN b ON o.o_custkey = b.o_custkey")
def fallback_join(spark, sf_dir):
    """J7, S5 in bulk."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    v = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("v"))
    return tables.with_fallback(o, v.where("o_orderstatus = 'F'"), v.where("o_orderstatus = 'P'"), ["o_custkey", "o_orderpriority"], "o_custkey", "v").select("o_orderkey", "v")


@query("SELECT s.s_suppkey, s.s_name, n.n_name AS place, c.m AS s_acctbal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN (SELECT c_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1) c ON c.c_nationkey = s.s_nationkey")
def override_join(spark, sf_dir):
    """The right side's columns take precedence."""
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("s_acctbal"))
    return tables.overridden(s.join(n, "k"), c, "k").select("s_suppkey", "s_name", "place", "s_acctbal")


@query("SELECT leg, count(*) AS n, round(sum(usd), 2) AS usd FROM (SELECT 'bought' AS leg, l_extendedprice AS usd FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'sold', l_extendedprice FROM lineitem WHERE l_returnflag = 'R') GROUP BY leg")
def union_legs(spark, sf_dir):
    """U1."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("usd"))
    legs = l.where("l_returnflag <> 'R'").select(F.lit("bought").alias("leg"), "usd").unionAll(l.where("l_returnflag = 'R'").select(F.lit("sold").alias("leg"), "usd"))
    return legs.groupBy("leg").agg(F.count(F.lit(1)).alias("n"), F.sum("usd").cast("double").alias("usd"))


@query("SELECT 'w' || (c_custkey % 3) AS source_wave, c_custkey AS source_row, 'w' || (c_custkey % 3) || ':' || c_custkey AS row_key FROM customer")
def stacked_waves(spark, sf_dir):
    """U2."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("w"))
    return tables.stacked_waves({f"w{i}": c.where(F.col("w") == i).drop("w") for i in range(3)}, "c_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_wins(spark, sf_dir):
    """U3, U6, B12."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return tables.first_wins(parts, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, min(o_orderdate) AS first_seen, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY o_custkey")
def upsert_latest(spark, sf_dir):
    """Orders before 1998 are the table, later ones the changes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("first_seen"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    old, new = o.where("first_seen < timestamp_ntz'1998-01-01'"), o.where("first_seen >= timestamp_ntz'1998-01-01'")
    return tables.upsert(old, new, ["o_custkey"], "v", ("first_seen",)).select("o_custkey", "first_seen", "price")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'BUILDING' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def replace_groups(spark, sf_dir):
    """S25."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return tables.replace_groups(c, c.where("c_mktsegment = 'BUILDING' and c_custkey % 2 = 0"), "c_mktsegment")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 12 HOUR")
def expire_rows(spark, sf_dir):
    """S24, P3, T3, T17."""
    return tables.expire(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 12).select("event_id")


@query("SELECT event_id, least(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END, epoch_ms(TIMESTAMP '2024-01-20')) AS ms FROM events")
def repair_stale(spark, sf_dir):
    """P19."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    e = e.withColumn("ms", F.when(F.col("event_id") % 3 == 0, F.floor(F.col("ms") / 1000)).otherwise(F.col("ms")))
    return tables.repaired(e, "ms", F.unix_millis(F.lit("2024-01-20 00:00:00").cast("timestamp")))


@query("WITH a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, coalesce(a.v, b.v) AS o_totalprice, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS source FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey")
def enrichment_cascade(spark, sf_dir):
    """B9, B10."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders")
    out = tables.cascade(c, [o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_totalprice") for s in ("P", "O")], "o_custkey", "o_totalprice")
    return out.withColumnRenamed("o_custkey", "c_custkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sort_order FROM orders")
def sort_order(spark, sf_dir):
    """W6."""
    return tables.sort_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "sort_order")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice IS NOT NULL AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 400000) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def filtered_top(spark, sf_dir):
    """Pushed-down filters and a top-k."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_totalprice").isNotNull() & ((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") >= 400_000)))
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT platform, lang_score, count(*) AS n FROM (SELECT platform, CASE WHEN meme_score IS NULL THEN 'none' WHEN meme_score >= 0.7 THEN 'high' ELSE 'low' END AS lang_score FROM posts LEFT JOIN scores USING (post_id)) GROUP BY ALL", "posts", "scores")
def pivoted_status(spark, sf_dir):
    """J2, A35."""
    p = posts(spark, sf_dir).select("post_id", "platform").join(scores(spark, sf_dir).select("post_id", "meme_score"), "post_id", "left")
    return p.groupBy("platform", F.when(F.col("meme_score").isNull(), "none").when(F.col("meme_score") >= 0.7, "high").otherwise("low").alias("lang_score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)")
def cube_rollup(spark, sf_dir):
    """Beyond the reference: grouping sets."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.cube("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_ops(spark, sf_dir):
    """Beyond the reference: INTERSECT and EXCEPT."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE, 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    """Beyond the reference: the star schema's pricing summary."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(money).cast("double"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
