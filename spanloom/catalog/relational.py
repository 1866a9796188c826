"""Plain relational shapes that users' own SQL has: sets, semi and anti joins, latest rows, null keys, rollups, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.catalog.base import query, r6
from spanloom.plans import testbed as t


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) AS sessions FROM g GROUP BY user_id)
SELECT CAST(sessions AS BIGINT) AS sessions, count(*) AS users FROM s GROUP BY 1""")
def resumed_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '1' DAY"), 0).otherwise(1)
    by = t.table(spark, sf_dir, "events").withColumn("new", new).groupBy("user_id").agg(F.sum("new").alias("sessions"))
    return by.groupBy("sessions").agg(F.count(F.lit(1)).alias("users"))


@query(
    "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1"
)
def json_props_since(spark, sf_dir):
    return t.table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy(F.get_json_object("props", "$.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds")
    )


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)"""
)
def set_operations(spark, sf_dir):
    a, b = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k")
    ).distinct(), t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", b.subtract(a)))


@query(
    """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'has urgent' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""
)
def semi_anti_join(spark, sf_dir):
    c, o = t.table(spark, sf_dir, "customer"), t.table(spark, sf_dir, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return c.join(o, on, "left_anti").select("c_custkey", "c_mktsegment").union(
        c.join(o.filter("o_orderpriority = '1-URGENT'"), on, "left_semi").select("c_custkey", F.lit("has urgent"))
    )


@query(
    """SELECT c_custkey, o.o_orderkey AS latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderdate = m) AS o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey) o ON o_custkey = c_custkey"""
)
def lateral_latest(spark, sf_dir):
    latest = t.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"))
    return t.table(spark, sf_dir, "customer").join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "latest")


@query(
    """WITH e AS (SELECT NULLIF(event_type, 'view') AS k, value FROM events), a AS (SELECT k, count(*) AS n FROM e GROUP BY k), b AS (SELECT k, max(value) AS top FROM e GROUP BY k) SELECT a.k, n, round(top, 6) AS top FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k"""
)
def nullsafe_join(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("k"), "value")
    a, b = e.groupBy("k").agg(F.count(F.lit(1)).alias("n")), e.groupBy(F.col("k").alias("k2")).agg(F.max("value").alias("top"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).select("k", "n", r6(F.col("top"), "top"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )
