"""Fact tables out of the driver's tables, as DataFrames and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..operators.issues import rank
from ..session import table


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Events as issues: type is category, user is file."""
    e = table(spark, sf, "events")
    severity = F.when(F.col("event_type") == "signup", "Critical").when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "Warning").otherwise("Note")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("R"), F.col("event_id") % 20).alias("rule_id"),
        severity.alias("severity"),
        rank(severity).alias("sev_rank"),
        F.concat(F.lit("file"), "user_id").alias("path"),
        (F.col("event_id") % 500).cast("int").alias("line"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.concat(F.lit("CWE-"), F.col("event_id") % 7)).alias("cwe"),
        F.concat(F.lit("issue "), "event_type").alias("message"),
        "ts",
        "value",
    )


ISSUES = """issues AS (SELECT event_id AS id, event_type AS category, 'R' || (event_id % 20) AS rule_id,
    CASE event_type WHEN 'signup' THEN 'Critical' WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' ELSE 'Note' END AS severity,
    CASE event_type WHEN 'signup' THEN 4 WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS sev_rank,
    'file' || user_id AS path, (event_id % 500)::INT AS line, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'CWE-' || (event_id % 7) END AS cwe,
    'issue ' || event_type AS message, ts, value FROM events)"""


def debt(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as debt items: priority is severity, quantity is impact, price is effort."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "High").when(p == "3-MEDIUM", "Medium").otherwise("Low")
    category = F.when(F.col("l_returnflag") == "R", "Security").when(F.col("l_returnflag") == "A", "GodClass").otherwise("LongMethod")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        category.alias("category"),
        severity.alias("severity"),
        F.concat(F.lit("part"), "l_partkey").alias("path"),
        (F.col("l_quantity") * 12).cast("int").alias("minutes"),
        (F.col("l_discount") * 120).cast("int").alias("interest"),
        (F.col("l_quantity") * 2).alias("impact"),
        (F.col("l_extendedprice") / 1000).alias("effort"),
        F.col("l_linenumber").alias("frequency"),
    )


DEBT = """debt AS (SELECT l_orderkey || '-' || l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'Security' WHEN 'A' THEN 'GodClass' ELSE 'LongMethod' END AS category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity,
    'part' || l_partkey AS path, trunc(l_quantity * 12)::INT AS minutes, trunc(l_discount * 120)::INT AS interest, l_quantity * 2 AS impact, l_extendedprice / 1000 AS effort, l_linenumber AS frequency
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as changed files of commits: order is commit, part is file, customer is author."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("part"), "l_partkey").alias("path"), F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


COMMITS = """commits AS (SELECT 'part' || l_partkey AS path, o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts, trunc(l_quantity)::BIGINT AS added, l_linenumber::BIGINT AS deleted
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def trade(spark: SparkSession, sf: str, over: float = 1.5) -> DataFrame:
    """Nations as modules: each one's customers depend on all nations whose suppliers deliver more to them than chance would.

    More than chance: above the count that both nations' totals let expect, by ``over`` times its square root.
    """
    o, l, c, s, na = (table(spark, sf, t) for t in ("orders", "lineitem", "customer", "supplier", "nation"))
    pairs = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    buys, sells = (pairs.groupBy(k).agg(F.sum("n").cast("double").alias(a)) for k, a in (("c_nationkey", "buys"), ("s_nationkey", "sells")))
    total = pairs.agg(F.sum("n").cast("double").alias("all"))  # one row
    expected = F.col("buys") * F.col("sells") / F.col("all")
    much = pairs.join(buys, "c_nationkey").join(sells, "s_nationkey").join(F.broadcast(total), F.col("n") > expected + over * F.sqrt(expected))
    a, b = na.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source")), na.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    return much.join(a, "c_nationkey").join(b, "s_nationkey").select("source", "target", "n")


TRADE = """pairs AS (SELECT c_nationkey, s_nationkey, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
expected AS (SELECT *, (sum(n) OVER (PARTITION BY c_nationkey))::DOUBLE * (sum(n) OVER (PARTITION BY s_nationkey))::DOUBLE / (sum(n) OVER ())::DOUBLE AS x FROM pairs),
trade AS (SELECT a.n_name AS source, b.n_name AS target, n FROM expected JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE n > x + 1.5::DOUBLE * sqrt(x)),
edges AS (SELECT DISTINCT source, target FROM trade WHERE source <> target)"""


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Region to nation to customer and supplier."""
    r, n, c, s = (table(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))
    a = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    b = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("source"), F.col("c_name").alias("target"))
    d = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("source"), F.col("s_name").alias("target"))
    return a.unionByName(b).unionByName(d)


HIERARCHY = """edges AS (SELECT r_name AS source, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
