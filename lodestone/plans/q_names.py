"""Queries over names, terms, routes, migrations, and debt against churn."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import graph as G
from ..operators.planning import migration_hours
from ..session import table
from .catalog import query
from .facts import COMMITS, DEBT, TRADE, commits, debt, trade


@query("debt_against_churn", f"""WITH {COMMITS}, {DEBT}, c AS (SELECT path, count(DISTINCT commit) AS changes FROM commits WHERE ts::DATE >= (SELECT max(ts)::DATE FROM commits) - 30 GROUP BY 1), d AS (SELECT path, sum(minutes)::BIGINT AS debt FROM debt GROUP BY 1)
SELECT path, changes, coalesce(debt, 0)::BIGINT AS debt, CASE WHEN changes >= 2 AND debt > 60 THEN 'worsening' WHEN changes >= 2 AND coalesce(debt, 0) < 30 THEN 'improving' ELSE 'steady' END AS trend FROM c LEFT JOIN d USING (path)""")
def debt_against_churn(spark, sf):
    c = commits(spark, sf)
    newest = F.broadcast(c.agg(F.date_sub(F.to_date(F.max("ts")), 30).alias("since")))  # one row
    n = c.join(newest, F.to_date("ts") >= F.col("since")).groupBy("path").agg(F.count_distinct("commit").alias("changes"))
    d = debt(spark, sf).groupBy("path").agg(F.sum("minutes").alias("debt"))
    amount = F.coalesce("debt", F.lit(0))
    trend_ = F.when((F.col("changes") >= 2) & (amount > 60), "worsening").when((F.col("changes") >= 2) & (amount < 30), "improving").otherwise("steady")
    return n.join(d, "path", "left").select("path", "changes", amount.alias("debt"), trend_.alias("trend"))


@query("preferred_terms", """WITH t AS (SELECT unnest(string_split(lower(p_type), ' ')) AS term FROM part), n AS (SELECT substr(term, 1, 1) AS concept, term, count(*) AS n FROM t GROUP BY 1, 2) SELECT concept, arg_max(term, (n, term)) AS preferred, sum(n)::BIGINT AS uses, count(*) AS variants FROM n GROUP BY concept""")
def preferred_terms(spark, sf):
    t = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    n = t.groupBy(F.substring("term", 1, 1).alias("concept"), "term").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("concept").agg(F.max_by("term", F.struct("n", "term")).alias("preferred"), F.sum("n").alias("uses"), F.count(F.lit(1)).alias("variants"))


SYNONYMS = [("get", "view"), ("view", "click"), ("purchase", "buy"), ("signup", "register"), ("error", "failure")]


@query("synonym_groups", "WITH u AS (SELECT event_type AS term, count(*) AS n FROM events GROUP BY 1), s(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + "), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s) SELECT a AS term, x.n AS uses, b AS synonym, y.n AS synonym_uses FROM e JOIN u x ON x.term = a JOIN u y ON y.term = b")
def synonym_groups(spark, sf):
    """Pairs of synonyms that are both in use; one step, as components would merge too much."""
    u = table(spark, sf, "events").groupBy(F.col("event_type").alias("term")).agg(F.count(F.lit(1)).alias("uses"))
    s = spark.createDataFrame([*SYNONYMS, *[(b, a) for a, b in SYNONYMS]], "term string, synonym string").distinct()
    return u.join(F.broadcast(s), "term").join(u.select(F.col("term").alias("synonym"), F.col("uses").alias("synonym_uses")), "synonym").select("term", "uses", "synonym", "synonym_uses")


@query("region_edges", f"""WITH {TRADE}, r AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.r_name AS source, b.r_name AS target, count(*) AS edges FROM edges JOIN r a ON a.n_name = source JOIN r b ON b.n_name = target GROUP BY 1, 2""")
def region_edges(spark, sf):
    """Edges between modules lifted to the level above."""
    r = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    e = G.simple(trade(spark, sf))
    a, b = r.select(F.col("n_name").alias("source"), F.col("r_name").alias("from")), r.select(F.col("n_name").alias("target"), F.col("r_name").alias("to"))
    return e.join(a, "source").join(b, "target").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("edges"))


@query("migration_effort", """SELECT l_returnflag AS target, round((sum(l_quantity) + sum(CASE WHEN l_linestatus = 'O' THEN 8 ELSE 0 END)) * (1.15::DOUBLE + 0.1::DOUBLE * count_if(l_linenumber >= 7)), 4) AS hours, count(*) AS steps FROM lineitem GROUP BY 1""")
def migration_effort(spark, sf):
    hours = migration_hours(F.sum("l_quantity"), F.sum(F.when(F.col("l_linestatus") == "O", 8).otherwise(0)), F.count_if(F.col("l_linenumber") >= 7))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("target")).agg(F.round(hours, 4).alias("hours"), F.count(F.lit(1)).alias("steps"))


@query("routes", r"""WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT regexp_replace(path, '[0-9]+', '{id}', 'g') AS route, count(*) AS n, len(regexp_extract_all(regexp_replace(path, '[0-9]+', '{id}', 'g'), '\{[a-z]+'))::INT AS parameters FROM r GROUP BY 1, 3""")
def routes(spark, sf):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    r = table(spark, sf, "pages").select(F.regexp_replace(path, "[0-9]+", "{id}").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("parameters", F.regexp_count("route", F.lit(r"\{[a-z]+")))


@query("responsibilities", """SELECT event_type AS name, count(*) AS n, CASE WHEN starts_with(event_type, 'view') THEN 'Reading' WHEN starts_with(event_type, 'click') THEN 'Interaction' WHEN starts_with(event_type, 'purchase') OR starts_with(event_type, 'signup') THEN 'Writing' ELSE 'Other' END AS responsibility FROM events GROUP BY 1""")
def responsibilities(spark, sf):
    name = F.col("name")
    kind = F.when(name.startswith("view"), "Reading").when(name.startswith("click"), "Interaction").when(name.startswith("purchase") | name.startswith("signup"), "Writing").otherwise("Other")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("responsibility", kind)


@query("running_totals", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders""")
def running_totals(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("total"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("recent"))


@query("union_of_findings", """SELECT 'orders' AS source, o_orderkey::BIGINT AS id FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 'events', event_id FROM events WHERE value < 1 UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_acctbal < 0""")
def union_of_findings(spark, sf):
    o, e, c = table(spark, sf, "orders"), table(spark, sf, "events"), table(spark, sf, "customer")
    parts = [o.where("o_totalprice < 2000").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id")), e.where("value < 1").select(F.lit("events").alias("source"), F.col("event_id").alias("id")), c.where("c_acctbal < 0").select(F.lit("customers").alias("source"), F.col("c_custkey").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
