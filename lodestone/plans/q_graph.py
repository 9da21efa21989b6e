"""Queries over dependency graphs: closures, depths, paths, cycles, coupling, impact."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S
from ..operators import graph as G
from ..operators import relations as R
from ..session import table
from .catalog import query
from .facts import HIERARCHY, TRADE, hierarchy, trade

REACH = f"{TRADE}, r AS (SELECT DISTINCT source AS root, target AS node, 1 AS depth FROM edges UNION SELECT r.root, e.target, r.depth + 1 FROM r JOIN edges e ON r.node = e.source WHERE depth < (SELECT count(*) FROM nation)), d AS (SELECT root, node, min(depth) AS depth FROM r WHERE root <> node GROUP BY 1, 2)"


@query("transitive_closure", f"WITH RECURSIVE {REACH} SELECT root, node, depth::INT AS depth FROM d")
def transitive_closure(spark, sf):
    e = trade(spark, sf)
    return G.reach(e, G.nodes(e).select(F.col("node").alias("root"))).where("depth > 0").select("root", "node", "depth")


@query("transitive_callers", f"WITH RECURSIVE {REACH} SELECT node AS target, root AS caller, depth::INT AS depth FROM d WHERE depth <= 2")
def transitive_callers(spark, sf):
    e = G.reversed_(trade(spark, sf))
    return G.reach(e, G.nodes(e).select(F.col("node").alias("root")), 2).where("depth > 0").select(F.col("root").alias("target"), F.col("node").alias("caller"), "depth")


@query("entry_points_leaves", f"WITH {HIERARCHY} SELECT DISTINCT source AS node, 'entry' AS role FROM edges WHERE source NOT IN (SELECT target FROM edges) UNION ALL SELECT DISTINCT target, 'leaf' FROM edges WHERE target NOT IN (SELECT source FROM edges)")
def entry_points_leaves(spark, sf):
    return G.ends(hierarchy(spark, sf))


@query("node_depths", f"WITH {HIERARCHY} SELECT source AS node, 0 AS depth FROM edges WHERE source NOT IN (SELECT target FROM edges) UNION SELECT target, CASE WHEN source IN (SELECT target FROM edges) THEN 2 ELSE 1 END FROM edges")
def node_depths(spark, sf):
    return G.depths(hierarchy(spark, sf))


@query("shortest_paths", f"""WITH RECURSIVE {TRADE}, r AS (SELECT min(source) AS node, 0 AS depth FROM edges UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON r.node = e.source WHERE depth < (SELECT count(*) FROM nation))
SELECT node, (min(depth) + 1)::INT AS nodes FROM r WHERE node IS NOT NULL GROUP BY node HAVING min(depth) > 0""")
def shortest_paths(spark, sf):
    e = G.cut(G.simple(trade(spark, sf)))
    return G.reach(e, e.agg(F.min("source").alias("root")).where("root is not null")).where("depth > 0").select("node", (F.col("depth") + 1).alias("nodes"))


@query("all_paths", f"""WITH RECURSIVE {TRADE}, ends AS (SELECT min(source) AS a, max(target) AS b FROM edges), p AS (SELECT source, target, [source, target] AS path FROM edges, ends WHERE source = a UNION ALL SELECT p.source, e.target, list_append(path, e.target) FROM p JOIN edges e ON p.target = e.source, ends WHERE len(path) < 11 AND p.target <> b AND NOT list_contains(path, e.target))
SELECT array_to_string(path, '>') AS path FROM p, ends WHERE target = b""")
def all_paths(spark, sf):
    e = G.cut(trade(spark, sf))
    a, b = e.where("source != target").agg(F.min("source"), F.max("target")).first()
    return G.paths(e, a, b).select(F.array_join("path", ">").alias("path"))


@query("cycles", f"""WITH RECURSIVE {TRADE}, p AS (SELECT source AS first, target AS last, [source, target] AS path FROM edges WHERE source < target UNION ALL SELECT first, e.target, list_append(path, e.target) FROM p JOIN edges e ON p.last = e.source WHERE e.target > first AND NOT list_contains(path, e.target) AND len(path) < 10)
SELECT DISTINCT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM p JOIN edges e ON e.source = p.last AND e.target = p.first ORDER BY length, cycle LIMIT 50""")
def cycles(spark, sf):
    return G.cycles(trade(spark, sf))


@query("circular_pairs", """WITH t AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), p AS (SELECT DISTINCT user_id, a, b FROM t WHERE b IS NOT NULL AND a <> b) SELECT user_id, a, b FROM p WHERE (user_id, b, a) IN (SELECT user_id, a, b FROM p)""")
def circular_pairs(spark, sf):
    t = table(spark, sf, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null")
    return R.reciprocal(t, "a", "b", ["user_id"])


@query("coupling_metrics", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem), ce AS (SELECT source AS node, count(*) AS ce FROM e GROUP BY 1), ca AS (SELECT target AS node, count(*) AS ca FROM e GROUP BY 1)
SELECT coalesce(ce.node, ca.node) AS node, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(ca, 0))::DOUBLE AS instability FROM ce FULL JOIN ca ON ce.node = ca.node""")
def coupling_metrics(spark, sf):
    l = table(spark, sf, "lineitem")
    return R.coupling(l.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")))


@query("graph_degrees", f"WITH {TRADE} SELECT n_name AS node, (SELECT count(*) FROM edges WHERE source = n_name) AS out_degree, (SELECT count(*) FROM edges WHERE target = n_name) AS in_degree FROM nation WHERE n_name IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def graph_degrees(spark, sf):
    return G.degrees(trade(spark, sf))


@query("graph_stats", f"WITH {HIERARCHY}, o AS (SELECT source, count(*) AS d FROM edges GROUP BY 1), i AS (SELECT target, count(*) AS d FROM edges GROUP BY 1) SELECT (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT max(d) FROM o) AS max_out, (SELECT max(d) FROM i) AS max_in, (SELECT arg_max(source, (d, source)) FROM o) AS widest")
def graph_stats(spark, sf):
    d = G.degrees(hierarchy(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), F.max_by("node", F.struct("out_degree", "node")).alias("widest"))


@query("graph_hotspots", "SELECT l_partkey AS target, count(DISTINCT l_suppkey) AS dependents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def graph_hotspots(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.count_distinct("l_suppkey").alias("dependents")).orderBy(F.desc("dependents"), "target").limit(10)


@query("direct_impact", f"WITH {HIERARCHY} SELECT target, count(*) AS dependents, string_agg(source, ',' ORDER BY source) AS who FROM edges WHERE target IN (SELECT n_name FROM nation) GROUP BY 1")
def direct_impact(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("target"))
    e = G.simple(hierarchy(spark, sf)).join(n, "target", "left_semi")
    return e.groupBy("target").agg(F.count(F.lit(1)).alias("dependents"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("who"))


@query("impact_risk", f"""WITH RECURSIVE {REACH}, c AS (SELECT node, count(*) FILTER (depth = 1) AS near, count(*) AS far FROM (SELECT node AS root, root AS node, depth FROM d) x GROUP BY node)
SELECT node, near, far, least(25, CASE WHEN near <= 0 THEN 0 WHEN near <= 5 THEN 5 WHEN near <= 10 THEN 10 WHEN near <= 20 THEN 15 ELSE 20 END + CASE WHEN far <= 0 THEN 0 WHEN far <= 10 THEN 1 WHEN far <= 50 THEN 3 WHEN far <= 100 THEN 4 ELSE 5 END)::INT AS risk FROM c""")
def impact_risk(spark, sf):
    r = transitive_closure(spark, sf)
    c = r.groupBy(F.col("root").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("near"), F.count(F.lit(1)).alias("far"))
    return c.withColumn("risk", S.impact_risk(F.col("near"), F.col("far")))


@query("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT least(a.doc_id, b.doc_id) AS x, greatest(a.doc_id, b.doc_id) AS y FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id) SELECT y AS node, min(x) AS component FROM e GROUP BY y UNION SELECT x, min(x) FROM e WHERE x NOT IN (SELECT y FROM e) GROUP BY x""")
def connected_components(spark, sf):
    """Components of exact copies, linked as a chain of neighbours in each group."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    d = d.where("h is not null")  # null texts are no copies of each other
    e = d.select(F.col("doc_id").alias("source"), F.lead("doc_id").over(W.partitionBy("h").orderBy("doc_id")).alias("target")).where("target is not null")
    return G.components(e)


@query("combined_impact", f"""WITH {TRADE}, h AS (SELECT target AS symbol, count(DISTINCT source) AS changes, max(n)::DOUBLE AS top FROM trade WHERE source <> target GROUP BY 1) SELECT symbol, changes, round(least(100.0::DOUBLE, top / 10 * (1 + 0.1::DOUBLE * (changes - 1))), 6) AS risk FROM h WHERE changes > 1""")
def combined_impact(spark, sf):
    h = trade(spark, sf).where("source != target").groupBy(F.col("target").alias("symbol")).agg(F.count_distinct("source").alias("changes"), F.max("n").cast("double").alias("top"))
    return h.where("changes > 1").select("symbol", "changes", F.round(S.combined_risk(F.col("top") / 10, F.col("changes")), 6).alias("risk"))


@query("dot_edges", f"WITH {TRADE} SELECT '\"' || source || '\" -> \"' || target || '\";' AS text FROM edges")
def dot_edges(spark, sf):
    from ..sinks.reports import dot_lines

    return dot_lines(G.simple(trade(spark, sf)))


@query("inheritance_depth", """WITH RECURSIVE b AS (SELECT DISTINCT p_type AS t, p_type AS name, 1 AS depth FROM part UNION ALL SELECT t, regexp_replace(name, ' [^ ]+$', ''), depth + 1 FROM b WHERE contains(name, ' ')) SELECT t AS type, max(depth)::INT AS depth FROM b GROUP BY t""")
def inheritance_depth(spark, sf):
    """Part types as names whose base is the name without its last word."""
    t = table(spark, sf, "part").select(F.col("p_type").alias("type")).distinct()
    return t.withColumn("depth", F.size(F.split("type", " ")))
