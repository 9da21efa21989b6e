"""Queries that join facts: usage, changes, configuration, versions, coverage, intervals, scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S
from ..functions import versions as V
from ..operators import issues as I
from ..operators import relations as R
from ..session import table
from .catalog import query


@query("config_missing_unused", "SELECT o_custkey AS key, 'Missing' AS issue FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'Unused' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def config_missing_unused(spark, sf):
    return R.defined_and_used(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("change_detection", """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id + 50 AS doc_id, CASE WHEN (doc_id + 50) % 7 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def change_detection(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    shifted = d.select((F.col("doc_id") + 50).alias("doc_id"), F.when((F.col("doc_id") + 50) % 7 == 0, "x").otherwise(F.col("h")).alias("h"))
    return R.changes(d, shifted, "doc_id", "h")


@query("change_stats", """WITH a AS (SELECT doc_id, n_chars AS h FROM documents), b AS (SELECT doc_id + 50 AS doc_id, n_chars AS h FROM documents), s AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY status""")
def change_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("h"))
    c = R.changes(d, d.select((F.col("doc_id") + 50).alias("doc_id"), "h"), "doc_id", "h").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # at most four rows
    return c.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 6))


@query("dead_code", "SELECT p_partkey AS symbol, count(l_partkey) AS uses, CASE WHEN count(l_partkey) = 0 THEN 'dead' WHEN count(l_partkey) <= 2 THEN 'low' ELSE 'active' END AS status FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def dead_code(spark, sf):
    return R.usage(table(spark, sf, "part").select(F.col("p_partkey").alias("symbol")), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol")), "symbol")


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("set_operations", """SELECT 'both' AS side, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'either', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_operations(spark, sf):
    l = table(spark, sf, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == x).select("l_suppkey") for x in "RA")
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.union(b).distinct(), "either"))


@query("sanitizer_interval", """WITH s AS (SELECT user_id, epoch_us(ts)::BIGINT AS at, event_type AS k FROM events), x AS (SELECT a.user_id, a.at AS source_at, (SELECT min(b.at) FROM s b WHERE b.user_id = a.user_id AND b.k = 'error' AND b.at > a.at) AS sink_at FROM s a WHERE a.k = 'signup')
SELECT user_id, source_at, sink_at, EXISTS (SELECT 1 FROM s b WHERE b.user_id = x.user_id AND b.k = 'purchase' AND b.at > source_at AND b.at < sink_at) AS sanitized FROM x WHERE sink_at IS NOT NULL""")
def sanitizer_interval(spark, sf):
    """From each signup to the user's next error: was there a purchase between?"""
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    pick = lambda k: e.where(F.col("event_type") == k).select("user_id", "at")
    return R.between(pick("signup"), pick("purchase"), pick("error"), "user_id", "at")


@query("reaching_definitions", """WITH e AS (SELECT event_id, user_id, epoch_us(ts)::BIGINT AS at, event_type, value FROM events) SELECT a.event_id, (SELECT arg_max(b.event_id, (b.at, b.event_id)) FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.at < a.at) AS definition FROM e a WHERE a.event_type = 'error'
AND EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.at < a.at)""")
def reaching_definitions(spark, sf):
    """The latest purchase before each error of a user."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.struct("at", "event_id"))).over(w)["event_id"]
    return e.withColumn("definition", last).where("event_type = 'error' and definition is not null").select("event_id", "definition")


@query("live_roles_suffix", """SELECT conv_id, turn, count(DISTINCT role) AS live FROM (SELECT a.conv_id, a.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn) GROUP BY 1, 2""")
def live_roles_suffix(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.currentRow, W.unboundedFollowing)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.collect_set("role").over(w)).cast("long").alias("live"))


@query("coverage_rollup", """WITH p AS (SELECT r_name, n_name, c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS covered FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(r_name, '') AS namespace, coalesce(n_name, '') AS class, count(*) AS total, count_if(covered)::BIGINT AS covered, round(count_if(covered) * 100.0::DOUBLE / count(*), 6) AS percent,
    CASE WHEN count_if(covered) * 100.0 / count(*) >= 90 THEN 'A' WHEN count_if(covered) * 100.0 / count(*) >= 80 THEN 'B' WHEN count_if(covered) * 100.0 / count(*) >= 70 THEN 'C' WHEN count_if(covered) * 100.0 / count(*) >= 60 THEN 'D' ELSE 'F' END AS grade FROM p GROUP BY ROLLUP (r_name, n_name)""")
def coverage_rollup(spark, sf):
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    hit = o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("covered", F.lit(1))
    p = c.join(hit, "c_custkey", "left").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    g = p.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("total"), F.count("covered").alias("covered"))
    percent = F.col("covered") * 100.0 / F.col("total")
    return g.select(F.coalesce("r_name", F.lit("")).alias("namespace"), F.coalesce("n_name", F.lit("")).alias("class"), "total", "covered", F.round(percent, 6).alias("percent"), S.test_grade(percent).alias("grade"))


@query("merge_max_hits", "SELECT l_partkey AS line, max(l_quantity)::BIGINT AS hits, count(DISTINCT l_suppkey) AS modules FROM lineitem GROUP BY 1")
def merge_max_hits(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("line")).agg(F.max(F.col("l_quantity").cast("long")).alias("hits"), F.count_distinct("l_suppkey").alias("modules"))


VERSIONS = "v AS (SELECT p_partkey AS id, (p_size % 7) || '.' || (p_partkey % 11) || '.' || (p_partkey % 5) AS cur, (p_size % 7 + p_partkey % 3) || '.' || (p_partkey % 13) || '.4' AS latest FROM part)"


def _versions(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    dot = lambda *x: F.concat_ws(".", *x)
    return p.select(k.alias("id"), dot(F.col("p_size") % 7, k % 11, k % 5).alias("cur"), dot(F.col("p_size") % 7 + k % 3, k % 13, F.lit(4)).alias("latest"))


@query("versions_behind", f"""WITH {VERSIONS}, n AS (SELECT id, cur, latest, string_split(cur, '.')::INT[] AS a, string_split(latest, '.')::INT[] AS b FROM v), g AS (SELECT *, greatest(0, b[1] - a[1]) AS major, CASE WHEN a[1] = b[1] THEN greatest(0, b[2] - a[2]) ELSE 0 END AS minor, CASE WHEN a[1] = b[1] AND a[2] = b[2] THEN greatest(0, b[3] - a[3]) ELSE 0 END AS patch FROM n)
SELECT id, cur, latest, major, minor, patch, a < b AS outdated, CASE WHEN id % 50 = 0 THEN 'Critical' WHEN major >= 2 THEN 'High' WHEN major >= 1 OR minor >= 5 THEN 'Medium' ELSE 'Low' END AS urgency FROM g""")
def versions_behind(spark, sf):
    v = _versions(spark, sf).withColumn("g", V.behind(F.col("cur"), F.col("latest")))
    return v.select("id", "cur", "latest", "g.major", "g.minor", "g.patch", (V.parts(F.col("cur")) < V.parts(F.col("latest"))).alias("outdated"), V.urgency(F.col("id") % 50 == 0, F.col("g")).alias("urgency"))


@query("affected_versions", f"""WITH {VERSIONS}, a(adv, op, lo, hi) AS (VALUES ('A1', '<', [3, 0, 0, 0], NULL), ('A2', '<=', [2, 5, 1, 0], NULL), ('A3', '-', [1, 2, 0, 0], [4, 0, 0, 0]), ('A4', '[', [5, 0, 0, 0], NULL)), n AS (SELECT id, list_append(string_split(cur, '.')::INT[], 0) AS x FROM v)
SELECT adv AS advisory, count(*) AS packages FROM n JOIN a ON CASE op WHEN '<' THEN x < lo WHEN '<=' THEN x <= lo WHEN '-' THEN x >= lo AND x <= hi ELSE x >= lo END GROUP BY 1""")
def affected_versions(spark, sf):
    """Advisories are few and fixed; each is one condition over the packages, so nothing is joined."""
    ranges = {"A1": "< 3.0.0", "A2": "<= 2.5.1", "A3": "1.2.0 - 4.0.0", "A4": "[5.0.0, 6.0.0)"}
    hit = F.array_compact(F.array(*[F.when(V.affected(F.col("cur"), F.lit(r)), k) for k, r in ranges.items()]))
    return _versions(spark, sf).select(F.explode(hit).alias("advisory")).groupBy("advisory").agg(F.count(F.lit(1)).alias("packages"))


@query("vulnerability_risk", """WITH p AS (SELECT s_nationkey AS k, count_if(l_returnflag = 'R') // 500 AS c, count_if(l_returnflag = 'A') // 500 AS h, count_if(l_linestatus = 'O') // 500 AS m, count(*) // 5000 AS l FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), s AS (SELECT k, least(100, 25 * c + 15 * h + 8 * m + 2 * l)::BIGINT AS score FROM p)
SELECT k AS nation, score, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' WHEN score >= 1 THEN 'Low' ELSE 'None' END AS level FROM s""")
def vulnerability_risk(spark, sf):
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    n = lambda c, by: F.floor(F.count_if(c) / by)
    p = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(n(F.col("l_returnflag") == "R", 500).alias("c"), n(F.col("l_returnflag") == "A", 500).alias("h"), n(F.col("l_linestatus") == "O", 500).alias("m"), n(F.lit(True), 5000).alias("l"))
    score = S.dependency_risk(*map(F.col, "chml"))
    return p.select("nation", score.alias("score"), S.risk_level(score).alias("level"))


@query("prefix_mapping", """WITH k(key) AS (VALUES ('STANDARD'), ('STANDARD POLISHED'), ('PROMO'), ('SMALL'), ('ECONOMY')), m AS (SELECT p_type, max_by(key, length(key)) AS matched FROM (SELECT DISTINCT p_type FROM part) JOIN k ON starts_with(p_type, key) GROUP BY 1)
SELECT p_partkey, coalesce(matched, '') AS matched FROM part LEFT JOIN m USING (p_type)""")
def prefix_mapping(spark, sf):
    k = spark.createDataFrame([(x,) for x in ("STANDARD", "STANDARD POLISHED", "PROMO", "SMALL", "ECONOMY")], "key string")
    types = R.longest_prefix(table(spark, sf, "part").select("p_type").distinct(), k, "p_type", "key")
    return table(spark, sf, "part").join(types, "p_type", "left").select("p_partkey", F.coalesce("matched", F.lit("")).alias("matched"))


@query("member_changes", """WITH a AS (SELECT p_name AS m, min(p_type) AS k FROM part WHERE p_size <= 30 GROUP BY 1), b AS (SELECT p_name AS m, min(p_type) AS k FROM part WHERE p_size >= 20 GROUP BY 1)
SELECT coalesce(a.m, b.m) AS member, CASE WHEN a.m IS NULL THEN 'Added' WHEN b.m IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.m = b.m WHERE a.m IS NULL OR b.m IS NULL OR a.k <> b.k""")
def member_changes(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda c: p.where(c).groupBy(F.col("p_name").alias("member")).agg(F.min("p_type").alias("k"))
    return R.member_changes(pick("p_size <= 30"), pick("p_size >= 20"), "member", "k")


@query("unlocked_fields", """SELECT l_partkey AS field, count(DISTINCT l_suppkey) AS writers FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def unlocked_fields(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_suppkey").alias("method"), "l_returnflag")
    return R.unlocked_writes(l, l.where("l_returnflag = 'R'"), "field", "method")


@query("feature_envy", """WITH c AS (SELECT l_orderkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), o AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT l_orderkey, s_nationkey, n, coalesce((SELECT n FROM c d WHERE d.l_orderkey = c.l_orderkey AND d.s_nationkey = c_nationkey), 0) AS own FROM c JOIN o ON l_orderkey = o_orderkey WHERE s_nationkey <> c_nationkey)
SELECT l_orderkey AS method, arg_max(s_nationkey, (n, s_nationkey)) AS envied, max(n) AS uses, max(own) AS own FROM x GROUP BY 1 HAVING max(n) > 3 AND max(n) > 1.5 * max(own)""")
def feature_envy(spark, sf):
    """Orders that use one other nation's suppliers more than their own nation's."""
    l, s, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    n = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("method"), "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    home = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("method"), "c_nationkey")
    other = F.col("s_nationkey") != F.col("c_nationkey")
    x = n.join(home, "method").groupBy("method").agg(F.max_by(F.when(other, F.col("s_nationkey")), F.when(other, F.struct("n", "s_nationkey"))).alias("envied"), F.max(F.when(other, F.col("n"))).alias("uses"), F.coalesce(F.max(F.when(~other, F.col("n"))), F.lit(0)).alias("own"))
    return x.where((F.col("uses") > 3) & (F.col("uses") > 1.5 * F.col("own")))


@query("top_accessed_keys", "SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_accessed_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(20)


@query("duplicate_routes", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)::INT AS nth FROM orders QUALIFY nth > 1")
def duplicate_routes(spark, sf):
    w = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("nth")).where("nth > 1")


@query("priority_dedupe", "SELECT nation, kind FROM (SELECT n_nationkey AS nation, kind, row_number() OVER (PARTITION BY n_nationkey ORDER BY p) AS r FROM (SELECT n_nationkey, 'direct' AS kind, 0 AS p FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey, 'transitive', 1 FROM nation)) WHERE r = 1")
def priority_dedupe(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    direct = s.select(F.col("s_nationkey").alias("nation"), F.lit("direct").alias("kind"), F.lit(0).alias("p")).distinct()
    rows = direct.unionByName(n.select(F.col("n_nationkey").alias("nation"), F.lit("transitive").alias("kind"), F.lit(1).alias("p")))
    return R.best_of(rows, ["nation"], -F.col("p"), ["kind"])


@query("score_formulas", """SELECT l_orderkey, l_linenumber, (30 + 10 * greatest(floor((l_quantity - 30) / 10), 0) + 5 * greatest(l_linenumber - 10, 0))::DOUBLE AS long_method, greatest(120, 120 + 5 * (l_quantity - 15) + 3 * (l_linenumber - 10))::DOUBLE AS god_class,
    round(0.7::DOUBLE * least(l_linenumber / 25.0::DOUBLE, 1.0) * 100 + 0.3::DOUBLE * least(l_quantity / 100, 1.0) * 100, 6) AS impact, round(least(l_quantity / 480 * 100, 100.0::DOUBLE), 6) AS effort FROM lineitem""")
def score_formulas(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.long_method_minutes(q, n).cast("double").alias("long_method"), S.god_class_minutes(q, n).cast("double").alias("god_class"), F.round(S.impact_of(n, q), 6).alias("impact"), F.round(S.effort(q), 6).alias("effort"))


@query("change_risks", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 25 WHEN '2-HIGH' THEN 20 ELSE 5 END ELSE 0 END AS api, CASE WHEN o_orderstatus = 'F' THEN 15 ELSE least(25, 5 * (o_custkey % 7)) END::BIGINT AS critical,
    CASE WHEN o_totalprice % 100 >= 80 THEN 0.0 WHEN o_totalprice % 100 >= 60 THEN 5.0 WHEN o_totalprice % 100 >= 40 THEN 10.0 WHEN o_totalprice % 100 >= 20 THEN 18.0 ELSE 25.0 END::DOUBLE AS coverage FROM orders""")
def change_risks(spark, sf):
    change = S.choose(F.col("o_orderpriority"), {"1-URGENT": "Deletion", "2-HIGH": "Rename"}, "Other")
    return table(spark, sf, "orders").select("o_orderkey", S.api_risk(change, F.col("o_orderstatus") != "P").alias("api"), S.critical_risk(F.col("o_orderstatus") == "F", F.col("o_custkey") % 7).cast("long").alias("critical"), S.coverage_risk(F.col("o_totalprice") % 100).alias("coverage"))


@query("documentation_scores", """WITH p AS (SELECT source, count_if(quality = 1) * 100.0::DOUBLE / count(*) AS cov, count_if(toxic = 1) AS c, count_if(quality = 0) AS h FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1)
SELECT source, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 0.3::DOUBLE * (100 - cov) - 5 * c - 2 * h)), 6) AS documentation, round_even(greatest(0.0::DOUBLE, 100 - 10 * c - 5 * h), 1) AS api, greatest(0.0::DOUBLE, 1 - 0.05::DOUBLE * c - 0.1::DOUBLE * h) AS compatibility FROM p""")
def documentation_scores(spark, sf):
    r = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    p = r.groupBy("source").agg((F.count_if(F.col("quality") == 1) * 100.0 / F.count(F.lit(1))).alias("cov"), F.count_if(F.col("toxic") == 1).alias("c"), F.count_if(F.col("quality") == 0).alias("h"))
    z, c, h = F.lit(0), F.col("c"), F.col("h")
    return p.select("source", F.round(S.documentation_score(F.col("cov"), c, h, z, z, z), 6).alias("documentation"), S.api_score(c, h, z, z, z).alias("api"), S.compatibility(z, c, h).alias("compatibility"))
