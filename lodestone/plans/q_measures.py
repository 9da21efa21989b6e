"""Queries over measures, change impact beyond closures, clone candidates, reports and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones as C
from ..operators import impact as I
from ..operators import measures as M
from ..sinks import reports as R
from ..sources import readers as S
from ..session import table
from .catalog import query
from .facts import TRADE, issues, ISSUES, trade

# Kinds that an order line may be, by its part.
KINDS = ["If", "While", "For", "Foreach", "Case", "Catch", "Conditional", "And", "Or", "Coalesce", "Do", "PatternLabel", "SwitchArm", "ConditionalAccess", "Else", "Switch", "Block", "Class", "Method", "Property", "Field"]


def nodes(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.concat(F.lit("file"), "l_suppkey").alias("path"), F.concat(F.lit("C"), F.col("l_partkey") % 5).alias("class"), F.concat(F.lit("M"), F.col("l_orderkey") % 9).alias("method"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % len(KINDS) + 1).cast("int")).alias("kind"), (F.col("l_linenumber") - 1).alias("depth"))


def _in(kinds):
    return ", ".join(f"'{k}'" for k in kinds)


NODES = f"n AS (SELECT 'file' || l_suppkey AS path, 'C' || (l_partkey % 5) AS class, 'M' || (l_orderkey % 9) AS method, [{_in(KINDS)}][(l_partkey % {len(KINDS)} + 1)::INT] AS kind, l_linenumber - 1 AS depth FROM lineitem)"
EDGES = "e AS (SELECT source, target, CASE n % 4 WHEN 0 THEN 'TypeUsage' WHEN 1 THEN 'Inheritance' WHEN 2 THEN 'Override' ELSE 'DirectCall' END AS type, 'file' || (n % 7) AS path FROM trade WHERE source <> target)"


def edges(spark, sf):
    t = trade(spark, sf).where("source != target")
    kind = F.element_at(F.array(*map(F.lit, ("TypeUsage", "Inheritance", "Override", "DirectCall"))), (F.col("n") % 4 + 1).cast("int"))
    return t.select("source", "target", kind.alias("type"), F.concat(F.lit("file"), F.col("n") % 7).alias("path"))


@query("complexities", f"""WITH {NODES} SELECT path, class, method, count(*) FILTER (kind IN ({_in(M.BASIC)})) + 1 AS basic, count(*) FILTER (kind IN ({_in(M.WIDE)})) + 1 AS wide, count(*) FILTER (kind IN ({_in(M.COARSE)})) + 1 AS coarse, count(*) FILTER (kind IN ({_in(M.TOKENS)})) + 1 AS tokens,
sum(CASE WHEN kind IN ({_in(M.BRANCHES)}) THEN depth + 1 WHEN kind = 'Else' THEN 1 ELSE 0 END)::BIGINT AS cognitive, coalesce(max(CASE WHEN kind IN ('Block', {_in(M.BRANCHES)}) THEN depth + 1 END), 0) AS nesting FROM n GROUP BY 1, 2, 3""")
def complexities(spark, sf):
    return M.complexities(nodes(spark, sf))


@query("file_counts", f"WITH {NODES} SELECT path, count(*) FILTER (kind = 'Class') AS classes, count(*) FILTER (kind = 'Method') AS methods, count(*) FILTER (kind = 'Property') AS properties, count(*) FILTER (kind = 'Field') AS fields FROM n GROUP BY 1")
def file_counts(spark, sf):
    return M.file_counts(nodes(spark, sf))


@query("project_totals", f"WITH {NODES}, {ISSUES}, c AS (SELECT count(*) FILTER (kind IN ({_in(M.BASIC)})) + 1 AS complexity FROM n GROUP BY path, class, method) SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg(complexity), 6) FROM c) AS mean, (SELECT max(complexity) FROM c) AS greatest, (SELECT count(*) FROM c WHERE complexity > 10) AS many, (SELECT count(DISTINCT path) FROM n) AS files, (SELECT count(*) FROM issues) AS issues")
def project_totals(spark, sf):
    n = nodes(spark, sf)
    stats = M.method_stats(M.complexities(n).withColumnRenamed("basic", "complexity")).withColumn("mean", F.round("mean", 6))
    return M.totals(stats, n.agg(F.count_distinct("path").alias("files")), issues(spark, sf).agg(F.count(F.lit(1)).alias("issues")))


@query("top_methods", f"WITH {NODES} SELECT path, method, count(*) FILTER (kind IN ({_in(M.BASIC)})) + 1 AS complexity FROM n GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def top_methods(spark, sf):
    """The ten most complex methods: a report's limit."""
    m = M.complexities(nodes(spark, sf).withColumn("class", F.lit(""))).select("path", "method", F.col("basic").alias("complexity"))
    return M.top_methods(m)


@query("method_quality", """WITH m AS (SELECT p_partkey, p_size AS c, p_partkey % 10 AS p, p_partkey % 8 AS d, p_size * 7 AS l, p_partkey % 3 AS k, (p_partkey % 50) / 100.0::DOUBLE AS s FROM part),
q AS (SELECT p_partkey, greatest(0, least(100, 100 - greatest(c - 10, 0) * 3 - greatest(c - 20, 0) * 5 - greatest(p - 4, 0) * 5 - greatest(p - 7, 0) * 10 - greatest(d - 3, 0) * 5 - greatest(d - 5, 0) * 10 - greatest(l - 30, 0) // 5 - greatest(l - 100, 0) // 3 - greatest(l - 200, 0) // 2 - k * 5 + CASE WHEN s > 0.05 AND s < 0.3 THEN 5 ELSE 0 END))::INT AS score FROM m)
SELECT p_partkey, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Acceptable' WHEN score >= 40 THEN 'Needs Improvement' WHEN score >= 20 THEN 'Poor' ELSE 'Critical' END AS rating FROM q""")
def method_quality(spark, sf):
    p = table(spark, sf, "part")
    score = M.quality(F.col("p_size"), F.col("p_partkey") % 10, F.col("p_partkey") % 8, F.col("p_size") * 7, F.col("p_partkey") % 3, (F.col("p_partkey") % 50) / 100.0)
    return p.select("p_partkey", score.alias("score")).withColumn("rating", M.quality_word(F.col("score")))


@query("small_measures", """SELECT p_partkey, greatest(1, least(10, 4 * (p_size % 2) + 3 * (p_size % 3) + 2 * (p_size % 4) + p_size % 5 + p_partkey % 3)) AS effort, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN greatest(4, 8 * (p_size % 4)) ELSE 16 END AS bytes, (p_size % 7)::DECIMAL(18,4) AS major,
'api/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/x' ELSE '' END AS route, coalesce(CASE WHEN length(p_name) > 30 THEN 'TooLong' WHEN length(p_name) < 25 AND p_size % 2 <> 0 THEN 'TooShort' END, '') AS length_issue, 10 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE -3 END + least(15, 3 * p_size) AS factor, round(0.8 * CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 1 END * CASE WHEN p_size % 3 = 0 THEN 0.7 ELSE 1 END * CASE WHEN p_size > 15 THEN 0.85 ELSE 1 END * CASE WHEN p_partkey % 8 > 4 THEN 0.9 ELSE 1 END, 6)::DOUBLE AS accepted FROM part""")
def small_measures(spark, sf):
    p, c = table(spark, sf, "part"), F.col
    name = F.element_at(F.array(*map(F.lit, ("int", "Foo", "Bar", "decimal"))), (c("p_partkey") % 4 + 1).cast("int"))
    even = c("p_size") % 2 == 0
    return p.select(
        "p_partkey", M.update_effort(c("p_size") % 2, c("p_size") % 3, c("p_size") % 4, c("p_size") % 5, c("p_partkey") % 3).alias("effort"), M.type_size(name, name == "Foo", c("p_size") % 4).alias("bytes"), M.major_version(F.concat(F.lit("v"), c("p_size") % 7, F.lit(".2.1"))).alias("major"),
        M.route(F.concat(F.lit("/api/"), "p_brand", F.lit("/")), F.when(even, "/x")).alias("route"), F.coalesce(M.length_issue(c("p_name"), 25, 30, even), F.lit("")).alias("length_issue"), I.kind_factor(F.when(even, "Deletion").otherwise("SignatureChange"), c("p_size")).alias("factor"),
        F.round(M.acceptance(F.lit(0.8), even, c("p_size") % 3 == 0, c("p_size"), c("p_partkey") % 8), 6).alias("accepted"),
    )


@query("quick_risk", f"WITH {TRADE}, {EDGES}, d AS (SELECT target AS symbol, count(*) AS n FROM e GROUP BY 1), s AS (SELECT n_name AS symbol, coalesce(n, 0) AS dependents, n_nationkey % 3 = 0 AS p, n_nationkey % 8 = 1 AS c FROM nation LEFT JOIN d ON symbol = n_name) SELECT symbol, dependents, CASE WHEN c OR p AND dependents > 10 THEN 'Critical' WHEN p OR dependents > 5 THEN 'High' WHEN dependents > 0 THEN 'Medium' ELSE 'Low' END AS risk FROM s".replace("FROM nation LEFT JOIN d ON symbol = n_name", "FROM nation LEFT JOIN d ON d.symbol = n_name"))
def quick_risk(spark, sf):
    s = table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), (F.col("n_nationkey") % 3 == 0).alias("is_public_api"), (F.col("n_nationkey") % 8 == 1).alias("is_critical"))
    return I.quick_risk(s, edges(spark, sf))


@query("deletion_errors", f"WITH {TRADE}, {EDGES} SELECT path, source, CASE type WHEN 'TypeUsage' THEN 'CS0246' WHEN 'Inheritance' THEN 'CS0246' WHEN 'Override' THEN 'CS0115' ELSE 'CS0103' END AS code FROM e WHERE target = (SELECT min(target) FROM e)")
def deletion_errors(spark, sf):
    e = edges(spark, sf)
    return I.deletion_errors(e, e.agg(F.min("target")).first()[0])


@query("method_importance", f"WITH {TRADE}, {EDGES} SELECT n_name AS method, (SELECT count(DISTINCT source) FROM e WHERE target = n_name) AS callers, (SELECT count(DISTINCT target) FROM e WHERE source = n_name) AS callees, CASE WHEN n_nationkey % 5 = 4 THEN 2147483647 ELSE n_nationkey % 5 END AS depth, n_nationkey % 5 <= 2 AS critical FROM nation")
def method_importance(spark, sf):
    n = table(spark, sf, "nation")
    depths = n.where("n_nationkey % 5 < 4").select(F.col("n_name").alias("node"), (F.col("n_nationkey") % 5).alias("depth"))
    return I.importance(n.select(F.col("n_name").alias("method")), edges(spark, sf), depths)


@query("definition_edges", "SELECT DISTINCT 'c' || o_custkey AS source, 'f' || (l_partkey % 100) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def definition_edges(spark, sf):
    """Customers' files use the parts that a hundred files define."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    used = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("l_partkey").alias("symbol"), F.concat(F.lit("c"), "o_custkey").alias("path"))
    return I.file_edges(l.select(F.col("l_partkey").alias("symbol"), F.concat(F.lit("f"), F.col("l_partkey") % 100).alias("path")), used)


@query("reassigned_uses", "SELECT 'o' || u.l_orderkey AS method, 'v' AS variable, u.l_linenumber AS line, count(*) AS definitions FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) u JOIN lineitem d ON u.l_orderkey = d.l_orderkey AND d.l_linenumber < u.l_linenumber GROUP BY u.l_orderkey, u.l_linenumber HAVING count(*) > 1")
def reassigned_uses(spark, sf):
    x = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("method"), F.lit("v").alias("variable"), F.col("l_linenumber").alias("line"))
    return I.reassigned(x, x.distinct())


@query("first_direct_package", "SELECT l_partkey AS package, min_by(l_suppkey, l_suppkey % 10 * 1000000 + l_suppkey) AS direct FROM lineitem GROUP BY 1")
def first_direct_package(spark, sf):
    """Suppliers as direct packages whose closure has the parts."""
    l = table(spark, sf, "lineitem")
    direct = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("package"), (F.col("l_suppkey") % 10 * 1000000 + F.col("l_suppkey")).alias("place")).distinct()
    return I.first_direct(l.select(F.col("l_suppkey").alias("root"), F.col("l_partkey").alias("node")).distinct(), direct)


@query("duplicate_bodies", "SELECT 'b' || p_brand AS class, p_type AS body_hash, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_bodies(spark, sf):
    return M.duplicate_bodies(table(spark, sf, "part").select(F.concat(F.lit("b"), "p_brand").alias("class"), F.col("p_type").alias("body_hash")))


@query("prefix_clusters", "WITH m AS (SELECT p_brand AS type, CASE p_partkey % 3 WHEN 0 THEN 'Get' WHEN 1 THEN 'Save' ELSE 'Is' END AS prefix FROM part) SELECT type, prefix, count(*) AS members, count(*) FILTER (prefix <> 'Save') AS readers, count(*) FILTER (prefix = 'Save') AS writers FROM m GROUP BY ALL HAVING count(*) >= 2")
def prefix_clusters(spark, sf):
    p = table(spark, sf, "part")
    verb = F.element_at(F.array(F.lit("GetItem"), F.lit("SaveItem"), F.lit("IsItem")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return M.prefix_clusters(p.select(F.col("p_brand").alias("type"), verb.alias("name")))


@query("clone_candidates", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 50 AND doc_id % 300 + 1 BETWEEN 5 AND 200 AND length(replace(text, ' ', '')) >= 20 AND lower(trim(text, ' ')) NOT IN ('return;', 'return null;') AND NOT ends_with(lower(source), '3') AND NOT contains(lower(source), 'rc1')")
def clone_candidates(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    f = d.select("doc_id", F.col("source").alias("path"), F.lit(1).alias("start_line"), (F.col("doc_id") % 300 + 1).alias("end_line"), F.array_remove(F.split("text", " "), "").alias("tokens"), F.col("text").alias("source"), F.col("text").alias("normalized"))
    return C.candidates(f, ["*3", "RC1"]).select("doc_id")


@query("clone_groups", "WITH d AS (SELECT doc_id, text, doc_id % 30 + 5 AS lines FROM documents WHERE text IS NOT NULL) SELECT sha256(text) AS \"group\", count(*) AS n, sum(lines)::BIGINT AS lines, min_by(doc_id, lines * 1000000000 + doc_id) AS representative, (sum(lines) - min(lines))::BIGINT AS saved FROM d GROUP BY text HAVING count(*) > 1")
def clone_groups(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return C.exact_groups(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 30 + 5).alias("lines"), "text"), "text")


@query("report_artifacts", f"WITH {ISSUES} SELECT DISTINCT path AS uri FROM issues")
def report_artifacts(spark, sf):
    return R.artifacts(issues(spark, sf))


@query("backup_errors", "SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE 'differs' END AS error FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def backup_errors(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.sha2("p_name", 256).alias("sha"), "p_partkey")
    now = p.where("p_partkey % 5 != 0").select("path", F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("sha")).alias("sha"))
    return R.backup_errors(p.select("path", "sha"), now)


@query("central_package_versions", "SELECT 'p' || p_partkey AS package, CASE WHEN p_partkey % 3 <> 0 THEN '1.' || p_size WHEN p_partkey % 2 = 0 THEN '9.0' ELSE '*' END AS version FROM part")
def central_package_versions(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("package"), "p_partkey", "p_size")
    refs = p.select("package", F.when(F.col("p_partkey") % 3 == 0, "*").otherwise(F.concat(F.lit("1."), "p_size")).alias("version"))
    return S.with_central_versions(refs, p.where("p_partkey % 2 = 0").select("package", F.lit("9.0").alias("version")))


@query("merged_advisories", "SELECT 'p' || p_partkey AS package, 'CVE-' || p_size AS id, CASE WHEN p_partkey % 2 = 0 THEN 'High' ELSE 'Low' END AS severity FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def merged_advisories(spark, sf):
    a = lambda n, s: table(spark, sf, "part").where(f"p_partkey % {n} = 0").select(F.concat(F.lit("p"), "p_partkey").alias("package"), F.concat(F.lit("CVE-"), "p_size").alias("id"), F.lit(s).alias("severity"))
    return S.advisories(a(2, "High"), a(3, "Low"))
