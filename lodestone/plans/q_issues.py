"""Queries over issues: summaries, severities, hotspots, deduplication, filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S
from ..functions import text as T
from ..operators import issues as I
from ..session import table
from .catalog import query
from .facts import ISSUES, issues


@query("issue_summary", f"""WITH {ISSUES}, g AS (SELECT category, rule_id, path, grouping_id(category, rule_id, path) AS g, count(*) AS issues, count_if(sev_rank >= 3)::BIGINT AS errors, count_if(sev_rank = 2)::BIGINT AS warnings,
    count_if(sev_rank <= 1)::BIGINT AS infos, count_if(contains(category, 'Security') OR cwe IS NOT NULL)::BIGINT AS security FROM issues GROUP BY GROUPING SETS ((category), (rule_id), (path), ()))
SELECT CASE g WHEN 3 THEN 'category' WHEN 5 THEN 'rule' WHEN 6 THEN 'file' ELSE 'all' END AS dimension, coalesce(category, rule_id, path, '') AS value, issues, errors, warnings, infos, security,
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 5 * errors - 2 * warnings - 0.5::DOUBLE * infos)) AS quality_score, greatest(0.0::DOUBLE, 100 - 10.0::DOUBLE * security) AS security_score FROM g""")
def issue_summary(spark, sf):
    return I.summary(issues(spark, sf))


@query("severity_pivot", """SELECT year(o_orderdate)::INT AS year, count_if(o_orderpriority = '1-URGENT')::BIGINT AS urgent, count_if(o_orderpriority = '2-HIGH')::BIGINT AS high, count_if(o_orderpriority = '3-MEDIUM')::BIGINT AS medium,
    count_if(o_orderpriority = '5-LOW')::BIGINT AS low FROM orders GROUP BY 1""")
def severity_pivot(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    out = I.severity_table(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), "o_orderpriority", names, ["year"])
    return out.toDF("year", "urgent", "high", "medium", "low")


@query("quality_security_score", f"""WITH {ISSUES}, p AS (SELECT path, count_if(sev_rank >= 3) AS e, count_if(sev_rank = 2) AS w, count_if(sev_rank <= 1) AS i, count_if(cwe IS NOT NULL) AS s FROM issues GROUP BY path)
SELECT path, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 5 * e - 2 * w - 0.5::DOUBLE * i)) AS quality, greatest(0.0::DOUBLE, 100 - 10.0::DOUBLE * s) AS security FROM p""")
def quality_security_score(spark, sf):
    p = issues(spark, sf).groupBy("path").agg(F.count_if(F.col("sev_rank") >= 3).alias("e"), F.count_if(F.col("sev_rank") == 2).alias("w"), F.count_if(F.col("sev_rank") <= 1).alias("i"), F.count_if(F.col("cwe").isNotNull()).alias("s"))
    return p.select("path", S.quality_score(F.col("e"), F.col("w"), F.col("i")).alias("quality"), S.security_score(F.col("s")).alias("security"))


@query("file_hotspots", f"""WITH {ISSUES} SELECT path, count_if(sev_rank >= 3)::BIGINT AS severe, count(*) AS issues FROM issues GROUP BY path ORDER BY severe DESC, issues DESC, path LIMIT 10""")
def file_hotspots(spark, sf):
    return I.hotspots(issues(spark, sf))


@query("dedupe_max_severity", f"""WITH {ISSUES}, r AS (SELECT path, ts::DATE AS day, category, id, severity, row_number() OVER (PARTITION BY path, ts::DATE, rule_id ORDER BY sev_rank DESC, id) AS n, rule_id FROM issues)
SELECT path, strftime(day, '%Y-%m-%d') AS day, rule_id, id, severity FROM r WHERE n = 1""")
def dedupe_max_severity(spark, sf):
    i = issues(spark, sf).withColumn("day", F.to_date("ts"))
    return I.worst_of(i, ["path", "day", "rule_id"], [F.col("id")]).select("path", F.col("day").cast("string").alias("day"), "rule_id", "id", "severity")


@query("top_issues_per_file", f"""WITH {ISSUES}, r AS (SELECT path, id, severity, line, row_number() OVER (PARTITION BY path ORDER BY sev_rank DESC, line, id) AS n FROM issues) SELECT path, id, severity, line FROM r WHERE n <= 100""")
def top_issues_per_file(spark, sf):
    return I.top_per(issues(spark, sf), ["path"], [F.desc("sev_rank"), F.col("line"), F.col("id")], 100).select("path", "id", "severity", "line")


@query("issues_by_category_rule_severity", f"""WITH {ISSUES} SELECT coalesce(category, '') AS category, coalesce(rule_id, '') AS rule_id, coalesce(severity, '') AS severity, count(*) AS n FROM issues GROUP BY GROUPING SETS ((category), (rule_id), (severity))""")
def issues_by_category_rule_severity(spark, sf):
    c, r, s = F.col("category"), F.col("rule_id"), F.col("severity")
    g = issues(spark, sf).groupingSets([[c], [r], [s]], c, r, s).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*[F.coalesce(x, F.lit("")).alias(x) for x in ("category", "rule_id", "severity")], "n")


@query("issues_cube", f"""WITH {ISSUES} SELECT coalesce(category, '*') AS category, coalesce(severity, '*') AS severity, count(*) AS n, count(DISTINCT path) AS files FROM issues GROUP BY CUBE (category, severity)""")
def issues_cube(spark, sf):
    g = issues(spark, sf).cube("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))
    return g.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("severity", F.lit("*")).alias("severity"), "n", "files")


@query("issues_by_cwe", f"""WITH {ISSUES} SELECT cwe, count(*) AS n, count(DISTINCT path) AS files, min(id) AS first_id FROM issues WHERE cwe IS NOT NULL GROUP BY cwe""")
def issues_by_cwe(spark, sf):
    return issues(spark, sf).where("cwe is not null").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"), F.min("id").alias("first_id"))


@query("issue_filter", f"""WITH {ISSUES} SELECT id, path, severity, category FROM issues WHERE upper(severity) IN ('CRITICAL', 'ERROR') AND contains(lower(path), 'file1') AND contains(lower(message), 'err')""")
def issue_filter(spark, sf):
    return I.filtered(issues(spark, sf), severities=["critical", "error"], path="File1", text="ERR").select("id", "path", "severity", "category")


@query("grouped_issue_lists", f"""WITH {ISSUES} SELECT path, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY line, id) AS ids FROM issues GROUP BY path""")
def grouped_issue_lists(spark, sf):
    g = issues(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("line", "id"))).alias("x"))
    return g.select("path", "n", F.array_join(F.transform("x", lambda v: v["id"].cast("string")), ",").alias("ids"))


@query("issue_fingerprint", f"""WITH {ISSUES} SELECT id, upper(substr(sha256(rule_id || ':' || path || ':' || category || ':' || message), 1, 16)) AS fingerprint FROM issues""")
def issue_fingerprint(spark, sf):
    return issues(spark, sf).select("id", T.fingerprint(F.col("rule_id"), F.col("path"), F.col("category"), F.col("message")).alias("fingerprint"))


@query("dominant_pattern", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS dominant, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c)
SELECT user_id, event_type, n, dominant, round(share::DOUBLE, 6) AS share FROM d WHERE event_type <> dominant""")
def dominant_pattern(spark, sf):
    return I.minority(table(spark, sf, "events"), "user_id", "event_type").withColumn("share", F.round("share", 6))


@query("dense_severity", """SELECT e.user_id, s.severity, count(v.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) e CROSS JOIN (VALUES ('error'), ('click'), ('view'), ('purchase')) s(severity)
LEFT JOIN events v ON v.user_id = e.user_id AND v.event_type = s.severity GROUP BY 1, 2""")
def dense_severity(spark, sf):
    kinds = ["error", "click", "view", "purchase"]
    wide = I.severity_table(table(spark, sf, "events"), "event_type", kinds, ["user_id"])
    return wide.unpivot("user_id", kinds, "severity", "n")


@query("severity_stats", f"""WITH {ISSUES} SELECT severity, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(max(value), 6) AS most, count_if(value > 100)::BIGINT AS hot FROM issues GROUP BY severity""")
def severity_stats(spark, sf):
    v = F.col("value")
    return issues(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v), 6).alias("most"), F.count_if(v > 100).alias("hot"))


@query("weighted_health", f"""WITH {ISSUES}, p AS (SELECT path, count_if(sev_rank = 4) AS c, count_if(sev_rank = 3) AS h, count_if(sev_rank = 2) AS m, count_if(sev_rank = 1) AS l FROM issues GROUP BY path)
SELECT path, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 10 * c - 5 * h - 2 * m - 0.5::DOUBLE * l)) AS weighted,
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - least(30.0::DOUBLE, c * 10.0::DOUBLE) - least(20.0::DOUBLE, h * 5.0::DOUBLE) - least(15.0::DOUBLE, m * 2.0::DOUBLE) - least(10.0::DOUBLE, l * 0.5::DOUBLE))) AS capped,
    least(100, 25 * c + 15 * h + 8 * m + 2 * l)::BIGINT AS risk, CASE WHEN least(100, 25 * c + 15 * h + 8 * m + 2 * l) >= 75 THEN 'Critical' WHEN 25 * c + 15 * h + 8 * m + 2 * l >= 50 THEN 'High' WHEN 25 * c + 15 * h + 8 * m + 2 * l >= 25 THEN 'Medium' WHEN 25 * c + 15 * h + 8 * m + 2 * l >= 1 THEN 'Low' ELSE 'None' END AS level FROM p""")
def weighted_health(spark, sf):
    p = issues(spark, sf).groupBy("path").agg(*[F.count_if(F.col("sev_rank") == k).alias(n) for n, k in (("c", 4), ("h", 3), ("m", 2), ("l", 1))])
    c = [F.col(x) for x in "chml"]
    return p.select("path", S.weighted_health(*c).alias("weighted"), S.capped_health(*c).alias("capped"), S.dependency_risk(*c).alias("risk"), S.risk_level(S.dependency_risk(*c)).alias("level"))


@query("annotations", f"""WITH {ISSUES} SELECT id, '::' || CASE WHEN sev_rank >= 3 THEN 'error' WHEN sev_rank = 2 THEN 'warning' ELSE 'notice' END || ' file=' || path || ',line=' || line || '::' || replace(replace(message, '%', '%25'), ':', '%3A') AS text
FROM issues ORDER BY sev_rank DESC, path, line, id LIMIT 1000""")
def annotations(spark, sf):
    from ..sinks.reports import annotation_lines

    return annotation_lines(issues(spark, sf), 1000)


@query("clean_files", f"""WITH {ISSUES} SELECT (SELECT count(DISTINCT user_id) FROM events) - count(DISTINCT path) AS clean, count(DISTINCT path) AS dirty FROM issues WHERE sev_rank >= 4""")
def clean_files(spark, sf):
    i = issues(spark, sf)
    return i.agg((F.count_distinct("path") - F.count_distinct(F.when(F.col("sev_rank") >= 4, F.col("path")))).alias("clean"), F.count_distinct(F.when(F.col("sev_rank") >= 4, F.col("path"))).alias("dirty"))


@query("event_rank_lag", """SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS r, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS quarter FROM events""")
def event_rank_lag(spark, sf):
    w = W.partitionBy("user_id")
    t = w.orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", "user_id", F.rank().over(w.orderBy(F.desc("value"), "event_id")).alias("r"), F.lag("event_type").over(t).alias("previous"), F.ntile(4).over(t).alias("quarter"))


@query("magic_numbers", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]+\b')) AS v FROM documents) SELECT v AS value, count(*) AS n, min(doc_id) AS first_doc, CASE WHEN count(*) >= 5 THEN 'Warning' ELSE 'Info' END AS severity FROM m GROUP BY v HAVING count(*) >= 2""")
def magic_numbers(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]+\b"), F.lit(0))).alias("value"))
    return I.repeated_values(d, "value", 2).select("value", "n", F.col("path").alias("first_doc"), "severity")


@query("data_clumps", """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS names FROM lineitem GROUP BY 1) SELECT names, count(*) AS owners FROM s GROUP BY names HAVING count(*) >= 3 ORDER BY owners DESC, names LIMIT 10""")
def data_clumps(spark, sf):
    return I.clumps(table(spark, sf, "lineitem").withColumn("s", F.col("l_suppkey").cast("string")), "l_orderkey", "s")
