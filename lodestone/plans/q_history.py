"""Queries over debt, churn and series: ranking, ratings, trends, regressions, projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S
from ..operators import history as H
from ..operators import issues as I
from ..session import table
from .catalog import query
from .facts import COMMITS, DEBT, commits, debt

PAYOFF = "(impact * frequency * CASE severity WHEN 'Critical' THEN 3.0::DOUBLE WHEN 'High' THEN 2.0::DOUBLE WHEN 'Medium' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (effort + 1) * CASE WHEN interest > 10 THEN 1.2::DOUBLE WHEN interest > 5 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)"
PRIORITY = f"CASE WHEN severity = 'Critical' OR (category = 'Security' AND severity IN ('Critical', 'High')) THEN 'Critical' WHEN ({PAYOFF} >= 2 AND effort <= 35) OR (frequency >= 5 AND effort <= 40) THEN 'QuickWin' WHEN (impact >= 60 AND effort >= 50) OR category IN ('GodClass', 'CircularDependency') THEN 'MajorProject' ELSE 'LowPriority' END"


def _scored(spark, sf):
    d = debt(spark, sf)
    pay = S.payoff(*map(F.col, ("impact", "frequency", "severity", "effort", "interest")))
    return d.withColumn("payoff", pay).withColumn("priority", S.priority(*map(F.col, ("severity", "category", "impact", "effort", "payoff", "frequency"))))


@query("debt_payoff_rank", f"""WITH {DEBT}, s AS (SELECT *, {PAYOFF} AS payoff, {PRIORITY} AS priority FROM debt),
r AS (SELECT id, priority, round(payoff, 6) AS payoff, row_number() OVER (PARTITION BY priority ORDER BY round(payoff, 6) DESC, id)::INT AS r FROM s)
SELECT id, priority, payoff, r FROM r WHERE priority = 'Critical' OR r <= CASE priority WHEN 'QuickWin' THEN 20 WHEN 'MajorProject' THEN 15 ELSE 30 END""")
def debt_payoff_rank(spark, sf):
    """All critical items; of the other buckets the first 20, 15 and 30 by payoff."""
    s = _scored(spark, sf).withColumn("payoff", F.round("payoff", 6))
    s = s.withColumn("r", F.row_number().over(W.partitionBy("priority").orderBy(F.desc("payoff"), "id")))
    most = S.choose(F.col("priority"), {"QuickWin": 20, "MajorProject": 15}, 30)
    return s.where((F.col("priority") == "Critical") | (F.col("r") <= most)).select("id", "priority", "payoff", "r")


@query("debt_summary", f"""WITH {DEBT} SELECT coalesce(category, '') AS category, coalesce(severity, '') AS severity, count(*) AS items, sum(minutes)::BIGINT AS minutes, sum(interest)::BIGINT AS interest FROM debt GROUP BY GROUPING SETS ((category), (severity), ())""")
def debt_summary(spark, sf):
    c, s = F.col("category"), F.col("severity")
    g = debt(spark, sf).groupingSets([[c], [s], []], c, s).agg(F.count(F.lit(1)).alias("items"), F.sum("minutes").alias("minutes"), F.sum("interest").alias("interest"))
    return g.select(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("severity", F.lit("")).alias("severity"), "items", "minutes", "interest")


@query("debt_rating", f"""WITH {DEBT}, p AS (SELECT path, count_if(severity = 'Critical') AS c, count_if(severity = 'High') AS h, count_if(severity = 'Medium') AS m, count_if(category = 'Security') AS s, avg(minutes) AS a, count(*) AS n,
    avg(CASE severity WHEN 'Critical' THEN 10.0::DOUBLE WHEN 'High' THEN 5.0::DOUBLE WHEN 'Medium' THEN 2.0::DOUBLE WHEN 'Low' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS w FROM debt GROUP BY path), q AS (SELECT *, 20 * c + 10 * h + 3 * m + 5 * s + least(a / 10, 30.0::DOUBLE) AS x FROM p)
SELECT path, CASE WHEN x <= 10 THEN 'A' WHEN x <= 30 THEN 'B' WHEN x <= 60 THEN 'C' WHEN x <= 100 THEN 'D' ELSE 'E' END AS rating, round(least(100.0::DOUBLE, least(20 * w, 100.0::DOUBLE) + least(n / 50.0::DOUBLE * 20, 30.0::DOUBLE)), 6) AS score FROM q""")
def debt_rating(spark, sf):
    sev = F.col("severity")
    p = debt(spark, sf).groupBy("path").agg(*[F.count_if(sev == k).alias(n) for n, k in (("c", "Critical"), ("h", "High"), ("m", "Medium"))], F.count_if(F.col("category") == "Security").alias("s"), F.avg("minutes").alias("a"), F.count(F.lit(1)).alias("n"), F.avg(S.severity_weight(sev)).alias("w"))
    return p.select("path", S.debt_rating(*map(F.col, "chmsa")).alias("rating"), F.round(S.debt_score(F.col("w"), F.col("n")), 6).alias("score"))


@query("debt_files", f"""WITH {DEBT}, p AS (SELECT path, sum(minutes)::BIGINT AS debt, count(*) AS items, count_if(severity = 'Critical')::BIGINT AS critical, count_if(severity = 'High')::BIGINT AS high FROM debt GROUP BY path) SELECT * FROM p ORDER BY critical DESC, high DESC, debt DESC, path LIMIT 15""")
def debt_files(spark, sf):
    sev = F.col("severity")
    p = debt(spark, sf).groupBy("path").agg(F.sum("minutes").alias("debt"), F.count(F.lit(1)).alias("items"), F.count_if(sev == "Critical").alias("critical"), F.count_if(sev == "High").alias("high"))
    return p.orderBy(F.desc("critical"), F.desc("high"), F.desc("debt"), "path").limit(15)


@query("debt_top_types", f"""WITH {DEBT}, c AS (SELECT path, category, count(*) AS n FROM debt GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, category) AS r FROM c) SELECT path, string_agg(category, ',' ORDER BY r) AS types FROM r WHERE r <= 3 GROUP BY path""")
def debt_top_types(spark, sf):
    c = debt(spark, sf).groupBy("path", "category").agg(F.count(F.lit(1)).alias("n"))
    top = I.top_per(c, ["path"], [F.desc("n"), F.col("category")], 3)
    return top.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))), lambda x: x["category"]), ",").alias("types"))


@query("churn_per_file", f"""WITH {COMMITS}, p AS (SELECT path, count(DISTINCT commit) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM commits GROUP BY path)
SELECT *, 2.0::DOUBLE * commits + (added + deleted) / 100.0::DOUBLE AS score, CASE WHEN commits > 50 THEN 'very frequent changes' WHEN commits > 20 THEN 'frequent changes' ELSE '' END || CASE WHEN added + deleted > 5000 THEN CASE WHEN commits > 20 THEN ', ' ELSE '' END || 'large churn' ELSE '' END AS reasons
FROM p WHERE commits >= 10 ORDER BY score DESC, path LIMIT 20""")
def churn_per_file(spark, sf):
    return H.churn(commits(spark, sf))


@query("commits_per_day", f"""WITH {COMMITS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, sum(added)::BIGINT AS added FROM commits GROUP BY 1""")
def commits_per_day(spark, sf):
    return commits(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"), F.sum("added").alias("added"))


@query("author_contributions", f"""WITH {COMMITS}, a AS (SELECT author, count(DISTINCT commit) AS commits, sum(added)::BIGINT AS added, count(DISTINCT path) AS files FROM commits GROUP BY author) SELECT *, rank() OVER (ORDER BY commits DESC, added DESC, author)::INT AS r FROM a ORDER BY r LIMIT 100""")
def author_contributions(spark, sf):
    a = commits(spark, sf).groupBy("author").agg(F.count_distinct("commit").alias("commits"), F.sum("added").alias("added"), F.count_distinct("path").alias("files"))
    top = a.orderBy(F.desc("commits"), F.desc("added"), "author").limit(100)
    return top.withColumn("r", F.rank().over(W.orderBy(F.desc("commits"), F.desc("added"), "author")))


@query("stale_files", f"""WITH {COMMITS}, l AS (SELECT path, max(ts) AS last FROM commits GROUP BY path) SELECT path, strftime(last, '%Y-%m-%d') AS last, date_diff('day', last::DATE, (SELECT max(ts)::DATE FROM commits))::INT AS days FROM l WHERE date_diff('day', last::DATE, (SELECT max(ts)::DATE FROM commits)) > 730""")
def stale_files(spark, sf):
    c = commits(spark, sf)
    last = c.groupBy("path").agg(F.max("ts").alias("last"))
    newest = F.broadcast(c.agg(F.max("ts").alias("newest")))  # one row
    days = F.date_diff(F.to_date("newest"), F.to_date("last"))
    return last.join(newest, F.col("last") <= F.col("newest")).where(days > 730).select("path", F.to_date("last").cast("string").alias("last"), days.alias("days"))


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("health"))


DAILY = "daily AS (SELECT ts::DATE AS day, count(*) AS n, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'purchase')::BIGINT AS health FROM events GROUP BY 1)"


@query("trend_flags", f"""WITH {DAILY}, l AS (SELECT *, lag(errors) OVER (ORDER BY day) AS e0, lag(health) OVER (ORDER BY day) AS h0 FROM daily)
SELECT strftime(day, '%Y-%m-%d') AS day, errors, coalesce(errors - e0, 0)::BIGINT AS errors_delta, CASE WHEN e0 IS NULL THEN 'Unknown' WHEN abs(errors - e0) < abs(e0) * 0.05 THEN 'Stable' WHEN errors > e0 THEN 'Declining' ELSE 'Improving' END AS errors_trend,
    CASE WHEN h0 IS NULL THEN 'Unknown' WHEN abs(health - h0) < abs(h0) * 0.05 THEN 'Stable' WHEN health > h0 THEN 'Improving' ELSE 'Declining' END AS health_trend FROM l""")
def trend_flags(spark, sf):
    d = H.deltas(_daily(spark, sf), "day", {"errors": True, "health": False})
    return d.select(F.col("day").cast("string").alias("day"), "errors", F.coalesce("errors_delta", F.lit(0)).alias("errors_delta"), "errors_trend", "health_trend")


@query("regressions_7d", f"""WITH {DAILY}, w AS (SELECT * FROM daily WHERE day >= (SELECT max(day) FROM daily) - 7), x AS (SELECT arg_min(errors, day) AS e0, arg_max(errors, day) AS e1, arg_min(health, day) AS h0, arg_max(health, day) AS h1, arg_min(n, day) AS n0, arg_max(n, day) AS n1 FROM w)
SELECT 'errors' AS metric, e0::DOUBLE AS first, e1::DOUBLE AS last FROM x WHERE e1 - e0 > 0 UNION ALL SELECT 'health', h0, h1 FROM x WHERE h0 - h1 > 10 UNION ALL SELECT 'n', n0, n1 FROM x WHERE n1 - n0 > 5""")
def regressions_7d(spark, sf):
    return H.regressions(_daily(spark, sf), "day", 7, {"errors": ("up", 0), "health": ("down", 10), "n": ("up", 5)})


@query("trend_halves", """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM d),
p AS (SELECT event_type, max(c) AS points, avg(n) FILTER (i <= floor(c / 2)) AS a, avg(n) FILTER (i > floor(c / 2)) AS b FROM r GROUP BY 1)
SELECT event_type, points, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN points < 2 THEN 'Unknown' WHEN (b - a) / a > 0.05 THEN 'Increasing' WHEN (b - a) / a < -0.05 THEN 'Decreasing' ELSE 'Stable' END AS direction FROM p""")
def trend_halves(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return H.halves(d, "day", "n", "event_type").withColumns({c: F.round(c, 6) for c in ("first_half", "second_half")})


@query("debt_projections", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*)::DOUBLE AS y FROM orders GROUP BY 1), r AS (SELECT y, (row_number() OVER (ORDER BY month) - 1)::DOUBLE AS x FROM m), f AS (SELECT regr_slope(y, x) AS slope, arg_max(y, x) AS last FROM r)
SELECT k::INT AS months, round(slope, 6) AS slope, round(greatest(0.0::DOUBLE, last + slope * k * 4), 4) AS projected FROM f, (VALUES (1), (3), (6)) t(k)""")
def debt_projections(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("y"))
    return H.projections(m, "month", "y").select("months", F.round("slope", 6).alias("slope"), F.round("projected", 4).alias("projected"))


@query("growth_first_last", """WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT p, arg_min(n, y) AS a, arg_max(n, y) AS b FROM m GROUP BY p)
SELECT p AS priority, a AS first, b AS last, round(CASE WHEN a = 0 THEN 0.0 ELSE (b - a) * 100.0 / a END::DOUBLE, 6) AS change FROM f""")
def growth_first_last(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    f = m.groupBy("priority").agg(F.min_by("n", "y").alias("first"), F.max_by("n", "y").alias("last"))
    return f.withColumn("change", F.round(F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) * 100.0 / F.col("first")), 6))


@query("rejection_correlations", """WITH r AS (SELECT d.doc_id, quality, n_chars > 1500 AS is_long, lang = 'en' AS is_english, contains(text, chr(10)) AS has_lines FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
u AS (SELECT 'is_english' AS factor, is_english AS side, quality FROM r UNION ALL SELECT 'is_long', is_long, quality FROM r UNION ALL SELECT 'has_lines', has_lines, quality FROM r),
p AS (SELECT factor, side, count(*) AS n, avg(quality) AS rate FROM u GROUP BY 1, 2), b AS (SELECT factor, min(n) AS n, count(*) AS sides, min(rate) AS lo, max(rate) AS hi, arg_min(side, rate) AS low_group FROM p GROUP BY factor)
SELECT factor, low_group, round(lo, 6) AS low_rate, round(hi, 6) AS high_rate FROM b WHERE sides = 2 AND n >= 5 AND hi - lo > 0.02""")
def rejection_correlations(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    r = l.join(d, "doc_id").select("quality", (F.col("n_chars") > 1500).alias("is_long"), (F.col("lang") == "en").alias("is_english"), F.contains("text", F.lit("\n")).alias("has_lines"))
    out = H.spread(r, ["is_english", "is_long", "has_lines"], F.col("quality"), 5, 0.02)
    return out.withColumns({c: F.round(c, 6) for c in ("low_rate", "high_rate")})


@query("pattern_stats", """SELECT source AS pattern, count(*) AS total, count_if(quality = 1)::BIGINT AS applied, count_if(toxic = 1)::BIGINT AS reverted, CASE WHEN count(*) >= 5 THEN 0.5::DOUBLE + (count_if(quality = 1) - count_if(toxic = 1)) / count(*)::DOUBLE ELSE 1.0 END AS modifier
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source""")
def pattern_stats(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = l.join(d, "doc_id").groupBy(F.col("source").alias("pattern")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("applied"), F.count_if(F.col("toxic") == 1).alias("reverted"))
    return p.withColumn("modifier", S.modifier(F.col("applied"), F.col("reverted"), F.col("total")))


@query("confidence_scores", """WITH m AS (SELECT source, CASE WHEN count(*) >= 5 THEN 0.5::DOUBLE + (count_if(quality = 1) - count_if(toxic = 1)) / count(*)::DOUBLE ELSE 1.0 END AS f FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source),
s AS (SELECT doc_id, d.source, 0.5::DOUBLE + CASE WHEN n_chars < 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_chars > 5000 THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN lang = 'en' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS b, f FROM documents d LEFT JOIN m ON d.source = m.source)
SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, b * CASE WHEN abs(coalesce(f, 1.0::DOUBLE) - 1) > 0.1 THEN coalesce(f, 1.0::DOUBLE) ELSE 1.0::DOUBLE END)), 6) AS confidence FROM s""")
def confidence_scores(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    learned = pattern_stats(spark, sf).select(F.col("pattern").alias("source"), "modifier")
    adjust = [F.when(F.col("n_chars") < 500, 0.1).otherwise(0.0), F.when(F.col("n_chars") > 5000, -0.15).otherwise(0.0), F.when(F.col("lang") == "en", 0.05).otherwise(0.0)]
    return d.join(learned, "source", "left").select("doc_id", F.round(S.confidence(adjust, F.coalesce("modifier", F.lit(1.0))), 6).alias("confidence"))


@query("calibration", """SELECT round(coalesce(avg(quality) FILTER (n_chars < 1500), 0.5), 6) AS confident, round(coalesce(avg(quality) FILTER (n_chars > 5000), 0.5), 6) AS doubtful FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def calibration(spark, sf):
    r = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return r.agg(*[F.round(F.coalesce(F.avg(F.when(c, F.col("quality"))), F.lit(0.5)), 6).alias(n) for n, c in (("confident", F.col("n_chars") < 1500), ("doubtful", F.col("n_chars") > 5000))])


@query("health_score", """WITH p AS (SELECT c_nationkey AS k, count_if(o_orderpriority = '1-URGENT') AS c, count_if(o_orderpriority = '2-HIGH') AS h, count(*) AS n, avg(o_totalprice) / 20000 AS cc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT k AS nation, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 10 * (c * 10 // n) - 5 * (h * 10 // n) - 0 - 0 - CASE WHEN cc > 15 THEN 10 WHEN cc > 10 THEN 5 ELSE 0 END - 0 + CASE WHEN 60 > 80 THEN 5 WHEN 60 < 50 THEN -5 ELSE 0 END)) AS health FROM p""")
def health_score(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("c"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("h"), F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 20000).alias("cc"))
    z = F.lit(0)
    return p.select("nation", S.health_score(F.floor(F.col("c") * 10 / F.col("n")), F.floor(F.col("h") * 10 / F.col("n")), z, z, F.col("cc"), z, F.lit(60)).alias("health"))
