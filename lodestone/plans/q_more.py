"""Queries over detectors, rules and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..rules import engine as E
from ..session import table
from ..streaming import events as V
from .catalog import query


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("text_detectors", " UNION ALL ".join(f"SELECT '{d}' AS detector, '{c}' AS category, '{s}' AS severity, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE regexp_matches(text, '{_q(p)}') HAVING count(*) > 0" for d, c, s, p, *_ in D.TEXT))
def text_detectors(spark, sf):
    return D.in_text(table(spark, sf, "documents"), "doc_id", "text").groupBy("detector", "category", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("page_detectors", " UNION ALL ".join(f"SELECT '{d}' AS detector, count(*) AS n FROM pages WHERE regexp_matches(html, '{_q(p)}') HAVING count(*) > 0" for d, c, s, p, *_ in D.TEXT))
def page_detectors(spark, sf):
    return D.in_text(table(spark, sf, "pages"), "page_id", "html").groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


@query("method_smells", """WITH m AS (SELECT 'order' || l_orderkey AS path, 'line' || l_linenumber AS name, l_quantity * 3 AS lines, l_linenumber * 4 AS complexity, (l_discount * 100)::INT AS nesting, (l_tax * 100)::INT AS parameters FROM lineitem)
SELECT path, name, 'LongMethod' AS smell, CASE WHEN lines > 100 THEN 'High' ELSE 'Medium' END AS severity FROM m WHERE lines > 50 UNION ALL SELECT path, name, 'ComplexMethod', CASE WHEN complexity > 20 THEN 'High' ELSE 'Medium' END FROM m WHERE complexity > 10
UNION ALL SELECT path, name, 'DeepNesting', CASE WHEN nesting > 6 THEN 'High' ELSE 'Medium' END FROM m WHERE nesting > 4 UNION ALL SELECT path, name, 'LongParameterList', CASE WHEN parameters > 8 THEN 'High' ELSE 'Medium' END FROM m WHERE parameters > 5""")
def method_smells(spark, sf):
    l = table(spark, sf, "lineitem")
    return D.method_smells(l.select(F.concat(F.lit("order"), "l_orderkey").alias("path"), F.concat(F.lit("line"), "l_linenumber").alias("name"), (F.col("l_quantity") * 3).alias("lines"), (F.col("l_linenumber") * 4).alias("complexity"), F.round(F.col("l_discount") * 100).cast("int").alias("nesting"), F.round(F.col("l_tax") * 100).cast("int").alias("parameters")))


RULES = [
    {"name": "long-name", "message": "{name} in {class}", "severity": "Warning", "pattern": {"type": "method_declaration", "match": "*green*", "minParameters": 10}},
    {"name": "promo", "message": "{class} line {line}", "severity": "Error", "pattern": {"type": "method_declaration", "match": "*", "in": ["PROMO*"], "notIn": ["*STEEL"], "conditions": ["parameterCount(>=20)", "notSomething"]}},
    {"name": "off", "message": "never", "enabled": False, "pattern": {"type": "method_declaration", "match": "*"}},
    {"name": "odd", "message": "never, the number can't be read", "pattern": {"type": "method_declaration", "match": "*", "conditions": ["parameterCount(>=x)"]}},
]


@query("rule_engine", """SELECT 'long-name' AS rule, 'Warning' AS severity, 'src/' || p_partkey || '.cs' AS path, p_partkey::BIGINT AS line, p_name || ' in ' || p_type AS message FROM part WHERE contains(lower(p_name), 'green') AND p_size >= 10
UNION ALL SELECT 'promo', 'Error', 'src/' || p_partkey || '.cs', p_partkey, p_type || ' line ' || p_partkey FROM part WHERE starts_with(lower(p_type), 'promo') AND NOT ends_with(lower(p_type), 'steel') AND p_size >= 20""")
def rule_engine(spark, sf):
    """Parts as method declarations: type is class, size is the number of parameters."""
    p = table(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("src/"), "p_partkey", F.lit(".cs")).alias("path"), F.lit("Method").alias("kind"), F.col("p_partkey").alias("line"), F.lit(0).alias("depth"), F.col("p_name").alias("text"), F.col("p_name").alias("name"), F.col("p_name").alias("full_name"), F.col("p_type").alias("class"), F.col("p_name").alias("method"), F.lit("").alias("namespace"), F.col("p_size").alias("params"), F.array().cast("array<string>").alias("args"), F.lit("void").alias("returns"), F.array().cast("array<string>").alias("in_kinds"), F.create_map().cast("map<string,string>").alias("attrs"))
    rules, _ = E.parse(RULES)
    return E.violations(nodes, rules).select("rule", "severity", "path", "line", "message")


@query("tumbling_windows", """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    w = V.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"])
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("value", 4).alias("value"))


@query("sliding_windows", """WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS st FROM events) SELECT epoch_us(st)::BIGINT AS start_us, event_type, count(*) AS n FROM s GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    w = V.sliding(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes", ["event_type"])
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("session_windows", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*) AS n, epoch_us(max(ts))::BIGINT AS last_us FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    w = V.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return w.select("user_id", F.unix_micros("start").alias("start_us"), "n", F.unix_micros("last").alias("last_us"))


@query("stream_counters", """SELECT 'u' || user_id AS pattern, count_if(event_type <> 'error')::BIGINT AS total, count_if(event_type = 'purchase')::BIGINT AS applied, count_if(event_type = 'view')::BIGINT AS rejected, count_if(event_type = 'error')::BIGINT AS reverted FROM events GROUP BY 1""")
def stream_counters(spark, sf):
    """Keyed counters as a stream over the events' files."""
    e = V.event_stream(spark, sf)
    action = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "error", "reverted").otherwise("shown")
    return V.run_to_table(V.counters(e.select(F.concat(F.lit("u"), "user_id").alias("pattern"), action.alias("action"))), "stream_counters")


@query("debounced_edits", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(max(ts))::BIGINT AS at_us, count(*) AS edits FROM s GROUP BY user_id, k""")
def debounced_edits(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return V.debounced(e, "ts", "user_id", ["event_id"], "30 minutes").select("user_id", F.unix_micros("ts").alias("at_us"), "edits")


@query("incremental_recompute", "SELECT doc_id, n_chars * 2 AS result FROM documents")
def incremental_recompute(spark, sf):
    """A cache of half the texts, some stale: only new and stale ones are analysed again."""
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("digest"), "n_chars")
    analyse = lambda x: x.select("doc_id", "digest", (F.col("n_chars") * 2).alias("result"))
    stale = F.col("n_chars") % 5 == 0
    cache = d.where("lang = 'en'").select("doc_id", F.when(stale, F.lit(0)).otherwise(F.col("digest")).alias("digest"), F.when(stale, F.lit(-1)).otherwise(F.col("n_chars") * 2).alias("result"))
    return V.recompute(d, cache, analyse, "doc_id", "digest").select("doc_id", "result")
