"""Report writers: SARIF, JUnit, annotation lines, pipeline commands, Graphviz, HTML, JSON and Markdown.

Rows become lines or fragments on the executors; only what a format limits
itself (``most`` issues) or small aggregates reach one place.
"""

from __future__ import annotations

import html
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotation


def ranked(issues: DataFrame, most: int, least: int = 0) -> DataFrame:
    """At most ``most`` issues of at least this rank, worst first, then by place."""
    return issues.where(F.col("sev_rank") >= least).orderBy(F.desc("sev_rank"), "path", "line", "id").limit(most)


def level(names: tuple[str, str, str]):
    return F.when(F.col("sev_rank") >= 3, names[0]).when(F.col("sev_rank") == 2, names[1]).otherwise(names[2])


def annotation_lines(issues: DataFrame, most: int = 1000, least: int = 0) -> DataFrame:
    """(id, text): workflow annotation commands."""
    text = F.concat(F.lit("::"), level(("error", "warning", "notice")), F.lit(" file="), "path", F.lit(",line="), "line", F.lit("::"), annotation(F.col("message")))
    return ranked(issues, most, least).select("id", text.alias("text"))


def pipeline_lines(issues: DataFrame, most: int = 1000, least: int = 0) -> DataFrame:
    """(id, text): build pipeline log commands."""
    text = F.concat(F.lit("##vso[task.logissue type="), level(("error", "warning", "warning")), F.lit(";sourcepath="), "path", F.lit(";linenumber="), "line", F.lit(";code="), "rule_id", F.lit("]"), "message")
    return ranked(issues, most, least).select("id", text.alias("text"))


def sarif(issues: DataFrame, tool: str = "lodestone", most: int = 1000, least: int = 0) -> str:
    """A SARIF 2.1.0 document; results are made as JSON by the executors."""
    place = F.struct(F.struct(F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level(("error", "warning", "note")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))
    rows = ranked(issues, most, least).select("rule_id", "path", result.alias("r")).collect()
    rules = [{"id": r} for r in sorted({x["rule_id"] for x in rows})]
    artifacts = [{"location": {"uri": p}} for p in sorted({x["path"].replace("\\", "/") for x in rows})]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "artifacts": artifacts, "results": [json.loads(x["r"]) for x in rows]}]})


def junit(issues: DataFrame, files: int, most: int = 1000, least: int = 0) -> str:
    """A suite for each category, a case for each issue (failed from errors on), and one case that counts clean files, whatever ``most`` is."""
    rows = ranked(issues, most, least).collect()
    touched = issues.where(F.col("sev_rank") >= least).agg(F.count_distinct("path")).first()[0]
    suites: dict[str, list] = {}
    for r in rows:
        suites.setdefault(r["category"], []).append(r)
    parts = []
    for name in sorted(suites):
        cases = "".join(f"<testcase name={quoteattr(f'{r["rule_id"]} {r["path"]}:{r["line"]}')} classname={quoteattr(name)}>" + (f"<failure message={quoteattr(r['message'])}/>" if r["sev_rank"] >= 3 else f"<system-out>{escape(r['message'])}</system-out>") + "</testcase>" for r in suites[name])
        failed = sum(r["sev_rank"] >= 3 for r in suites[name])
        parts.append(f'<testsuite name={quoteattr(name)} tests="{len(suites[name])}" failures="{failed}">{cases}</testsuite>')
    clean = files - touched
    parts.append(f'<testsuite name="clean files" tests="1" failures="0"><testcase name="{clean} files without issues"/></testsuite>')
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuites>{"".join(parts)}</testsuites>'


def dot_lines(edges: DataFrame) -> DataFrame:
    """(text): a Graphviz line for each edge; write them between ``digraph {`` and ``}``."""
    return edges.select("source", "target").distinct().select(F.format_string('"%s" -> "%s";', F.replace("source", F.lit('"'), F.lit('\\"')), F.replace("target", F.lit('"'), F.lit('\\"'))).alias("text"))


def file_breakdown(issues: DataFrame, n: int = 20) -> DataFrame:
    return issues.groupBy("path").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("sev_rank") >= 3).alias("errors"), F.count_if(F.col("sev_rank") == 2).alias("warnings")).orderBy(F.desc("issues"), "path").limit(n)


def html_report(issues: DataFrame, title: str = "Report", n: int = 20) -> str:
    """A page of its own with totals and the files with most issues."""
    total = issues.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sev_rank") >= 3).alias("e")).first()
    rows = "".join(f"<tr><td>{html.escape(r['path'])}</td><td>{r['issues']}</td><td>{r['errors']}</td><td>{r['warnings']}</td></tr>" for r in file_breakdown(issues, n).collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{total['n']} issues, {total['e']} errors</p><table><tr><th>File</th><th>Issues</th><th>Errors</th><th>Warnings</th></tr>{rows}</table></body></html>"


def markdown_report(issues: DataFrame, title: str = "Report", n: int = 20) -> str:
    rows = "\n".join(f"| {r['path']} | {r['issues']} | {r['errors']} | {r['warnings']} |" for r in file_breakdown(issues, n).collect())
    return f"# {title}\n\n| File | Issues | Errors | Warnings |\n|-|-|-|-|\n{rows}\n"


def text_dashboard(score: float, issues: DataFrame, n: int = 5) -> str:
    """Health with a word for it (good from 80, fair from 60) and the worst files."""
    word = "good" if score >= 80 else "fair" if score >= 60 else "poor"
    return "\n".join([f"health {score:.0f} ({word})", *[f"{r['path']}: {r['issues']} issues" for r in file_breakdown(issues, n).collect()]])


def write_snapshot(metrics: DataFrame, path: str) -> None:
    """Append one snapshot of metrics (with ``ts``), in a folder for each day."""
    metrics.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def artifacts(issues: DataFrame) -> DataFrame:
    """(uri): distinct non-empty paths with forward slashes."""
    return issues.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri")).where("uri != ''").distinct()


def json_lines(rows: DataFrame) -> DataFrame:
    """(text): each row as a JSON object, to be written as text; clone, migration and graph exports are such tables."""
    return rows.select(F.to_json(F.struct("*")).alias("text"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(text): all nodes, all edges and one row of counts as JSON lines, each with its ``part``."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each
    parts = [json_lines(x.select(F.lit(p).alias("part"), "*")) for p, x in (("node", nodes), ("edge", edges), ("stats", counts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sections(issues: DataFrame, title: str, group: str, top: int = 10) -> str:
    """A plain report: totals by severity, then each group with its count and its ``top`` worst rows; for debt, contracts, settings, documentation, leaks and threads alike."""
    by = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
    from pyspark.sql.window import Window as W

    ordered = W.partitionBy(group).orderBy(F.desc("sev_rank"), "path", "line", "id")
    rows = issues.withColumns({"n": F.count(F.lit(1)).over(W.partitionBy(group)), "r": F.row_number().over(ordered)}).where(F.col("r") <= top)
    lines = [title, "=" * len(title), "", *[f"{k}: {by[k]}" for k in sorted(by)]]
    last = None
    for r in rows.select(group, "n", "r", "severity", "path", "line", "message").orderBy(F.desc("n"), group, "r").collect():
        if r[group] != last:
            last = r[group]
            lines += ["", f"{last} ({r['n']})"]
        lines.append(f"  [{r['severity']}] {r['path']}:{r['line']} {r['message']}")
    return "\n".join(lines) + "\n"


def history_chart(snapshots: DataFrame, value: str) -> list[tuple[str, float]]:
    """Points of a trend chart in order of time."""
    return [(str(r["ts"]), r[value]) for r in snapshots.orderBy("ts").select("ts", value).collect()]


def fresh(cache: DataFrame, oldest: str) -> DataFrame:
    """Cache or backup rows (``at``) not older than ``oldest``; null times go."""
    return cache.where(F.col("at") >= F.lit(oldest).cast("timestamp"))


def backup_errors(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(path, error) of backups (path, sha) that are missing or differ."""
    p = present.select("path", F.col("sha").alias("now"))
    j = wanted.join(p, "path", "left")
    return j.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha"), "differs").alias("error")).where("error is not null")
