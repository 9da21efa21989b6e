"""Issue tables: summaries, hotspots, deduplication, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S

RANK = {"Critical": 4, "Error": 3, "Warning": 2, "Note": 1}


def rank(severity: Column) -> Column:
    return S.choose(severity, RANK, 0)


def is_security(category: Column, cwe: Column) -> Column:
    return category.contains("Security") | cwe.isNotNull()


def summary(issues: DataFrame) -> DataFrame:
    """Counts by category, rule, file and in all, in one pass by grouping sets: (dimension, value, issues, errors, warnings, infos, security, quality_score, security_score)."""
    r = F.col("sev_rank")
    sets = [[F.col("category")], [F.col("rule_id")], [F.col("path")], []]
    keys = [F.col("category"), F.col("rule_id"), F.col("path")]
    out = issues.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("issues"),
        F.count_if(r >= 3).alias("errors"),
        F.count_if(r == 2).alias("warnings"),
        F.count_if(r <= 1).alias("infos"),
        F.count_if(is_security(F.col("category"), F.col("cwe"))).alias("security"),
    )
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "rule").when(F.col("g") == 6, "file").otherwise("all")
    value = F.coalesce(F.when(F.col("g") == 3, F.col("category")).when(F.col("g") == 5, F.col("rule_id")).when(F.col("g") == 6, F.col("path")), F.lit(""))
    return out.select(name.alias("dimension"), value.alias("value"), "issues", "errors", "warnings", "infos", "security", S.quality_score(F.col("errors"), F.col("warnings"), F.col("infos")).alias("quality_score"), S.security_score(F.col("security")).alias("security_score"))


def severity_table(rows: DataFrame, severity: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """A column for each of ``values``, 0 where there is none."""
    counts = [F.count_if(F.col(severity) == v).alias(v.lower().replace(" ", "_").replace("-", "_")) for v in values]
    return rows.groupBy(*(by or [])).agg(*counts)


def hotspots(issues: DataFrame, n: int = 10) -> DataFrame:
    """Files with the most errors, then issues, then by name."""
    per = issues.groupBy("path").agg(F.count_if(F.col("sev_rank") >= 3).alias("severe"), F.count(F.lit(1)).alias("issues"))
    return per.orderBy(F.desc("severe"), F.desc("issues"), "path").limit(n)


def worst_of(issues: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One issue for each key: the most severe, of equals the first."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sev_rank"), *order))
    return issues.withColumn("_at", at).where("_at = 1").drop("_at")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def minority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows counted by value against their group's most frequent value: (group, value, n, dominant, share)."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(group)
    first = F.first(value).over(w.orderBy(F.desc("n"), value).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return n.select(group, value, "n", first.alias("dominant"), (F.col("n") / F.sum("n").over(w)).alias("share")).where(F.col(value) != F.col("dominant"))


def filtered(issues: DataFrame, severities: list[str] | None = None, categories: list[str] | None = None, path: str = "", text: str = "", least: int = 0) -> DataFrame:
    """All conditions that are given, without regard to case; an empty one filters nothing."""
    if severities:
        issues = issues.where(F.upper("severity").isin([s.upper() for s in severities]))
    if categories:
        issues = issues.where(F.upper("category").isin([s.upper() for s in categories]))
    if path:
        issues = issues.where(F.contains(F.lower("path"), F.lit(path.lower())))
    if text:
        low = [F.contains(F.lower(c), F.lit(text.lower())) for c in ("message", "path", "rule_id")]
        issues = issues.where(low[0] | low[1] | low[2])
    return issues.where(F.col("sev_rank") >= least) if least else issues


def repeated_values(facts: DataFrame, value: str, least: int, warn: int = 5) -> DataFrame:
    """Values that occur often enough: (value, n, first place, severity)."""
    per = facts.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct("path", "line")).alias("path"), F.min(F.struct("path", "line"))["line"].alias("line"))
    return per.where(F.col("n") >= least).withColumn("severity", F.when(F.col("n") >= warn, "Warning").otherwise("Info"))


def clumps(parameters: DataFrame, owner: str, name: str, least: int = 3, n: int = 10) -> DataFrame:
    """The same set of names with at least ``least`` owners: (names, owners), the ``n`` most frequent."""
    sets = parameters.groupBy(owner).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))
    return sets.groupBy("names").agg(F.count(F.lit(1)).alias("owners")).where(F.col("owners") >= least).orderBy(F.desc("owners"), "names").limit(n)
