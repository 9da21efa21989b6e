"""Series over time: trends, regressions, projections, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S


def deltas(series: DataFrame, at: str, metrics: dict[str, bool], key: list[str] | None = None) -> DataFrame:
    """Each row with every metric's change from the row before and its trend; ``metrics`` tells where lower is better."""
    w = W.partitionBy(*(key or [])).orderBy(at)
    out = series
    for m, lower in metrics.items():
        was = F.lag(m).over(w)
        out = out.withColumn(f"{m}_delta", F.col(m) - was).withColumn(f"{m}_trend", F.when(was.isNull(), "Unknown").otherwise(S.trend(was, F.col(m), lower)))
    return out


def halves(series: DataFrame, at: str, value: str, key: str) -> DataFrame:
    """(key, direction): the mean of the later half against that of the earlier, within 5 % stable; under two points unknown."""
    w = W.partitionBy(key)
    r = series.select(key, F.col(value).alias("y"), F.row_number().over(w.orderBy(at)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    early = F.col("i") <= F.floor(F.col("n") / 2)
    per = r.groupBy(key).agg(F.max("n").alias("n"), F.avg(F.when(early, F.col("y"))).alias("a"), F.avg(F.when(~early, F.col("y"))).alias("b"))
    rise = (F.col("b") - F.col("a")) / F.col("a")
    direction = F.when(F.col("n") < 2, "Unknown").when(rise > 0.05, "Increasing").when(rise < -0.05, "Decreasing").otherwise("Stable")
    return per.select(key, F.col("n").alias("points"), F.col("a").alias("first_half"), F.col("b").alias("second_half"), direction.alias("direction"))


def projections(series: DataFrame, at: str, value: str, months: tuple[int, ...] = (1, 3, 6), per_month: int = 4) -> DataFrame:
    """(months, slope, projected): a line by least squares over the points' order, continued, at least 0."""
    r = series.select(F.col(value).cast("double").alias("y"), (F.row_number().over(W.orderBy(at)) - 1).alias("x"))
    fit = r.agg(F.regr_slope("y", "x").alias("slope"), F.max_by("y", "x").alias("last"))
    return fit.select(F.explode(F.array(*map(F.lit, months))).alias("months"), "slope", "last").select("months", "slope", F.greatest(F.lit(0.0), F.col("last") + F.col("slope") * F.col("months") * per_month).alias("projected"))


def churn(commits: DataFrame, n: int = 20, commits_cut: int = 10) -> DataFrame:
    """(path, commits, added, deleted, score, reasons) of files that change much; ``commits``: (path, commit, added, deleted)."""
    per = commits.groupBy("path").agg(F.count_distinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    total = F.col("added") + F.col("deleted")
    reasons = F.concat_ws(", ", F.when(F.col("commits") > 50, "very frequent changes").when(F.col("commits") > 20, "frequent changes"), F.when(total > 5000, "large churn"))
    per = per.withColumn("score", 2.0 * F.col("commits") + total / 100).withColumn("reasons", reasons)
    return per.where(F.col("commits") >= commits_cut).orderBy(F.desc("score"), "path").limit(n)


def regressions(series: DataFrame, at: str, days: int, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, first, last) of metrics that went wrong between the first and last row of the latest ``days``: ``rules`` give 'up' or 'down' and by how much."""
    recent = series.where(F.col(at) >= F.lit(series.agg(F.max(at)).first()[0]) - F.expr(f"INTERVAL {days} DAYS"))
    ends = recent.agg(*[f(m, at).alias(f"{p}_{m}") for m in rules for p, f in (("first", F.min_by), ("last", F.max_by))])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"first_{m}").cast("double").alias("first"), F.col(f"last_{m}").cast("double").alias("last"), F.lit(d == "up").alias("up"), F.lit(float(c)).alias("cut")) for m, (d, c) in rules.items()]
    out = ends.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    worse = F.when(F.col("up"), F.col("last") - F.col("first") > F.col("cut")).otherwise(F.col("first") - F.col("last") > F.col("cut"))
    return out.where(worse).select("metric", "first", "last")


def spread(rows: DataFrame, factors: list[str], outcome: Column, least: int, gap: float = 0.2) -> DataFrame:
    """(factor, low_group, low_rate, high_rate) of two-valued factors whose groups, large enough each, differ by more than ``gap``."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("side")) for f in factors])).alias("x"), outcome.cast("double").alias("y"))
    per = long.groupBy("x.factor", "x.side").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    both = per.groupBy("factor").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("sides"), F.min("rate").alias("low_rate"), F.max("rate").alias("high_rate"), F.min_by("side", F.struct("rate", "side")).alias("low_group"))
    return both.where((F.col("sides") == 2) & (F.col("n") >= least) & (F.col("high_rate") - F.col("low_rate") > gap)).select("factor", "low_group", "low_rate", "high_rate")
