"""Change impact beyond closures: quick risk, predicted errors, importance, files touched; edges (source, target, type, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_factor(change: Column, inheritance: Column) -> Column:
    """What the kind of change adds to its risk: a deletion 10, a new signature 7, three for each heir up to 15."""
    return F.when(change == "Deletion", 10).when(change == "SignatureChange", 7).otherwise(0) + F.least(F.lit(15), 3 * inheritance)


def quick_risk(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, dependents, risk) of (symbol, is_public_api, is_critical) by incoming edges alone; null flags count as false."""
    into = edges.groupBy(F.col("target").alias("symbol")).agg(F.count(F.lit(1)).alias("dependents"))
    s = symbols.join(into, "symbol", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    public, critical = F.coalesce("is_public_api", F.lit(False)), F.coalesce("is_critical", F.lit(False))
    risk = F.when(critical | (public & (F.col("dependents") > 10)), "Critical").when(public | (F.col("dependents") > 5), "High").when(F.col("dependents") > 0, "Medium").otherwise("Low")
    return s.select("symbol", "dependents", risk.alias("risk"))


def deletion_errors(edges: DataFrame, symbol: str) -> DataFrame:
    """(path, source, code): the compiler error that each user of a deleted symbol would have."""
    code = F.when(F.col("type") == "TypeUsage", "CS0246").when(F.col("type") == "Inheritance", "CS0246").when(F.col("type") == "Override", "CS0115").otherwise("CS0103")
    return edges.where(F.col("target") == symbol).select("path", "source", code.alias("code"))


def outgoing(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("source") == symbol)


def importance(methods: DataFrame, calls: DataFrame, depths: DataFrame) -> DataFrame:
    """(method, callers, callees, depth, critical): how a method stands among calls; no depth counts as very deep."""
    into = calls.groupBy(F.col("target").alias("method")).agg(F.count_distinct("source").alias("callers"))
    out = calls.groupBy(F.col("source").alias("method")).agg(F.count_distinct("target").alias("callees"))
    m = methods.select("method").distinct().join(into, "method", "left").join(out, "method", "left").join(depths.select(F.col("node").alias("method"), "depth"), "method", "left")
    depth = F.coalesce("depth", F.lit(2147483647))
    return m.select("method", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), depth.alias("depth"), (depth <= 2).alias("critical"))


def file_edges(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(source, target): files that use what others define; definitions and references are (symbol, path)."""
    d = definitions.select("symbol", F.col("path").alias("target")).distinct()
    return references.select("symbol", F.col("path").alias("source")).distinct().join(d, "symbol").where("source != target").select("source", "target").distinct()


def touched_files(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(root, files): how many files have edges into what each root reaches back to; closure is (root, node)."""
    return closure.join(edges.select(F.col("source").alias("node"), "path").distinct(), "node").groupBy("root").agg(F.count_distinct("path").alias("files"))


def first_direct(closure: DataFrame, direct: DataFrame) -> DataFrame:
    """(package, direct): of each package the first direct one, in input order (place), whose closure (root, node) has it."""
    return closure.join(direct, closure["root"] == direct["package"]).groupBy("node").agg(F.min_by("root", "place").alias("direct")).select(F.col("node").alias("package"), "direct")


def reassigned(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """(method, variable, line, definitions) of uses that more than one definition comes before."""
    d = definitions.select("method", "variable", F.col("line").alias("at"))
    return uses.join(d, ["method", "variable"]).where("at < line").groupBy("method", "variable", "line").agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1")
