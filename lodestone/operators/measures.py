"""Measures of methods and files over syntax facts, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of node that each of the complexity measures counts; they differ on purpose.
BASIC = ["If", "While", "For", "Foreach", "Case", "Catch", "Conditional", "And", "Or", "Coalesce"]
WIDE = [*BASIC, "Do", "PatternLabel", "SwitchArm", "ConditionalAccess"]
COARSE = [*BASIC, "Else", "Switch"]
TOKENS = ["If", "While", "For", "Foreach", "Case", "Catch", "Conditional", "ConditionalAccess", "Coalesce", "And", "Or"]
# Kinds that a reader has to keep in mind, deeper ones more.
BRANCHES = ["If", "For", "Foreach", "While", "Do", "Catch", "Switch", "Conditional"]
# Bytes of primitive types.
SIZES = {"byte": 1, "sbyte": 1, "bool": 1, "char": 2, "short": 2, "ushort": 2, "int": 4, "uint": 4, "float": 4, "long": 8, "ulong": 8, "double": 8, "decimal": 16}


def complexities(nodes: DataFrame) -> DataFrame:
    """(path, class, method, basic, wide, coarse, tokens, cognitive, nesting) of each method, all in one pass; a method without branches has 1 in the first four."""
    count = lambda kinds: (F.count_if(F.col("kind").isin(*kinds)) + 1)
    weight = F.when(F.col("kind").isin(*BRANCHES), F.col("depth") + 1).when(F.col("kind") == "Else", 1).otherwise(0)
    deep = F.when(F.col("kind").isin("Block", *BRANCHES), F.col("depth") + 1)
    return nodes.where("method IS NOT NULL").groupBy("path", "class", "method").agg(count(BASIC).alias("basic"), count(WIDE).alias("wide"), count(COARSE).alias("coarse"), count(TOKENS).alias("tokens"), F.sum(weight).alias("cognitive"), F.coalesce(F.max(deep), F.lit(0)).alias("nesting"))


def file_counts(nodes: DataFrame) -> DataFrame:
    """(path, classes, methods, properties, fields) of each file."""
    return nodes.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("Class", "classes"), ("Method", "methods"), ("Property", "properties"), ("Field", "fields"))])


def method_stats(methods: DataFrame, over: int = 10) -> DataFrame:
    """One row (n, mean, greatest, many) of the methods' complexity; ``many`` are over the bound."""
    return methods.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("complexity"), F.lit(0)).alias("greatest"), F.count_if(F.col("complexity") > over).alias("many"))


def top_methods(methods: DataFrame, n: int = 10) -> DataFrame:
    return methods.orderBy(F.desc("complexity"), "path", "method").limit(n)


def totals(*facts: DataFrame) -> DataFrame:
    """One row out of one-row results."""
    out = facts[0]
    for f in facts[1:]:
        out = out.crossJoin(F.broadcast(f))  # one row each
    return out


def quality(complexity: Column, parameters: Column, nesting: Column, lines: Column, markers: Column, density: Column) -> Column:
    """0 to 100: what is over each bound costs, whole tenths of lines only, and a fair share of comments earns 5."""
    over = lambda v, most, cost: F.greatest(v - most, F.lit(0)) * cost
    part = lambda most, by: F.floor(F.greatest(lines - most, F.lit(0)) / by)
    cost = over(complexity, 10, 3) + over(complexity, 20, 5) + over(parameters, 4, 5) + over(parameters, 7, 10) + over(nesting, 3, 5) + over(nesting, 5, 10) + part(30, 5) + part(100, 3) + part(200, 2) + markers * 5
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost + F.when((density > 0.05) & (density < 0.3), 5).otherwise(0))).cast("int")


def quality_word(score: Column) -> Column:
    out = F.when(score >= 90, "Excellent")
    for cut, word in ((75, "Good"), (60, "Acceptable"), (40, "Needs Improvement"), (20, "Poor")):
        out = out.when(score >= cut, word)
    return out.otherwise("Critical")


def comment_density(comments: Column, lines: Column) -> Column:
    """Comments over lines, 0 without lines."""
    return F.when(lines > 0, comments / lines).otherwise(F.lit(0.0))


def type_size(name: Column, reference: Column, fields: Column) -> Column:
    """Bytes of a value: a primitive's own, 8 of a reference, else 8 for each field and 4 at least."""
    known = F.element_at(F.create_map(*[x for k, v in SIZES.items() for x in (F.lit(k), F.lit(v))]), name)
    return F.coalesce(known, F.when(reference, 8).otherwise(F.greatest(F.lit(4), 8 * fields)))


def update_effort(critical: Column, high: Column, medium: Column, low: Column, majors: Column) -> Column:
    """1 to 10 from open vulnerabilities and packages that are a major version behind."""
    return F.greatest(F.lit(1), F.least(F.lit(10), 4 * critical + 3 * high + 2 * medium + low + majors))


def version_strategy(version: Column) -> Column:
    return F.when(version.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "Date").when(version.rlike("^[0-9]+[.][0-9]+"), "Semantic").when(version.rlike("^v[0-9]+"), "Url").otherwise("Simple")


def major_version(version: Column) -> Column:
    """The number before the first dot, without a leading v; else null."""
    return F.split(F.regexp_replace(version, "^[vV]+", ""), "[.]")[0].try_cast("decimal(18,4)")


def route(controller: Column, action: Column) -> Column:
    """Both templates joined by one slash; an empty one leaves the other."""
    bare = lambda c: F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", ""), F.lit(""))
    return F.concat_ws("/", bare(controller), bare(action))


def length_issue(name: Column, least: int, most: int, exempt: Column) -> Column:
    """``TooShort`` or ``TooLong``, else null; exempt names may be short."""
    return F.when(F.length(name) > most, "TooLong").when((F.length(name) < least) & ~exempt, "TooShort")


def acceptance(rate: Column, test: Column, generated: Column, complexity: Column, nesting: Column) -> Column:
    """The chance that a suggestion is taken, from its pattern's rate and what its place takes off."""
    factor = lambda when, by: F.when(when, by).otherwise(1.0)
    return rate * factor(test, 0.9) * factor(generated, 0.7) * factor(complexity > 15, 0.85) * factor(nesting > 4, 0.9)


def duplicate_bodies(methods: DataFrame) -> DataFrame:
    """(class, body_hash, n): bodies that a class has more than once; rows (class, body_hash)."""
    return methods.where("body_hash IS NOT NULL").groupBy("class", "body_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def prefix_clusters(members: DataFrame, least: int = 2) -> DataFrame:
    """(type, prefix, members, readers, writers) of an interface's members by the verb that their names begin with, of ``least`` and more."""
    reads = F.col("prefix").isin("Get", "Find", "List", "Load", "Read", "Query", "Fetch", "Is", "Has")
    g = members.withColumn("prefix", F.regexp_extract("name", "^([A-Z][a-z]+)", 1)).where("prefix != ''")
    return g.groupBy("type", "prefix").agg(F.count(F.lit(1)).alias("members"), F.count_if(reads).alias("readers"), F.count_if(~reads).alias("writers")).where(F.col("members") >= least)
