"""Directed graphs as edge tables (source, target): closures, depths, paths, cycles, components.

Every step is a join of the frontier with the edges; rounds are written to the
shared checkpoint folder where one is set, so plans stay small and lost
executors cost a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the cluster's checkpoint folder; without one (tests) the plan is materialised in memory."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").where("source is not null and target is not null and source != target").distinct()


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def reach(edges: DataFrame, seeds: DataFrame, most: int = 1 << 30) -> DataFrame:
    """(root, node, depth): the least number of steps, up to ``most``, from each seed (root) to every node it reaches; roots themselves at 0."""
    e = cut(simple(edges))
    front = seeds.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    seen, depth = cut(front), 0
    front = seen
    while depth < most:
        depth += 1
        step = front.join(e, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth) from the entry points (nodes without incoming edges), all at once; 2147483647 where none reaches."""
    n, e = cut(nodes(edges)), cut(simple(edges))
    front = cut(n.join(e.select(F.col("target").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while front.limit(1).count():
        depth += 1
        step = front.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.unionByName(front))
    return n.join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(2147483647)).alias("depth"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).where("node is not null").distinct()


def ends(edges: DataFrame) -> DataFrame:
    """(node, role): entry without incoming, leaf without outgoing edges."""
    e, n = simple(edges), nodes(edges)
    entry = n.join(e.select(F.col("target").alias("node")), "node", "left_anti").withColumn("role", F.lit("entry"))
    leaf = n.join(e.select(F.col("source").alias("node")), "node", "left_anti").withColumn("role", F.lit("leaf"))
    return entry.unionByName(leaf)


def paths(edges: DataFrame, source: str, target: str, most: int = 10) -> DataFrame:
    """All simple paths of up to ``most`` edges from one node to another; none goes on past its target."""
    e = cut(simple(edges))
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    found = []
    for _ in range(most):
        front = cut(front.join(e, F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path")))
        found.append(front.where(F.col("node") == target).select("path"))
        front = front.where(F.col("node") != target)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row with a shortest path (of equals the least), or none.

    Keeps one path for each node: breadth first, not all paths.
    """
    e = cut(simple(edges))
    seen = edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>")
    front = seen
    while True:
        step = front.join(e, F.col("node") == F.col("source")).groupBy("target").agg(F.min(F.array_append("path", F.col("target"))).alias("path")).select(F.col("target").alias("node"), "path")
        front = cut(step.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(front))
        if seen.where(F.col("node") == target).limit(1).count() or not front.limit(1).count():
            break
    return seen.where(F.col("node") == target)


def cycles(edges: DataFrame, most: int = 10, n: int = 50) -> DataFrame:
    """Distinct simple cycles of at most ``most`` nodes, each begun at its least node: (cycle), the first ``n`` by length and name."""
    e = cut(simple(edges))
    front = e.where("source < target").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    found = []
    for _ in range(most - 1):
        step = front.join(e, F.col("last") == F.col("source"))
        found.append(step.where(F.col("target") == F.col("first")).select("path"))
        front = cut(step.where((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target"))).select("first", F.col("target").alias("last"), F.array_append("path", F.col("target")).alias("path")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length")).distinct().orderBy("length", "cycle").limit(n)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected in either direction."""
    e = simple(edges)
    both = cut(e.unionByName(reversed_(e)).distinct())
    labels = cut(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("target"), F.col("component").alias("c")), "target").groupBy(F.col("source").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("c"))
        step = cut(step.join(jump, "component").select("node", "was", F.least("component", "c").alias("component")))
        labels = step.select("node", "component")
        if not step.where("was != component").limit(1).count():
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    e = simple(edges)
    out = e.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def tainted(assigns: DataFrame, sources: DataFrame) -> DataFrame:
    """(method, variable): the fixpoint of what sources taint. ``assigns``: (method, target, rhs array, bare); a bare identifier on the right doesn't pass taint on."""
    steps = cut(assigns.where("not bare").select("method", "target", F.explode("rhs").alias("variable")).distinct())
    seen = cut(sources.select("method", "variable").distinct())
    front = seen
    while True:
        front = cut(front.join(steps, ["method", "variable"]).select("method", F.col("target").alias("variable")).distinct().join(seen, ["method", "variable"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def cohesion(members: DataFrame, accesses: DataFrame) -> DataFrame:
    """(class, lcom4): connected groups of a class's instance members over (class, method, accessed); an isolated member is a group."""
    node = lambda c: F.concat_ws("\u0001", "class", c)
    m = members.where("not is_static").select("class", node("member").alias("node")).distinct()
    e = accesses.select(node("method").alias("source"), node("accessed").alias("target"))
    known = m.select("node")
    e = e.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    c = components(e)
    return m.join(c, "node", "left").groupBy("class").agg(F.count_distinct(F.coalesce("component", "node")).alias("lcom4"))
