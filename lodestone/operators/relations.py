"""Joins between facts: what is defined and used, changed, coupled, covered, sanitized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def defined_and_used(definitions: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """(key, issue): used but nowhere defined, defined but nowhere used."""
    d, u = definitions.select(key).distinct(), uses.select(key).distinct()
    return u.join(d, key, "left_anti").withColumn("issue", F.lit("Missing")).unionByName(d.join(u, key, "left_anti").withColumn("issue", F.lit("Unused")))


def changes(current: DataFrame, cached: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): new, changed, unchanged or deleted by key and digest."""
    a = current.select(F.col(key).alias("k"), F.col(digest).alias("now"), F.lit(True).alias("here"))
    b = cached.select(F.col(key).alias("j"), F.col(digest).alias("then"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return a.join(b, F.col("k") == F.col("j"), "full_outer").select(F.coalesce("k", "j").alias(key), status.alias("status"))


def coupling(edges: DataFrame) -> DataFrame:
    """(node, ce, ca, instability): distinct nodes that it uses and that use it."""
    e = edges.select("source", "target").distinct()
    ce = e.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("ce"))
    ca = e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("ca"))
    both = ce.join(ca, "node", "full_outer").select("node", F.coalesce("ce", F.lit(0)).alias("ce"), F.coalesce("ca", F.lit(0)).alias("ca"))
    return both.withColumn("instability", F.when(F.col("ce") + F.col("ca") > 0, F.col("ce") / (F.col("ce") + F.col("ca"))).otherwise(0.0))


def reciprocal(pairs: DataFrame, a: str, b: str, within: list[str] | None = None) -> DataFrame:
    """Pairs whose reverse is there as well, once for each direction."""
    keys = within or []
    p = pairs.select(*keys, a, b).distinct()
    back = p.select(*keys, F.col(a).alias(b), F.col(b).alias(a))
    return p.where(F.col(a) != F.col(b)).join(back, [*keys, a, b], "left_semi")


def usage(symbols: DataFrame, references: DataFrame, key: str, low: int = 2) -> DataFrame:
    """(key, uses, status): dead without references, low up to ``low``, else active."""
    n = references.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    uses = F.coalesce("uses", F.lit(0))
    return symbols.select(key).distinct().join(n, key, "left").select(key, uses.alias("uses"), F.when(uses == 0, "dead").when(uses <= low, "low").otherwise("active").alias("status"))


def between(sources: DataFrame, middles: DataFrame, sinks: DataFrame, key: str, at: str) -> DataFrame:
    """Pairs of a source and the next sink of its key, and whether a middle lies strictly between: (key, source_at, sink_at, sanitized).

    One pass over each key's rows in order, not a join of all pairs.
    """
    rows = sources.select(key, at, F.lit(0).alias("kind")).unionByName(middles.select(key, at, F.lit(1).alias("kind"))).unionByName(sinks.select(key, at, F.lit(2).alias("kind")))
    after = W.partitionBy(key).orderBy(at).rangeBetween(W.currentRow + 1, W.unboundedFollowing)
    nxt = lambda k: F.min(F.when(F.col("kind") == k, F.col(at))).over(after)
    found = rows.withColumn("sink_at", nxt(2)).withColumn("middle_at", nxt(1)).where("kind = 0 and sink_at is not null")
    return found.select(key, F.col(at).alias("source_at"), "sink_at", F.coalesce(F.col("middle_at") < F.col("sink_at"), F.lit(False)).alias("sanitized"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest ``value`` of its key strictly before it: a union and a window, never a product."""
    rows = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_l")).unionByName(right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_l")))
    before = W.partitionBy(key).orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumn(f"last_{value}", F.max(F.when(F.col("_v").isNotNull(), F.struct(at, "_v"))).over(before)["_v"]).where("_l = 1").drop("_v", "_l")


def covered_by(intervals: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Intervals (key, first, last) of which no point (key, at) lies inside."""
    p = points.select(F.col(key).alias("k"), "at")
    return intervals.join(p, (F.col(key) == F.col("k")) & F.col("at").between(F.col("first"), F.col("last")), "left_anti")


def longest_prefix(rows: DataFrame, keys: DataFrame, name: str, key: str) -> DataFrame:
    """Each row with the longest of ``keys`` that its name begins with, without regard to case.

    Names are cut to every length that a key has, so the join is on equality.
    """
    k = keys.select(F.lower(key).alias("_k"), F.col(key).alias("matched")).distinct()
    lengths = [r[0] for r in k.select(F.length("_k")).distinct().collect()]  # as many as keys' lengths differ
    cut = rows.withColumn("_k", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.lower(name), F.lit(1), n)))))
    best = cut.join(k, "_k").groupBy(name).agg(F.max_by("matched", F.struct(F.length("_k"), "_k")).alias("matched"))
    return rows.join(best, name, "left")


def best_of(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Columns of each key's row with the greatest ``order``, without a sort."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def unlocked_writes(writes: DataFrame, locks: DataFrame, field: str, method: str) -> DataFrame:
    """Fields that more than one method writes and none locks."""
    many = writes.groupBy(field).agg(F.count_distinct(method).alias("writers")).where("writers > 1")
    return many.join(locks.select(field).distinct(), field, "left_anti")


def member_changes(old: DataFrame, new: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, change): Added, Removed or Modified members by signature."""
    a = old.select(F.col(key).alias("a"), F.col(kind).alias("was"))
    b = new.select(F.col(key).alias("b"), F.col(kind).alias("now"))
    change = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").otherwise("Modified")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a is null or b is null or was != now").select(F.coalesce("a", "b").alias(key), change.alias("change"))
