"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target share; a document's expected copies are its source's
target over its source's size. Within a source, documents stand in order of
size; the expected copies are summed along that order in fixed-point numbers,
one offset per source is added, and a document is emitted once per whole number
that its step crosses. As neighbours have like sizes, the words taken stay
within about one document, the largest at most, of the target.

The running sum is made in two levels, blocks of a source and then rows of a
block, and the number of blocks follows the number of rows: no source, however
large, is summed by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small, store, text_key

WORD = "[^\\x20\\x09-\\x0D]+"
#: Fixed-point bits of an expected copy: exact to 1.5e-8, and 4e10 documents a source fit a long.
BITS = 26
#: Rows of one block of the running sum, about.
BLOCK_ROWS = 2048


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target: weights in code point order of sources, repeating, null last.

    Targets share the total size by weight and stop at ``cap`` times their
    source's size; what is over is shared anew until none is above. That is one
    level ``x`` with ``target = min(cap * size, x * weight)``: of the levels that
    follow from stopping the first k sources in order of size over weight, the
    highest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"))
    by_ratio = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size (words), source_size, target, copies (0 to ``cap``), taken (words).

    Null or empty text has size 0 and takes nothing; null sources are one
    source, after all others; repeated rows are taken apart. A null id orders
    as 0. Rows that tie in size and id stand in order of a hash of their text;
    equal rows are interchangeable. Equal inputs and seed give equal results. An
    empty table gives an empty result. Other columns are ignored. With
    ``keyed``, ``key`` identifies id and text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.md5(F.concat(text, F.lit(":"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("string")))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), mark.alias("mark"), *([text_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []))
    sizes = store(sizes, "sizes")
    goal = store(targets(sizes, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\0")))), 1, 6), 16, 10).cast("long") * (1 << (BITS - 24)) + (1 << (BITS - 25))
    goal = goal.withColumn("step", F.floor(rate * (1 << BITS) + 0.5)).withColumn("draw", draw)

    bits = F.length(F.bin("size"))
    rows = sizes.withColumn("class", bits * 4 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0)) & 3"))
    strata = store(rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "strata")
    strata = strata.select(F.col("source").alias("s0"), F.col("class").alias("c0"), F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    rows = rows.join(small(strata), F.col("source").eqNullSafe(F.col("s0")) & (F.col("class") == F.col("c0"))).drop("s0", "c0")
    rows = rows.withColumn("part", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), "parts")).drop("parts")
    goal = goal.withColumnRenamed("source", "s1")
    rows = rows.join(small(goal), F.col("source").eqNullSafe(F.col("s1"))).drop("s1")

    blocks = rows.groupBy("source", "class", "part").agg(F.sum("step").alias("sum"))
    in_source = W.partitionBy("source").orderBy("class", "part").rowsBetween(W.unboundedPreceding, -1)
    blocks = store(blocks.withColumn("base", F.coalesce(F.sum("sum").over(in_source), F.lit(0))).select(F.col("source").alias("s2"), F.col("class").alias("c2"), F.col("part").alias("p2"), "base"), "blocks")
    rows = rows.join(small(blocks), F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")) & (F.col("part") == F.col("p2")))
    in_block = W.partitionBy("source", "class", "part").orderBy("size", "doc_id", "mark").rowsBetween(W.unboundedPreceding, 0)
    kept = ["key"] if keyed else []
    rows = rows.select("doc_id", *kept, "source", "size", "source_size", "target", "step", "draw", (F.col("base") + F.sum("step").over(in_block)).alias("after"))

    crossed = F.shiftright(F.col("after") + F.col("draw"), BITS) - F.shiftright(F.col("after") - F.col("step") + F.col("draw"), BITS)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.least(crossed, F.lit(cap))).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '') || ':' || coalesce(doc_id, 0)) AS mark FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
levels AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM ranked),
goal AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM levels),
steps AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END * 67108864 + 0.5)::BIGINT AS step,
    ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 6))::BIGINT * 4 + 2 AS off FROM goal),
classed AS (SELECT d.*, source_size, target, step, off, length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS class
    FROM d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source),
parted AS (SELECT *, ('0x' || substr(mark, 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY source, class) / 2048.0)::BIGINT AS part FROM classed),
summed AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY class, part, size, doc_id, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS after FROM parted),
taken AS (SELECT *, CASE WHEN size > 0 THEN least((after + off) // 67108864 - (after - step + off) // 67108864, 3) ELSE 0 END AS copies FROM summed)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM taken
"""
