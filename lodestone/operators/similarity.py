"""Clones: normal forms, shingles, MinHash bands, sequence similarity and clone classes.

Equal texts and equal forms are linked to one representative, so such a group
costs as many links as it has members. Different texts that have enough in
common are linked pair by pair, all of them: that is as many links as there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from . import graph as G

FUNCTIONS, BANDS = 100, 20
#: Of a tile of sets that are compared at a time: shingles, and what a set counts besides its own.
TILE, EACH = 50_000, 100


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))


def shingles(toks: Column, n: int = 5) -> Column:
    """Distinct hashes of ``n`` tokens in a row; fewer tokens have none."""

    def of(t: Column) -> Column:  # bound once: inside a lambda an expression would be worked out for every element
        each = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, n), " ")))
        return F.when(F.size(t) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(toks), of), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def signature(functions: int = FUNCTIONS, seed: int = 42):
    """A column function: the least value of each of ``functions`` universal hashes over a set."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(1, 1 << 63, functions, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            x = np.asarray(s, np.int64).view(np.uint64)
            if not len(x):
                out.append([])
                continue
            least = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(x), 4096):  # a long text's shingles in bounded memory
                least = np.minimum(least, (x[i : i + 4096, None] * a + b).min(0))
            out.append((least >> np.uint64(1)).astype(np.int64).tolist())
        return pd.Series(out)

    return sign


def bands(sign: Column, n: int = BANDS, functions: int = FUNCTIONS) -> Column:
    """(band, hash) of each run of a signature; the band is part of the key, so equal runs of different bands don't meet."""
    rows = functions // n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(sign, i * rows + 1, rows)).alias("hash")))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, with one bit for each element of ``a``: long lists take whole words at a time."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & places.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def edit_distance(a: list, b: list, most: int | None = None) -> int:
    """Token edit distance; with ``most`` only a band of that width is filled, and a greater distance is ``most + 1``."""
    if len(a) > len(b):
        a, b = b, a
    width = len(b) if most is None else most
    if len(b) - len(a) > width:
        return width + 1
    big = len(a) + len(b) + 1
    last = {j: j for j in range(min(len(a), width) + 1)}
    for i, y in enumerate(b, 1):
        low, high = max(0, i - width), min(len(a), i + width)
        now = {}
        for j in range(low, high + 1):
            now[j] = i if j == 0 else min(last.get(j, big) + 1, now.get(j - 1, big) + 1, last.get(j - 1, big) + (a[j - 1] != y))
        last = now
    out = last[len(a)]
    return out if most is None else min(out, most + 1)


def diff_lines(old: str, new: str) -> list[str]:
    """Lines of ``new`` against ``old`` on trimmed lines: kept, removed (-) and added (+), by a longest common subsequence."""
    a, b = old.split("\n"), new.split("\n")
    x, y = [s.strip() for s in a], [s.strip() for s in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    n = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            n[i, j] = n[i + 1, j + 1] + 1 if p[i] == q[j] else max(n[i + 1, j], n[i, j + 1])
    out, i, j = ["  " + s for s in a[:head]], 0, 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i] == q[j]:
            out.append("  " + a[head + i])
            i, j = i + 1, j + 1
        elif i < len(p) and (j == len(q) or n[i + 1, j] >= n[i, j + 1]):
            out.append("- " + a[head + i])
            i += 1
        else:
            out.append("+ " + b[head + j])
            j += 1
    return out + ["  " + s for s in a[len(a) - tail :]]


def sequence_similarity(a: Column, b: Column) -> Column:
    """Longest common subsequence over the longer list; 0 if either is empty."""

    @F.pandas_udf("double")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) / max(len(x), len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b)])

    return shared(a, b)


def unified_diff(a: Column, b: Column) -> Column:
    @F.pandas_udf("array<string>")
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_lines(x or "", y or "") for x, y in zip(a, b)])

    return differing(a, b)


def clone_type(exact: Column, normal: Column, shingle: Column, flow: Column) -> Column:
    """Equal texts, equal normal forms, much in common, or the same order of what is done."""
    return F.when(exact, "Type1").when(normal, "Type2").when(shingle >= 0.75, "Type3").when(flow >= 0.70, "Type4").otherwise("None")


def _compared(least: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links between two tiles, or within one, by counting for each set what all others share with it."""
        one, other = group[group["side"] == 0], group[group["side"] == 1]
        if not len(other):
            other = one
        sets, keys, size = other["set"].tolist(), other["key"].to_numpy(), other["n"].to_numpy()
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        out = []
        for key, n, x in zip(one["key"], one["n"], one["set"]):
            low, high = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(row[at], minlength=len(keys))
            score = both / (n + size - both)
            found = (score >= least) & ((keys > key) if other is one else True)
            out.append(pd.DataFrame({"u": key, "v": keys[found], "score": score[found]}))
        return pd.concat(out)

    return compare


def set_links(sets: Callable[[DataFrame], DataFrame], heads: DataFrame, least: float) -> DataFrame:
    """(u, v, score): all pairs of different sets whose Jaccard similarity is at least ``least``.

    ``heads``: (key, n, head) of all sets, ``sets``: a function that gives (key,
    n, set) for a table of keys. Nothing is approximate:

    1. Linked sets share ``need(n)`` shingles, so of the first ``n - need(n) + k``
       in any common order they share ``k``. Sets whose heads have less in common
       with all other heads together than any partner must have, go.
    2. Of the rest, shingles are ordered by rarity; linked sets share one of the
       first ``n - need(n) + 1``.
    3. Sets are dealt into tiles by a least hash. Tiles that share such a shingle
       are compared, each set with each: by tiles and not by pairs, a group of
       copies is moved once for each tile of it and not once for each copy.
    """
    need = _need(F.col("n"), least)
    post = heads.select("key", "n", F.explode("head").alias("h"))
    by = W.partitionBy("h")
    shared = post.withColumn("a", F.min("key").over(by)).withColumn("b", F.max("key").over(by)).where("a != b").select("key", "n", "h")
    alive = shared.groupBy("key", "n").agg(F.count_distinct("h").alias("c")).where(F.col("c") >= _more(need)).select("key")
    sets = G.cut(sets(alive))

    post = sets.select("key", "n", F.explode("set").alias("h")).withColumn("df", F.count(F.lit(1)).over(by)).where("df > 1")
    own = W.partitionBy("key")
    ranked = post.withColumn("at", F.row_number().over(own.orderBy("df", "h"))).withColumn("s", F.count(F.lit(1)).over(own)).withColumn("group", F.min(F.xxhash64("h")).over(own))
    prefix = G.cut(ranked.where((F.col("s") >= need) & (F.col("n") - F.col("s") + F.col("at") <= F.col("n") - need + 1)).select("key", "n", "h", "group"))
    nodes = prefix.select("key", "n", "group").distinct()
    chunk = F.floor((F.sum(F.col("n") + EACH).over(W.partitionBy("group").orderBy("key").rowsBetween(W.unboundedPreceding, 0)) - 1) / TILE)
    tiles = G.cut(nodes.select("key", F.xxhash64("group", chunk).alias("tile")))
    single = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).where("members = 1").select("tile")
    places = G.cut(prefix.join(tiles, "key").select("h", "tile").distinct())
    pairs = places.select("h", F.col("tile").alias("a")).join(places.select("h", F.col("tile").alias("b")), "h").where("a < b").select("a", "b").distinct()
    within = tiles.select("tile").distinct().join(single, "tile", "left_anti").select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    pairs = G.cut(pairs.unionByName(within))
    held = sets.join(tiles, "key")
    sides = pairs.withColumn("tile", F.col("a")).withColumn("side", F.lit(0)).unionByName(pairs.where("a != b").withColumn("tile", F.col("b")).withColumn("side", F.lit(1)))
    return sides.join(held, "tile").select("a", "b", "side", "key", "n", "set").groupBy("a", "b").applyInPandas(_compared(least), "u long, v long, score double")


def _need(n: Column, least: float) -> Column:
    """How many of its ``n`` shingles a set shares with any that it is linked with."""
    return F.ceil(n * least - 1e-9).cast("int")


def _more(n: Column) -> Column:
    """By how many shingles a head is longer than what a set may have for itself."""
    return F.greatest(F.lit(1), F.floor(n / 8).cast("int"))


def clone_links(docs: DataFrame, id_col: str, text_col: str, least: float = 0.75) -> DataFrame:
    """(source, target, type, score): links of fragments.

    Equal texts link to the least id of their group, equal normal forms to the
    least id of theirs, and so do texts with equal sets of shingles but
    different forms. One of each set is linked with every other that reaches
    ``least`` and has a different form (see :func:`set_links`).
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = d.select("id", "text", F.array_sort(shingles(tokens(F.col("text")))).alias("set"))
    n = F.size("set")
    keyed = whole.select("id", F.sha2("text", 256).alias("exact"), F.sha2(X.normal_code(F.col("text")), 256).alias("normal"), F.when(n > 0, F.xxhash64("set")).alias("key"), n.alias("n"), F.slice("set", F.lit(1), F.least(n, n - _need(n, least) + _more(n))).alias("head"))
    keyed = G.cut(keyed)
    exact = keyed.groupBy("exact").agg(F.min("id").alias("source"), F.min("normal").alias("normal"), F.min("key").alias("key"))
    t1 = keyed.join(exact.select("exact", "source"), "exact").where("id != source").select("source", F.col("id").alias("target"), F.lit("Type1").alias("type"), F.lit(1.0).alias("score"))
    normal = exact.groupBy("normal").agg(F.min("source").alias("first"))
    t2 = exact.join(normal, "normal").where("source != first").select(F.col("first").alias("source"), F.col("source").alias("target"), F.lit("Type2").alias("type"), F.lit(1.0).alias("score"))

    first = exact.where("key is not null").groupBy("key").agg(F.min(F.struct("source", "normal")).alias("one")).select("key", F.col("one.source").alias("first"), F.col("one.normal").alias("form"))
    first = G.cut(first)
    equal = exact.join(first, "key").where("source != first and normal != form").select(F.col("first").alias("source"), F.col("source").alias("target"), F.lit(1.0).alias("score"))
    one = first.select("key", F.col("first").alias("id"))

    def sets(alive: DataFrame) -> DataFrame:
        ids = one.join(alive, "key", "left_semi")
        own = d.join(ids.select("id"), "id", "left_semi").select(F.array_sort(shingles(tokens(F.col("text")))).alias("set")).where("size(set) > 0")
        return own.select(F.xxhash64("set").alias("key"), F.size("set").alias("n"), "set").join(alive, "key", "left_semi").dropDuplicates(["key"])

    heads = keyed.join(one, ["key", "id"], "left_semi").select("key", "n", "head")
    found = set_links(sets, heads, least)
    a, b = first.toDF("u", "x", "p"), first.toDF("v", "y", "q")
    near = found.join(a, "u").join(b, "v").where("p != q").select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "score")
    t3 = near.unionByName(equal).select("source", "target", F.lit("Type3").alias("type"), "score")
    return t1.unionByName(t2).unionByName(t3)


def clone_classes(links: DataFrame) -> DataFrame:
    """(node, component) of all fragments that are linked."""
    return G.components(links.select("source", "target"))


def clone_metrics(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per type: links, mean score, share of links, lines of the linked fragments; ``sizes``: (target, lines)."""
    per = links.join(sizes, "target").groupBy("type").agg(F.count(F.lit(1)).alias("links"), F.avg("score").alias("mean_score"), F.sum("lines").alias("lines"))
    total = links.agg(F.count(F.lit(1)).alias("all"))  # one row
    return per.join(F.broadcast(total), F.col("links") <= F.col("all")).select("type", "links", "mean_score", "lines", (F.col("links") / F.col("all")).alias("share"))
