"""Near-duplicate documents by a blocked sparse product of the document by n-gram incidence matrix.

``A`` has a row per class of documents with the same set of n-grams and a
column per n-gram. Two classes link when the entry of ``A·Aᵀ`` (the overlap)
reaches the bound that follows from both sizes. The product is never made
whole:

1. Columns are dealt into blocks by hash. Each block accumulates, per class,
   how many of its n-grams any other class has. A class whose total is below
   3/4 of its size can't reach the bound with any partner and goes.
2. Of the rest, each row is multiplied with a few pivot rows: for some minimum
   hashes, the class of the group with the fewest n-grams of its own.
3. Columns in order of rarity; by the size bounds, linked rows share a column
   among their first ``n - ceil(3n/4) + 1``. For columns whose rows are not
   yet all in one component, the rows outside the largest component are
   multiplied with all others that pass the size and position bounds.

Steps 2 and 3 count overlaps in blocks of columns and drop a pair as soon as
what is left can't reach its bound. After step 3 no link between different
components is left out, so the components are exact; only pairs that would
link a component with itself are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, flat, lean, lean_groups, mix, pieces, range_hashes, small, store, text_key

WORDS = 5
#: Text bytes that are hashed at a time, n-grams in a block of columns, and classes whose totals are summed at once.
CHUNK_BYTES, BLOCK_NGRAMS, RANGE_CLASSES = 2 << 20, 1_500_000, 16_384
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0xD1342543DE82EF95)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, sorted within the row, and row offsets into them.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A row of fewer
    than ``words`` words has its whole sequence as one; without words, none.
    """
    rows = len(offsets) - 1
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    word = range_hashes(data, start, end)
    first = np.searchsorted(start, offsets)  # of each row's words
    count = np.diff(first)
    n = len(word)
    gram = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words if len(gram) else 0):
        gram = gram * ODD + word[k : n - words + 1 + k]
    gram = mix(gram)
    per_row = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(out_offsets[-1], np.uint64)
    for i in range(rows):
        a, b = out_offsets[i], out_offsets[i + 1]
        if count[i] >= words:
            out[a:b] = gram[first[i] : first[i] + b - a]
            out[a:b].sort()
        elif a < b:
            h = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for w in word[first[i] : first[i + 1]]:
                    h = h * ODD + w
            out[a] = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_offsets[:-1][per_row > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[out_offsets]


def _sums(grams: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each row's hashes."""
    out = []
    for own in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(own + salt)))])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _each(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = flat(batch.column(text))
        for i, j in pieces(offsets, CHUNK_BYTES):
            yield batch.slice(i, j - i), *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _signed(salt: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams, at in _each(batches):
            a, b = _sums(grams, at, salt)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(a), pa.array(b), *rows.columns[2:]], ["doc_id", "n", "node", "check", *rows.schema.names[2:]])

    return sign


def _sets(salt: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams, at in _each(batches):
            grams_list = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_sums(grams, at, salt)[0]), pa.array(np.diff(at)), grams_list.cast(pa.list_(pa.int64()))], ["node", "n", "grams"])

    return gather


def _blocks(blocks: int, salt: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, at in _each(batches):
            names = _sums(grams, at, salt)[0]
            node, once = np.unique(names, return_index=True)
            size = np.diff(at)
            chosen = np.sort(once[size[once] > 0])
            mask = np.zeros(len(size), bool)
            mask[chosen] = True
            mask = np.repeat(mask, size)
            row = np.repeat(np.arange(len(size)), size)[mask]
            h, nodes = grams[mask], names
            block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.uint16 if blocks <= 65536 else np.int64)
            order = np.argsort(block, kind="stable")
            block, row, key = block[order], row[order], (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
            found, first = np.unique(block, return_index=True)
            ends = np.append(first[1:], len(block))
            out = []
            for b, i, j in zip(found.tolist(), first.tolist(), ends.tolist()):
                r = row[i:j]
                runs = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                out.append((b, nodes[r[runs]].tobytes(), np.diff(np.append(runs, len(r))).astype(np.uint32).tobytes(), key[i:j].tobytes()))
            if out:
                b, n, c, k = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.binary()), pa.array(c, pa.binary()), pa.array(k, pa.binary())], ["block", "nodes", "counts", "keys"])

    return deal


def _shared(ranges: int):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        """Per class, how many of its n-grams in one block of columns some other class has as well; packed by range of classes."""
        nodes = np.concatenate([np.frombuffer(x, np.int64) for x in group["nodes"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]])
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
        uniq, index = np.unique(nodes, return_inverse=True)
        pair = np.unique((keys.astype(np.uint64) << np.uint64(32)) | np.repeat(index, counts).astype(np.uint64))
        key = pair >> np.uint64(32)
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        hit = same[1:] | same[:-1]
        total = np.bincount((pair[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(uniq))
        uniq, total = uniq[total > 0], total[total > 0].astype(np.uint32)
        part = ((uniq.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        split = np.split(order, first[1:]) if len(found) else []
        return pd.DataFrame({"part": found, "nodes": [uniq[x].tobytes() for x in split], "counts": [total[x].tobytes() for x in split]})

    return count


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in group["nodes"]])
    uniq, index = np.unique(nodes, return_inverse=True)
    return pd.DataFrame({"node": uniq, "shared": np.bincount(index, np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]])).astype(np.int64)})


def overlap(a: np.ndarray, b: np.ndarray, least: int, block: int = 4096) -> int:
    """|a ∩ b| of two sorted rows, block of columns by block; -1 as soon as ``least`` is out of reach."""
    total = i = j = 0
    while i < len(a) and j < len(b):
        if total + min(len(a) - i, len(b) - j) < least:
            return -1
        top = min(a[min(i + block, len(a)) - 1], b[min(j + block, len(b)) - 1])
        x, y = int(np.searchsorted(a, top, "right")), int(np.searchsorted(b, top, "right"))
        both = np.concatenate([a[i:x], b[j:y]])
        both.sort()
        total += int(np.count_nonzero(both[1:] == both[:-1]))
        i, j = x, y
    return total if total >= least else -1


def _product(percent: int):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ga, oa), (gb, ob) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = []
            for k in range(len(u)):
                a, b = ga[oa[k] : oa[k + 1]], gb[ob[k] : ob[k + 1]]
                least = -(-percent * (len(a) + len(b)) // (100 + percent))
                keep.append(overlap(a, b, least) >= 0)
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return multiply


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose overlap reaches the bound."""
    a = sets.select(F.col("node").alias("u"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("v"), F.col("grams").alias("gb"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", F.array_sort("ga").alias("ga"), F.array_sort("gb").alias("gb")).mapInArrow(lean(_product(percent)), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node on an edge (u, v): the least node that it reaches.

    Each round takes the least label among neighbours, then the label of that
    label; every round is written out, so lost executors cost one round.
    """
    both = store(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
        step = store(step.join(jump, "comp").select("node", "was", F.least("comp", "c").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.where("was != comp").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, the least id that links reach.

    Null or empty text and text without words: no n-grams, linked with nothing,
    ``component_id`` is its own id. Rows with one set of n-grams, repeated rows
    and repeated ids among them, are one class. A null id stays null and is
    passed over by the minimum. Other columns are ignored. An empty table
    gives an empty result. With ``keyed``, ``key`` identifies the row's id and
    text and ``comp`` its component, null without words.
    """
    bounded(docs.sparkSession)
    keys = [text_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    salt, clash = 0, True
    while clash:  # until every class has a name of its own, which at once is all but certain
        rows = store(docs.mapInArrow(lean(_signed(salt)), "doc_id long, n long, node long, check long" + ", key binary" * keyed), "rows")
        classes = store(rows.where("n > 0").groupBy("node", "check", "n").agg(F.min("doc_id").alias("rep"), F.max(F.col("doc_id").isNull().cast("int")).alias("odd")), "classes")
        clash = classes.groupBy("node").count().where("count > 1").limit(1).count() > 0
        salt += clash
    docs = docs.drop("key")
    total, many = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks, ranges = max(16, -(-total // BLOCK_NGRAMS)), max(1, -(-many // RANGE_CLASSES))

    shared = docs.mapInArrow(lean(_blocks(blocks, salt)), "block long, nodes binary, counts binary, keys binary").groupBy("block").applyInPandas(lean_groups(_shared(ranges)), "part long, nodes binary, counts binary").groupBy("part").applyInPandas(lean_groups(_totals), "node long, shared long")
    alive = store(classes.join(shared, "node").where(100 * F.col("shared") >= percent * F.col("n")).select("node", "rep"), "alive")

    chosen = docs.join(small(alive.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi") if not alive.where("rep is null").limit(1).count() else docs
    sets = chosen.mapInArrow(lean(_sets(salt)), "node long, n long, grams array<long>").where("n > 0").join(small(alive.select("node")), "node", "left_semi")
    sets = store(sets.dropDuplicates(["node"]), "sets")

    post = sets.select("node", "n", F.explode("grams").alias("h"))
    common = post.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    post = post.join(common, "h")
    post = store(post, "postings")
    mixes = [F.col("h"), F.xxhash64("h"), F.xxhash64("h", F.lit(1))]
    nodes = post.groupBy("node").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("s"), F.array(*map(F.min, mixes)).alias("keys"))
    nodes = store(nodes.where(100 * F.col("s") >= percent * F.col("n")), "nodes")

    hashed = nodes.select("node", "n", "s", F.posexplode("keys").alias("i", "k"))
    pivots = hashed.groupBy("i", "k").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("own"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("s").alias("t"))).alias("p"))
    pairs = hashed.join(pivots, ["i", "k"]).select(F.col("node").alias("u"), "n", "s", "p.v", "p.m", "p.t").where("u != v")
    pairs = pairs.where(_bounds(percent)).select("u", "v").distinct()
    first = store(linked(pairs, sets, percent), "links")
    labels = components(first)

    ranked = post.join(nodes.select("node", "s"), "node").withColumn("at", F.col("n") - F.col("s") + F.row_number().over(W.partitionBy("node").orderBy("df", "h")))
    prefix = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = prefix.join(labels, "node", "left").select("h", "node", "n", "s", "at", F.coalesce("comp", "node").alias("comp"))
    prefix = store(prefix, "prefix")
    split = prefix.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("h")
    mixed = store(prefix.join(split, "h", "left_semi"), "mixed")
    largest = mixed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "comp")).alias("top")).select("h", F.col("top.comp").alias("top"))
    few = mixed.join(largest, "h").where("comp != top").select("h", F.col("node").alias("u"), "n", "s", "at", F.col("comp").alias("cu"), "top")
    rest = mixed.select("h", F.col("node").alias("v"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("at").alias("to"), F.col("comp").alias("cv"))
    left = few.join(rest, "h").where((F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("top")) | (F.col("u") < F.col("v")))).where(_bounds(percent))
    left = left.where((100 + percent) * (1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))) >= percent * (F.col("n") + F.col("m")))
    second = store(linked(left.select("u", "v").distinct(), sets, percent), "links")
    if second.limit(1).count():
        labels = components(first.unionByName(second))

    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    out = rows.join(named, (rows["node"] == named["node"]) & (rows["n"] > 0), "left")
    more = [rows["key"], named["comp"]] if keyed else []
    return out.select(rows["doc_id"], rows["n"].alias("n_shingles"), F.when(rows["n"] > 0, named["component_id"]).otherwise(rows["doc_id"]).alias("component_id"), *more)


def _bounds(percent: int):
    """Of a pair with sizes n, m and shared n-grams s, t: whether its overlap can reach the bound."""
    n, m, s, t = map(F.col, "nmst")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(s, t) >= percent * (n + m))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""
