"""Repeated 200-byte strings by merging shards' Burrows-Wheeler orders.

Sorting every suffix of a corpus is out of reach, and most suffixes can't be in
a repeat. So each 200-byte string is filed under its anchor, the 32 bytes in it
with the least hash (the last of equals); equal strings have equal anchors at
the same place. Anchors that occur once are dropped with all their strings.

A shard (one chunk of texts) keeps its share of the transform: the suffixes that
begin at its anchors in sorted order, each with the bytes that precede it (a
context). Equal contexts of several shards stay with the first of these. Blocks
of anchors then merge shards:

* Every suffix starts in the run of its anchor. Each round refines the
  interleave of the shards' orders by two more bytes: as a shard's suffixes are
  in order, its (run, bytes) pairs are a sorted list, and the rank of each pair in
  the union of these lists is its new run. No suffix is sorted again. The
  round that splits two neighbours gives their common prefix.
* From the merged order, the preceding bytes lead left (LF steps): a stable
  deal by the preceding byte gives the order of the suffixes one byte earlier.
  At step d, neighbours with one left context and a common prefix of at least
  ``200 - d`` are a repeated interval. Suffixes whose left context is unique
  drop out.

An anchor with very many contexts is split: the strings that begin in a range of
SPLIT places share all but SPLIT - 1 of their bytes, which name a group of its own.

Bytes are compared with bytes; hashes of 64 bits only file them, and what is
taken for equal across shards has one SHA-256. Identical texts are found first,
and one of each goes through the merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, flat, mix, pieces, range_hashes, small, store

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # how far left of its anchor a string may begin
CHUNK_BYTES = 1 << 20
#: Anchors in a block when repeats are counted, contexts in a block that is merged, texts in a range of keys.
BLOCK_ANCHORS, BLOCK_CONTEXTS, RANGE_TEXTS = 250_000, 5_000, 16_384
#: Contexts of an anchor beyond which it is split, and places in one part of it.
HOT_CONTEXTS, SPLIT = 50_000, 8
PAD = 255  # in no UTF-8 text


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of all strings of ``length`` bytes in each text: anchors' places in ``data`` and hashes, and how far left of each its strings begin (least, most)."""
    n, reach = len(data), length - GRAM
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    start = place[place + length <= ends]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    bits = max(28, n.bit_length())
    mask = np.uint64((1 << bits) - 1)
    h = np.full(-(-(n + 1) // (reach + 1)) * (reach + 1) + reach + 1, np.iinfo(np.uint64).max, np.uint64)
    gram = place[: max(0, n - GRAM + 1)]
    h[: len(gram)] = range_hashes(data, gram, gram + GRAM)
    full = h[: len(gram)].copy()
    h[: len(gram)] = (full & ~mask) | (mask - gram.astype(np.uint64))
    rows = h.reshape(-1, reach + 1)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[start], before[start + reach])
    at = (mask - (least & mask)).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(run[1:], len(at)) - 1
    at = at[run]
    return at, full[at], at - start[last], at - start[run]


def _counted(blocks: int):
    """(block, keys, hashes, fields): the anchors of each text, dealt into blocks by hash.

    Anchors are least hashes, so nearly all are small: they are mixed again before they are dealt.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in pieces(offsets, CHUNK_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                at, h, lo, hi = anchors(data[offsets[i] : offsets[j]], own)
                text = np.searchsorted(own, at, "right") - 1
                fields = np.stack([at - own[text], lo, hi], 1).astype(np.int32)
                block = (mix(h) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
                order = np.argsort(block, kind="stable")
                found, first = np.unique(block[order], return_index=True)
                for b, x in zip(found.tolist(), np.split(order, first[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64())] + [pa.array([y.tobytes()], pa.binary()) for y in (keys[i:j][text[x]], h[x], fields[x])], ["block", "keys", "hashes", "fields"])

    return deal


def _repeated(ranges: int):
    def keep(group: pd.DataFrame) -> pd.DataFrame:
        """Anchors of one block that occur more than once, packed by range of texts."""
        keys, h = (np.concatenate([np.frombuffer(x, t) for x in group[c]]) for c, t in (("keys", np.int64), ("hashes", np.uint64)))
        fields = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in group["fields"]])
        order = np.argsort(h)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        x = order[same[1:] | same[:-1]]
        part = ((keys[x].view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        x = x[np.argsort(part, kind="stable")]
        found, first = np.unique(np.sort(part), return_index=True)
        split = np.split(x, first[1:]) if len(found) else []
        return pd.DataFrame({"part": found, "keys": [keys[y].tobytes() for y in split], "fields": [fields[y].tobytes() for y in split]})

    return keep


def _by_text(group: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in group["keys"]])
    fields = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in group["fields"]])
    order = np.lexsort((fields[:, 0], keys))
    found, first = np.unique(keys[order], return_index=True)
    return pd.DataFrame({"key": found, "anchors": [fields[x].tobytes() for x in np.split(order, first[1:])]})


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one length, as a column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's distinct contexts in the order of (anchor, suffix), and where they occur."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = flat(batch.column(1))
        keys = batch.column(0).to_numpy()
        fields_data, fields_at = flat(batch.column(2))
        for i, j in pieces(offsets, CHUNK_BYTES):
            own = data[offsets[i] : offsets[j]]
            fields = np.frombuffer(fields_data[fields_at[i] : fields_at[j]].tobytes(), np.int32).reshape(-1, 3).astype(np.int64)
            text = np.repeat(np.arange(j - i), np.diff(fields_at[i : j + 1]) // 12)
            at = fields[:, 0] + (offsets[i:j] - offsets[i])[text]
            lo, hi = fields[:, 1], fields[:, 2]
            gram = range_hashes(own, at, at + GRAM)
            cols = np.arange(LENGTH)
            right = np.where(cols < (LENGTH - lo)[:, None], own[np.minimum(at[:, None] + cols, len(own) - 1)], PAD).astype(np.uint8)
            cols = np.arange(REACH)
            left = np.where(cols < hi[:, None], own[np.maximum(at[:, None] - 1 - cols, 0)], PAD).astype(np.uint8)
            whole = range_hashes(own, at - hi, at + LENGTH - lo) ^ (lo * 256 + hi).astype(np.uint64)
            _, once, inverse = np.unique(whole, return_index=True, return_inverse=True)
            same = once[inverse]
            if (right != right[same]).any() or (left != left[same]).any() or (lo != lo[same]).any() or (hi != hi[same]).any():
                once = inverse = np.arange(len(at))  # two contexts with one hash: keep all apart
            right, left, lo, hi, h = right[once], left[once], lo[once], hi[once], gram[once].view(np.int64)
            words = right.view(">u8").astype(np.uint64)
            order = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)] + [h])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            seen = rank[inverse]
            by = np.argsort(seen, kind="stable")
            times = np.bincount(seen, minlength=len(order))
            right, left, lo, hi = right[order], left[order], lo[order], hi[order]
            bounds = np.stack([lo, hi], 1).astype(np.uint8)
            names = np.frombuffer(b"".join(hashlib.sha256(x.tobytes()).digest() for x in np.concatenate([bounds, right, left], 1)), np.uint8).reshape(-1, 32)
            columns = [_binary(names), pa.array(np.full(len(order), part << 32 | made)), pa.array(np.arange(len(order))), pa.array(h[order]), pa.array(lo), pa.array(hi), _binary(right), _binary(left), pa.array(times), _ragged(keys[i:j][text[by]], times), _ragged(fields[by, 0].astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays(columns, NAMES)
            made += 1


NAMES = ["context", "shard", "rank", "h", "lo", "hi", "right", "left", "times", "keys", "places"]
CONTEXTS = ", ".join(f"{c} {'binary' if c in ('context', 'right', 'left', 'keys', 'places') else 'long'}" for c in NAMES)


def interleave(shard: np.ndarray, h: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all shards' suffixes by (anchor, bytes), and each one's common prefix with the one before it.

    Entries come shard after shard, in order of (anchor, bytes) in each.
    """
    n, starts = len(h), np.concatenate([[True], shard[1:] != shard[:-1]])
    union, run = np.unique(h, return_inverse=True)
    common = np.zeros(len(union), np.int64)  # of each run with the one before
    pairs = right.view(">u2").astype(np.int64)
    for k in range(pairs.shape[1]):
        if len(union) == n:
            break
        key = run << 16 | pairs[:, k]
        head = starts.copy()
        head[1:] |= key[1:] != key[:-1]
        union, new = np.unique(key[head], return_inverse=True)
        run = new[np.cumsum(head) - 1]
        old, differ = union >> 16, (union[1:] ^ union[:-1]) & 0xFFFF
        split = np.concatenate([[False], old[1:] == old[:-1]])
        common = np.where(split, 2 * k + np.concatenate([[0], differ < 256]), common[old])
    first = np.bincount(run, minlength=len(common)).cumsum() - np.bincount(run, minlength=len(common))
    order = np.argsort(run, kind="stable")  # a deal by rank: shards one after another in a run
    out = np.full(n, LENGTH)
    out[first] = common
    return order, out


def repeats(shard: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: np.ndarray, left: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry, how far left of its anchor repeated strings begin: least and most (-1: none)."""
    n = len(h)
    order, common = interleave(shard, h, right)
    lo, hi, left, reach = lo[order].astype(np.int64), hi[order].astype(np.int64), left[order], (LENGTH - lo[order].astype(np.int64))
    common[1:] = np.minimum(common[1:], np.minimum(reach[1:], reach[:-1]))
    least, most = np.full(n, LENGTH), np.full(n, -1)
    twice = times[order] > 1
    least[twice], most[twice] = lo[twice], hi[twice]
    cur = np.arange(n)  # ranks in the merged order, grouped by left context, in order inside a group
    group = np.cumsum(np.concatenate([[True], h[order][1:] != h[order][:-1]])) - 1
    for d in range(REACH + 1):
        alone = np.bincount(group)[group] == 1
        stay = ~alone & (hi[cur] >= d)
        cur, group = cur[stay], group[stay]
        if not len(cur):
            break
        here = lo[cur] <= d
        x, g = cur[here], group[here]
        if len(x) > 1:
            interval = np.cumsum(common < LENGTH - d)
            same = (g[1:] == g[:-1]) & (interval[x[1:]] == interval[x[:-1]])
            hit = x[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            least[hit], most[hit] = np.minimum(least[hit], d), np.maximum(most[hit], d)
        further = hi[cur] > d
        cur, group = cur[further], group[further]
        if len(cur) and d < REACH:
            key = group * 256 + left[cur, d]
            deal = np.argsort(key, kind="stable")
            cur, key = cur[deal], key[deal]
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    out = np.empty((2, n), np.int64)
    out[0, order], out[1, order] = least, most
    return out[0], out[1]


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """(context, least, most) of the contexts that one block of anchors shows to have repeated strings."""
    shard, rank, h, lo, hi, times = (group[c].to_numpy() for c in ("shard", "rank", "h", "lo", "hi", "times"))
    order = np.lexsort((rank, h, shard))
    right, left = (np.frombuffer(b"".join(group[c].iloc[order]), np.uint8).reshape(-1, w) for c, w in (("right", LENGTH), ("left", REACH)))
    least, most = repeats(shard[order], h[order], lo[order], hi[order], right, left, times[order])
    found = most >= 0
    return pd.DataFrame({"context": group["context"].iloc[order[found]].to_numpy(), "least": least[found], "most": most[found]})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, last) of every occurrence of contexts (least, most, keys, places)."""
    for batch in batches:
        least, most = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        (keys, at), (places, _) = flat(batch.column(2)), flat(batch.column(3))
        keys, places, times = np.frombuffer(keys.tobytes(), np.int64), np.frombuffer(places.tobytes(), np.int32).astype(np.int64), np.diff(at) // 8
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places - np.repeat(most, times)), pa.array(places - np.repeat(least, times) + LENGTH)], ["key", "first", "last"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        out = []
        for k, spans in enumerate(batch.column(2)):
            text = data[offsets[k] : offsets[k + 1]]
            mark = np.zeros(len(text) + 1, np.int32)
            s = np.array([(x["first"], x["last"]) for x in spans.as_py()])
            np.add.at(mark, s[:, 0], 1)
            np.add.at(mark, s[:, 1], -1)
            gone = np.cumsum(mark[:-1]) > 0
            kept = text[~gone].tobytes()
            out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in zip(*out)]], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` if asked for).

    A byte goes if a 200-byte string over it also begins anywhere else, in this
    text or another row's. Null text is empty; texts under 200 bytes, and empty
    tables, lose nothing; repeated rows are copies of each other; null and
    repeated ids are like any other. ``kept`` has the remaining bytes as text,
    with a replacement where a cut splits a character. Other columns are ignored.
    """
    bounded(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    salt, clash = 0, True
    while clash:  # until every text has a key of its own, which at once is all but certain
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, *([F.lit(salt)] if salt else [])).alias("key"))
        rows = store(own.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "rows")
        copies = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), (F.min("sha") != F.max("sha")).alias("clash")).where("n > 1"), "copies")
        clash = copies.where("clash").limit(1).count() > 0
        salt += clash
    docs, copies = own, copies.select("key", "rep")
    once = docs.where(F.octet_length("text") >= LENGTH).join(small(copies), "key", "left").where(F.col("rep").isNull() | F.col("rep").eqNullSafe(F.col("doc_id"))).select("key", "text")

    total, many = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    blocks, ranges = max(8, -(-total // (90 * BLOCK_ANCHORS))), max(1, -(-many // RANGE_TEXTS))
    counted = once.mapInArrow(_counted(blocks), "block long, keys binary, hashes binary, fields binary")
    found = counted.groupBy("block").applyInPandas(_repeated(ranges), "part long, keys binary, fields binary")
    anchored = store(found.groupBy("part").applyInPandas(_by_text, "key long, anchors binary"), "anchors")

    likely = once.join(small(anchored.select("key")), "key", "left_semi").join(anchored, "key").select("key", "text", "anchors")
    contexts = store(likely.mapInArrow(_contexts, CONTEXTS), "contexts")
    entry = F.min(F.struct("shard", "rank", "h", "lo", "hi", "right", "left")).alias("e")
    distinct = store(contexts.groupBy("context").agg(entry, F.sum("times").alias("times")).select("context", "times", "e.*"), "distinct")
    uses = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("uses"))
    blocks = max(8, -(-distinct.count() // BLOCK_CONTEXTS))
    hot = store(uses.where(F.col("uses") > HOT_CONTEXTS), "hot")
    rest = distinct.join(small(hot), "h", "left").withColumn("w", F.explode(F.when(F.col("uses").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.floor(F.col("lo") / SPLIT).cast("int"), F.floor(F.col("hi") / SPLIT).cast("int")))))
    begin = F.col("w") * SPLIT
    shared = F.xxhash64("h", F.substring(F.col("right"), F.lit(1), LENGTH - SPLIT + 1 - begin), F.substring(F.col("left"), F.lit(1), begin), "w")
    in_part = F.col("w") >= 0
    rest = rest.select("context", "shard", "rank", F.when(in_part, shared).otherwise(F.col("h")).alias("h"), F.when(in_part, F.greatest("lo", begin)).otherwise(F.col("lo")).alias("lo"), F.when(in_part, F.least("hi", begin + SPLIT - 1)).otherwise(F.col("hi")).alias("hi"), "right", "left", "times")
    found = rest.withColumn("block", F.pmod(F.col("h"), F.lit(blocks))).groupBy("block").applyInPandas(_merge, "context binary, least long, most long")
    found = store(found.groupBy("context").agg(F.min("least").alias("least"), F.max("most").alias("most")), "found")
    spans = contexts.select("context", "keys", "places").join(small(found), "context").select("least", "most", "keys", "places").mapInArrow(_spread, "key long, first long, last long")
    spans = store(spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")

    cut = once.join(small(spans.select("key")), "key", "left_semi").join(spans, "key").select("key", "text", "spans")
    cut = cut.mapInArrow(_removed, "key long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = cut if keep_text else cut.drop("kept")
    cut = store(cut.dropDuplicates(["key"]), "cut")
    out = rows.join(small(copies.select("key", F.lit(True).alias("copied"))), "key", "left").join(cut if keep_text else small(cut), "key", "left")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    columns = [
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    if keep_text:
        out = out.join(docs.select("key", "text").dropDuplicates(["key"]), "key", "left")
        columns.append(F.when(whole, F.lit("")).otherwise(F.coalesce("kept", "text")).alias("kept"))
    return out.select("doc_id", "n_bytes", *columns)
