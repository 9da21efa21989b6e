"""Token ids in Re-Pair compressed shards.

Documents are range-partitioned by id and encoded in order. About a quarter of
a million ids make a shard: pairs of neighbours become nonterminals, round by
round, until no pair repeats, never across the end of a document. A shard keeps
its rules, how many ids each rule expands to, the remaining symbols and each
document's place among them, so any range of ids in a document is decoded from
the symbols that cover it (:meth:`Shard.ids`).

Shards are binary values of a Parquet table in the shared folder: Spark's
writers commit them once, wherever that folder is, and a retried task can't
leave half a file.

Encoding is exact, not approximate: a text is cut where the tokenizer itself
always cuts (ASCII white space, and in words of Latin letters, digits and ASCII
signs also between its classes of characters), each distinct piece goes through
the tokenizers library once, and ids are joined again. Any other word goes to
the library whole. Pieces are filed under a hash and compared byte by byte with
what is filed; a chunk with a false match, and any tokenizer file with other
rules than these, goes to the library text by text.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, flat, lean, pieces, range_hashes, remembered, small, store

SHARD_IDS = 1 << 18
CHUNK_BYTES = 1 << 18
#: Text bytes of a partition, about; the session's number of shuffle partitions is the least.
PARTITION_BYTES = 256 << 20
#: Distinct pieces that a Python worker remembers; beyond, it starts anew.
PIECES = 1_000_000
#: Pieces that go through the library at once.
BATCH_PIECES = 4096
#: How a tokenizer file must normalize and split for texts to be cut by the rules below.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER, DIGIT, SIGN, ODD, SPACE = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = SIGN
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[39] = ODD  # an apostrophe may begin a contraction
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
#: Second bytes of U+00C0 to U+00FF but for the two signs among these letters.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def cut_by_rules(path: str) -> bool:
    """Whether the tokenizer of this file lower-cases and always cuts where :class:`Encoder` does."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    spaces = [(x["pattern"], x["content"]) for x in steps if x["type"] == "Replace"]
    return (
        [x["type"] for x in steps] == NORMALIZERS
        and spaces == [({"Regex": "\\s+"}, " ")]
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
    )


class Encoder:
    """Bytes of texts to ids, each distinct piece through the library once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_rules = cut_by_rules(path)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.hash, self.begin, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.at, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.bytes, self.filled = np.zeros(1 << 20, np.uint8), 0
        self.slots = [np.full(1 << 21, -1, np.int32) for _ in range(2)]
        self.over = np.zeros(0, np.int64)  # entries without a slot, by hash

    def _slot(self, k: int, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(43)) if k == 0 else (h & np.uint64((1 << 21) - 1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        found = self.slots[0][self._slot(0, h)]
        wrong = np.flatnonzero((found < 0) | (self.hash[found] != h))
        if len(wrong):
            x = h[wrong]
            other = self.slots[1][self._slot(1, x)]
            other[(other >= 0) & (self.hash[other] != x)] = -1
            if len(self.over):
                lost = np.flatnonzero(other < 0)
                at = np.minimum(np.searchsorted(self.hash[self.over], x[lost]), len(self.over) - 1)
                hit = self.hash[self.over[at]] == x[lost]
                other[lost[hit]] = self.over[at[hit]]
            found[wrong] = other
        return found

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        rows = []
        for i in range(0, len(texts), BATCH_PIECES):  # the library's answers are many times as large as the ids in them
            rows += [x.ids for x in self.library.encode_batch([x.decode("utf-8", "replace") for x in texts[i : i + BATCH_PIECES]], add_special_tokens=False)]
        size = np.array([len(x) for x in rows], np.int32)
        flat_ids = np.array([i for x in rows for i in x], np.uint32)
        length = np.array([len(x) for x in texts], np.int64)
        n, used, filled = self.n + len(h), self.used + len(flat_ids), self.filled + int(length.sum())
        while n > len(self.hash):
            self.hash, self.begin, self.size, self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.begin, self.size, self.at, self.length))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while filled > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        new = np.arange(self.n, n, dtype=np.int32)
        self.hash[self.n : n], self.size[self.n : n], self.length[self.n : n] = h, size, length
        self.begin[self.n : n] = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.at[self.n : n] = self.filled + np.concatenate([[0], np.cumsum(length)[:-1]])
        self.ids[self.used : used] = flat_ids
        self.bytes[self.filled : filled] = np.frombuffer(b"".join(texts), np.uint8)
        self.n, self.used, self.filled = n, used, filled
        for k, slots in enumerate(self.slots):
            at = self._slot(k, self.hash[new]).astype(np.int64)
            free = slots[at] < 0
            slots[at[free]] = new[free]
            new = new[slots[at] != new]
        if len(new):
            over = np.concatenate([self.over, new])
            self.over = over[np.argsort(self.hash[over])]

    def _same(self, found: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether every piece has the bytes of the entry found for it."""
        size = end - start
        if (self.length[found] != size).any():
            return False
        total = np.cumsum(size) - size
        ramp = np.arange(int(size.sum()))
        return bool((self.bytes[np.repeat(self.at[found] - total, size) + ramp] == low[np.repeat(start - total, size) + ramp]).all())

    def plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, whole texts through the library."""
        raw = data.tobytes()
        rows = [x.ids for x in self.library.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)]
        return np.array([i for x in rows for i in x], np.uint32), np.array([len(x) for x in rows], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if not self.by_rules:
            return self.plainly(data, offsets)
        kind = CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        kind[1:][(data[:-1] == 60) & (data[1:] == 124)] = ODD  # "<|" begins a special token
        inside = kind != SPACE
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        begin = begin[:-1]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | begin[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begin[1:]
        ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
        odd = np.concatenate([[0], np.cumsum(kind == ODD, dtype=np.int64)])
        whole = odd[we] > odd[ws]
        low = LOWER[data]
        cut = inside.copy()
        cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | begin[1:]
        if whole.any():
            a, b = ws[whole], we[whole]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[a] += 1
            mark[b] -= 1
            mark = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
            low[mark] = data[mark]
            cut &= ~mark
            cut[a] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        end = np.minimum(end, we[np.searchsorted(ws, start, "right") - 1]) if len(ws) else end
        h = range_hashes(low, start, end)
        found = self._find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, once = np.unique(h[missing], return_index=True)
            if self.n + len(new) > PIECES:
                self.clear()
                missing = np.arange(len(h))
                new, once = np.unique(h, return_index=True)
            raw = low.tobytes()
            self._learn(new, [raw[start[i] : end[i]] for i in missing[once].tolist()])
            found[missing] = self._find(h[missing])
        if not self._same(found, low, start, end):
            return self.plainly(data, offsets)
        size = self.size[found].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[found] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, offsets)])


_encoders: dict[str, Encoder] = {}
remembered["token_files"] = _encoders.clear


def encoder(path: str) -> Encoder:
    """One for each Python worker and file, kept between tasks until another operator's begins."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


HASH = np.uint64(0x9E3779B97F4A7C15)


def repair(seq: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Symbols, ends of documents among them, rules (pairs) and rules of each round, when no pair repeats.

    Each round takes the pairs with at least a quarter as many uses as the one
    before asked for, down to two, and replaces their occurrences; of two that
    overlap, that of the more frequent pair. A pair that so falls below two uses
    waits. Rounds for two uses look only at places (``live``) that the round
    before changed or left over: elsewhere no pair repeats.
    """
    rules: list[np.ndarray] = []
    made, bar, live = 0, len(seq), None
    while len(seq) > 1:
        if live is None:
            key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
            h = ((key * HASH) >> np.uint64(46)).astype(np.int64)
            open_ = ~last[:-1]
            count = np.bincount(h[open_], minlength=1 << 18)
            bar = max(2, min(bar, int(count.max())) // 4)
            at = np.flatnonzero((count >= bar)[h] & open_)
            own = key[at]
        else:
            at = live
            own = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        # the same pair over and over, as in a long run of one id: every second
        run = np.ones(len(at), bool)
        run[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        begun = np.flatnonzero(run)
        even = (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % 2 == 0
        odd, at, own = at[~even], at[even], own[even]
        uniq, inverse, uses = np.unique(own, return_inverse=True, return_counts=True)
        often = uses >= bar
        if not often.any():
            if bar == 2:
                break
            continue
        order = np.lexsort((uniq, -uses))
        rank = np.empty(len(uniq), np.int64)
        rank[order] = np.arange(len(order))
        hit = often[inverse]
        held, r = at[hit], rank[inverse[hit]]
        near = held[1:] == held[:-1] + 1
        keep = np.ones(len(held), bool)
        keep[1:] &= ~near | (r[1:] < r[:-1])
        keep[:-1] &= ~near | (r[:-1] <= r[1:])
        at, r = held[keep], r[keep]
        left = np.bincount(r, minlength=len(uniq))
        stays = left[r] > 1
        at, r = at[stays], r[stays]
        chosen = np.flatnonzero(left > 1)
        new = np.full(len(uniq), -1, np.int64)
        new[chosen] = np.arange(len(chosen))
        seq[at] = base + made + new[r]
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if bar == 2:
            near = np.zeros(len(seq), bool)
            near[held] = near[odd] = True
            near = near[stay]
            moved = at - np.arange(len(at))  # places of new symbols afterwards
            near[moved] = True
            near[np.maximum(moved - 1, 0)] = True
        seq, last = seq[stay], last[stay]
        if bar == 2:
            near[-1:] = False
            live = np.flatnonzero(near & ~last)
        pair = uniq[order[chosen]]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(chosen)
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), [len(x) for x in rules]


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first and so on, so that the file's compression finds alike bytes together."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


class Shard:
    """One shard: made by :meth:`pack`, read by :meth:`open`."""

    MAGIC = b"LRP2"

    @staticmethod
    def pack(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
        """Every document has at least one id."""
        base = int(ids.max()) + 1 if len(ids) else 1
        last = np.zeros(len(ids), bool)
        last[np.cumsum(counts) - 1] = True
        seq, last, rules, rounds = repair(ids.astype(np.uint32), last, base)
        size = expand(rules, rounds, base)[1]
        per_doc = np.diff(np.append(-1, np.flatnonzero(last)))
        head = struct.pack("<4sIIIII", Shard.MAGIC, base, len(rules), len(seq), len(doc_ids), len(rounds))
        return b"".join([head, planes(np.array(rounds)), planes(rules.T.reshape(-1)), planes(size), planes(seq), planes(per_doc), planes(counts), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes()])

    def __init__(self, raw: bytes):
        magic, self.base, r, s, d, k = struct.unpack_from("<4sIIIII", raw)
        if magic != self.MAGIC or len(raw) != 24 + 4 * k + 12 * r + 4 * s + 17 * d:
            raise ValueError("not a whole shard")
        at = 24

        def take(n: int) -> np.ndarray:
            nonlocal at
            out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()
            at += 4 * n
            return out

        rounds = take(k)
        self.rules, self.size = take(2 * r).reshape(2, -1).T, take(r)
        self.seq, self.symbols, self.counts = take(s), take(d), take(d)
        self.doc_ids, self.nulls = np.frombuffer(raw, "<i8", d, at), np.frombuffer(raw, np.uint8, d, at + 8 * d)
        self.at = np.concatenate([[0], np.cumsum(self.symbols, dtype=np.int64)])
        self.table, _, self.begin = expand(self.rules, rounds.tolist(), self.base)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return np.where(symbols >= self.base, np.append(self.size, 1)[np.maximum(symbols.astype(np.int64) - self.base, -1)], 1).astype(np.int64)

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        return spelled(self.table, symbols, self.lengths(symbols), self.begin, self.base)

    def ids(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of the k-th document, from those of its symbols only that cover them."""
        symbols = self.seq[self.at[k] : self.at[k + 1]]
        ends = np.cumsum(self.lengths(symbols))
        first, last, _ = slice(first, last).indices(int(self.counts[k]))
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last - 1, "right")) + 1
        skip = first - (int(ends[a - 1]) if a else 0)
        return self.decode(symbols[a:b])[skip : skip + last - first]


def spelled(table: np.ndarray, symbols: np.ndarray, size: np.ndarray, begin: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: an id itself, a rule's range of ``table``."""
    symbols = symbols.astype(np.int64)
    from_ = np.where(symbols >= base, np.append(begin, 0)[np.maximum(symbols - base, -1)], symbols)
    total = np.concatenate([[0], np.cumsum(size)])
    return table[np.repeat(from_ - total[:-1], size) + np.arange(total[-1])]


def expand(rules: np.ndarray, rounds: list[int], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of ids in which every symbol's expansion is one range, how long each rule's is and where it begins.

    A round's rules only use ids and earlier rounds' rules.
    """
    table, size, begin, done, used = [np.arange(base, dtype=np.uint32)], np.zeros(len(rules), np.int64), np.zeros(len(rules), np.int64), 0, base
    whole = table[0]
    for n in rounds:
        seq = rules[done : done + n].reshape(-1).astype(np.int64)
        each = np.where(seq >= base, np.append(size, 1)[np.maximum(seq - base, -1)], 1)
        ids = spelled(whole, seq, each, begin, base)
        size[done : done + n] = each.reshape(-1, 2).sum(1)
        begin[done : done + n] = used + np.cumsum(size[done : done + n]) - size[done : done + n]
        done, used = done + n, used + len(ids)
        whole = np.concatenate([whole, ids])
    return whole, size, begin


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        held: list[tuple] = []
        shard = offset = pending = 0

        def shut() -> pa.RecordBatch:
            nonlocal held, shard, offset, pending
            doc_ids, nulls, ids, counts = (np.concatenate(x) for x in zip(*held))
            payload = Shard.pack(doc_ids, nulls, ids, counts)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (offset, pa.int64()), (len(ids), pa.int64()), (payload, pa.binary()))], ["part", "shard", "offset", "n_ids", "payload"])
            held, shard, offset, pending = [], shard + 1, offset + len(ids), 0
            return row

        for batch in batches:
            data, offsets = flat(batch.column(1))
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            for i, j in pieces(offsets, CHUNK_BYTES):
                ids, counts = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = np.full(len(ids) + j - i, end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), counts)] = ids
                held.append((doc_ids[i:j], nulls[i:j], out, counts + 1))
                pending += len(out)
                if pending >= SHARD_IDS:
                    yield shut()
        if held:
            yield shut()

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, offset, payload in zip(*(batch.column(k).to_pylist() for k in (0, 2, 4))):
            x = Shard(payload)
            ids = x.decode(x.seq)
            ends = np.cumsum(x.counts, dtype=np.int64)
            raw, begin = memoryview(ids.astype("<u4").tobytes()), ends - x.counts
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x.doc_ids, mask=x.nulls.astype(bool)), pa.array(np.full(len(crc), part, np.int32)), pa.array(begin + offset), pa.array(x.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "begin", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs`` in ascending order of id; returns the stored table of shards.

    Null text is empty: the end id alone. Null ids come first; rows with one id
    stand in one order of their texts' hashes, and may be in several partitions.
    A text longer than a shard has one of its own. An empty table gives no
    shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    order = ["doc_id", "hash", "part"]  # the last deals equal rows by the partition that they were read in
    docs = docs.withColumn("hash", F.xxhash64("text")).withColumn("part", F.spark_partition_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return store(docs.mapInArrow(lean(_encode(tokenizer, end_id), keeps="token_files"), "part int, shard int, offset long, n_ids long, payload binary"), "tokens")


def read_digests(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards: doc_id, start, n_tokens, ids_crc32."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = shards.mapInArrow(lean(_digest), "doc_id long, part int, begin long, n_tokens long, ids_crc32 long")
    return rows.join(small(parts), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
