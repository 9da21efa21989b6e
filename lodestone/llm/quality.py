"""A byte-level convolutional quality classifier in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. In each
chunk, learned filters run over windows of embedded bytes and each filter's
greatest response is kept (max-pooling). The mean and the greatest of the
chunks' pooled responses give one probability. A bounded, documented sample of
labelled rows is learned from; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, flat, lean, pieces

#: Bytes of a window, step between windows, numbers of an embedded byte, filters.
WINDOW, STEP, WIDTH, FILTERS = 12, 3, 4, 16
#: Windows of a chunk (so 396 bytes every 360), and by how many the next one begins later.
CHUNK, HOP = 129, 120
#: Labelled rows, with their whole texts, that are learned from at most.
SAMPLE_ROWS = 3000
#: Chunks whose responses are in memory at once, in a text of any length.
CHUNKS = 4096
EPOCHS, BATCH, RATE = 10, 32, 0.01
SCORE_BYTES = 1 << 20


@dataclass
class Model:
    embed: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # WINDOW * WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS + 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, where their windows begin, first window of each chunk with those after its last, chunks of each text.

    Every text is padded with zeros to whole steps, so that its windows cover
    its last byte; an empty text has one window.
    """
    size = np.diff(offsets)
    windows = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    padded = (windows - 1) * STEP + WINDOW
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(at[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], size)] = data
    first = np.concatenate([[0], np.cumsum(windows)])
    begin = np.arange(first[-1]) * STEP + np.repeat(at[:-1] - first[:-1] * STEP, windows)
    many = np.maximum(1, -(-(windows - CHUNK) // HOP) + 1)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    a = np.repeat(first[:-1], many) + k * HOP
    return out, begin, np.stack([a, np.minimum(a + CHUNK, np.repeat(first[1:], many))], 1), many


def embedded(model: Model, data: np.ndarray) -> np.ndarray:
    """Steps of embedded bytes, STEP * WIDTH numbers each; padded texts are whole steps."""
    return model.embed.reshape(256, -1).view(np.complex128).ravel().take(data).view(np.float32).reshape(-1, STEP * WIDTH)


def respond(model: Model, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """All filters' responses to the windows at ``begin``: a window is some steps, each multiplied with its part of the filters."""
    first, last = begin[0] // STEP, begin[-1] // STEP
    steps = embedded(model, data[begin[0] : begin[-1] + WINDOW])
    n = last - first + 1
    total = steps[:n] @ model.filters[: STEP * WIDTH]
    for k in range(1, WINDOW // STEP):
        total += steps[k : n + k] @ model.filters[k * STEP * WIDTH : (k + 1) * STEP * WIDTH]
    at = begin // STEP - first
    return total if len(at) == n else total[at]


def pool(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each chunk."""
    out = np.maximum.reduceat(values, spans[:, 0])  # up to the next chunk's first window
    tail = spans[:, 1] > np.append(spans[1:, 0], len(values))
    if tail.any():  # the part that overlaps the next chunk
        more = np.maximum.reduceat(values, np.stack([np.append(spans[1:, 0], 0)[tail], np.minimum(spans[tail, 1], len(values) - 1)], 1).ravel())[::2]
        out[tail] = np.maximum(out[tail], more)
    return out


def summary(model: Model, pooled: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    active = np.maximum(pooled + model.bias, 0)
    first = np.cumsum(many) - many
    both = np.concatenate([np.add.reduceat(active, first) / many[:, None], np.maximum.reduceat(active, first), np.ones((len(many), 1), active.dtype)], 1)
    return active, both


def responses(model: Model, data: np.ndarray, begin: np.ndarray, spans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Responses of some chunks at a time, these chunks' windows counted from their first, and that first window."""
    for i in range(0, len(spans), CHUNKS):
        own = spans[i : i + CHUNKS]
        a, b = int(own[0, 0]), int(own[-1, 1])
        yield respond(model, data, begin[a:b]), own - a, a


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability for each text."""
    data, begin, spans, many = chunks(data, offsets)
    pooled = [pool(values, own) for values, own, _ in responses(model, data, begin, spans)]
    z = summary(model, np.concatenate(pooled), many)[1] @ model.out
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss, classes weighted alike; a fixed seed and order, so reruns agree."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.5, (256, WIDTH)), rng.normal(0, 0.15, (WINDOW * WIDTH, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS + 1))
    model = Model(*(x.astype(np.float32) for x in model.parts()))
    if not len(texts) or labels.min() == labels.max():
        model.out[-1] = 0 if not len(texts) else (4 if labels[0] else -4)
        return model
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first, second, t = [np.zeros_like(x) for x in model.parts()], [np.zeros_like(x) for x in model.parts()], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = np.array([len(texts[j]) for j in rows])
            data, begin, spans, many = chunks(np.frombuffer(b"".join(texts[j] for j in rows), np.uint8), np.concatenate([[0], np.cumsum(size)]))
            pooled, tops = [], []
            for values, own, a in responses(model, data, begin, spans):
                pooled.append(pool(values, own))
                tops.append(first_windows(values, own) + a)
            pooled, tops = np.concatenate(pooled), np.concatenate(tops)
            active, both = summary(model, pooled, many)
            p = 1 / (1 + np.exp(-(both @ model.out)))
            dz = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            d_out = both.T @ dz + 1e-4 * model.out
            d_both = dz[:, None] * model.out
            text = np.repeat(np.arange(len(rows)), many)
            d_active = d_both[text, :FILTERS] / many[text, None]
            top = both[text, FILTERS : 2 * FILTERS] == active
            d_active = (d_active + top * d_both[text, FILTERS : 2 * FILTERS]) * (active > 0)
            # each pooled response comes from one window: the first that gives it
            chunk, f = np.nonzero(d_active)
            g = d_active[chunk, f]
            used, source = np.unique(tops[chunk, f], return_inverse=True)
            per = np.zeros((len(used), FILTERS), np.float32)
            np.add.at(per, (source, f), g)
            windows = model.embed[data[begin[used][:, None] + np.arange(WINDOW)]].reshape(len(used), WINDOW * WIDTH)
            d_filters = windows.T @ per
            d_windows = (per @ model.filters.T).reshape(-1, WIDTH)
            d_embed = np.zeros_like(model.embed)
            np.add.at(d_embed, data[begin[used][:, None] + np.arange(WINDOW)].ravel(), d_windows)
            t += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8)
            for x, d, m, v in zip(model.parts(), (d_embed, d_filters, d_active.sum(0), d_out), first, second):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return model


def first_windows(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The first window with the greatest response, of each filter in each chunk."""
    return np.array([a + values[a:b].argmax(0) for a, b in spans.tolist()])


def with_crops(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> tuple[list[bytes], np.ndarray]:
    """Adds a short crop of every text of label 1, so that a short text isn't taken for a bad one."""
    rng = np.random.default_rng(seed)
    crops = []
    for text in (t for t, y in zip(texts, labels) if y == 1 and len(t) > 40):
        n = int(rng.integers(6, 200))
        i = int(rng.integers(0, max(1, len(text) - n)))
        i = text.find(b" ", i) + 1
        crops.append(text[i : i + n].rsplit(b" ", 1)[0])
    return texts + crops, np.concatenate([labels, np.ones(len(crops), np.float32)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from at most SAMPLE_ROWS labelled rows that aren't held out, as many of each label where there are.

    Ids are chosen by a hash, and of their rows, should ids repeat, those that
    come first by (hash, id, text): a total order but for equal rows, so the
    choice is the same however the table is partitioned. An id with both labels
    counts as 1. Null labels, ids and texts are passed over; without rows, every
    text scores 1/2.
    """
    most = SAMPLE_ROWS // 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("h", "doc_id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame(chosen, known.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body")).where("body is not null")
    rows = rows.join(F.broadcast(chosen), "doc_id")
    rows = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("h", "doc_id", "body").limit(most).collect()]
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["body"])))
    return train(*with_crops([bytes(r["body"]) for r in rows], np.array([r["y"] for r in rows], np.float32)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1) of the whole text, predicted (1 from ``threshold``).

    Null text scores as the empty text; any other column is ignored; equal
    texts score alike up to the rounding of floats.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, SCORE_BYTES):
                s = score(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; scored in place, so no text is shuffled."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            for i, j in pieces(offsets, SCORE_BYTES):
                s = score(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array(s >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
