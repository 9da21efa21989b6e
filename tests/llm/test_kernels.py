"""Kernels without Spark, each against a plain version."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import ngram_join, quality, suffix_dedup, token_files, transport
from lodestone.llm.queries import vocabulary

TEXTS = ["", "a", "A b", "one two three four five six", "x\ty\nz  w v u", "é É ñandú ß straße", "don't stop, it's 3.14 <|endoftext|> now!", "ha " * 500, "n" * 3000, "東京 2020 … »x«,", "tab\x0bvt \x1c sep nbsp em", "é combining"]


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingles_match_sets_of_words():
    texts = TEXTS + ["A B", "one two three four five six", "One TWO three four five six seven"]
    grams, at = ngram_join.shingles(*joined(texts))
    plain = [plain_shingles(t) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            a, b = grams[at[i] : at[i + 1]], grams[at[j] : at[j + 1]]
            assert len(np.intersect1d(a, b)) == len(plain[i] & plain[j])


@given(st.lists(st.integers(0, 40)), st.lists(st.integers(0, 40)), st.integers(1, 5))
def test_overlap_in_blocks(a, b, block):
    a, b = sorted(set(a)), sorted(set(b))
    x, y, n = np.array(a, np.int64), np.array(b, np.int64), len(set(a) & set(b))
    assert ngram_join.overlap(x, y, 0, block) == n
    assert ngram_join.overlap(x, y, n + 1, block) == -1


def test_encoder_agrees_with_the_library():
    e = token_files.Encoder(vocabulary())
    ids, counts = e.encode(*joined(TEXTS))
    ends = np.cumsum(counts)
    for t, a, b in zip(TEXTS, ends - counts, ends):
        assert ids[a:b].tolist() == e.library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_encoder_agrees_on_any_text(texts):
    e = token_files.encoder(vocabulary())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = e.encode(*joined(texts))
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_encoder_takes_no_hash_for_a_proof(monkeypatch):
    e = token_files.Encoder(vocabulary())
    monkeypatch.setattr(token_files, "range_hashes", lambda data, a, b: np.full(len(a), 7, np.uint64))
    ids, counts = e.encode(*joined(TEXTS))
    ends = np.cumsum(counts)
    for t, a, b in zip(TEXTS, ends - counts, ends):
        assert ids[a:b].tolist() == e.library.encode(t, add_special_tokens=False).ids, t
    assert e.by_rules and not token_files.cut_by_rules(vocabulary("byte_bpe_50k.json"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5))
def test_shard_round_trip(docs):
    docs = [d * 9 + [2] for d in docs]
    counts = np.array([len(d) for d in docs])
    ids = np.array([x for d in docs for x in d], np.uint32)
    n = len(docs)
    s = token_files.Shard(token_files.Shard.pack(np.arange(n), np.zeros(n, bool), ids.copy(), counts))
    assert s.decode(s.seq).tolist() == ids.tolist()
    for k, d in enumerate(docs):
        assert s.ids(k).tolist() == d and s.ids(k, 1, 4).tolist() == d[1:4] and s.ids(k, 3).tolist() == d[3:] and s.ids(k, -2).tolist() == d[-2:]
    pairs = Counter()
    for k in range(n):  # of three alike in a row only one pair can be replaced
        own, was = s.seq[s.at[k] : s.at[k + 1]].tolist(), None
        for x in zip(own, own[1:]):
            was = None if x == was else x
            pairs[x] += was is not None
    assert not pairs or max(pairs.values()) < 2
    with pytest.raises(ValueError):
        token_files.Shard(token_files.Shard.pack(np.arange(n), np.zeros(n, bool), ids, counts)[:-1])


def test_repair_makes_rules_and_shrinks():
    ids = np.array(([5, 6, 7, 8] * 200 + [2]) * 3, np.uint32)
    s = token_files.Shard(token_files.Shard.pack(np.arange(3), np.zeros(3, bool), ids.copy(), np.full(3, 801)))
    assert len(s.rules) > 0 and len(s.seq) < len(ids) / 3 and s.decode(s.seq).tolist() == ids.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=6000), min_size=1, max_size=5))
def test_transport_round_trip(payloads):
    data, at = np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
    full, where = transport.padded(data, at)
    media, begin = transport.multiplex(full, where)
    s = transport.Streams(media, begin)
    assert (s.payload == full).all() and (s.offsets == where).all() and not s.breaks.any()
    for k, p in enumerate(payloads):
        body = s.payload[where[k] : where[k + 1]].tobytes()
        assert body.startswith(p) and not body[len(p) :].strip(b"\xff") and len(body) % 576 == 0 and body


def test_transport_finds_lost_packets_and_bad_tables():
    media, begin = transport.multiplex(*transport.padded(np.zeros(50_000, np.uint8), np.array([0, 50_000])))
    lost = np.delete(media.reshape(-1, 188), 9, 0).ravel()
    assert transport.Streams(lost, np.array([0, len(lost)])).breaks.tolist() == [1]
    bad = media.copy()
    bad[12] ^= 1
    with pytest.raises(ValueError):
        transport.Streams(bad, begin)
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def plain_removed(texts):
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield gone


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=14), min_size=1, max_size=6), st.integers(0, 1 << 30))
def test_repeats_match_all_windows(shape, seed):
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(97, 123, n)) for n in (30, 90, 150, 201, 260, 7)]
    parts[5] = b"ab" * 60
    texts = [b"".join(parts[k] for k in s) for s in shape]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    places, h, lo, hi = suffix_dedup.anchors(data, at)
    if not len(places):
        assert not any(g.any() for g in plain_removed(texts))
        return
    right, left = np.full((len(places), 200), 255, np.uint8), np.full((len(places), 168), 255, np.uint8)
    for k, a in enumerate(places):
        right[k, : 200 - lo[k]] = data[a : a + 200 - lo[k]]
        left[k, : hi[k]] = data[a - hi[k] : a][::-1]
    shard = rng.integers(0, 3, len(places))
    order = np.lexsort([right.view(">u8")[:, k].astype(np.uint64) for k in range(24, -1, -1)] + [h, shard])
    least, most = suffix_dedup.repeats(shard[order], h[order], lo[order], hi[order], right[order], left[order], np.ones(len(places), np.int64))
    gone = np.zeros(len(data), bool)
    for k, a, b in zip(order, least, most):
        if b >= 0:
            gone[places[k] - b : places[k] - a + 200] = True
    assert (gone == np.concatenate(list(plain_removed(texts)))).all()


def test_anchors_are_dealt_evenly_into_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 3000, np.uint8)).decode() for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    sizes = Counter()
    for out in suffix_dedup._counted(40)([batch]):
        sizes[out.column(0)[0].as_py()] += len(out.column(2)[0].as_py()) // 8
    assert len(sizes) == 40 and max(sizes.values()) < 2 * sum(sizes.values()) / 40


def test_classifier_learns_and_scores_any_length():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeinrst"), 5))
    good = [" ".join(word() for _ in range(40)).encode() for _ in range(150)]
    bad = ["!! ".join(word().upper() for _ in range(40)).encode() for _ in range(150)]
    model = quality.train(*quality.with_crops(good + bad, np.array([1.0] * 150 + [0.0] * 150, np.float32)))
    texts = [b"", b"x", good[0] * 2000, bad[0] * 3, " ".join(word() for _ in range(60)).encode(), "!! ".join(word().upper() for _ in range(60)).encode()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s = quality.score(model, np.frombuffer(b"".join(texts), np.uint8), at)
    assert ((s >= 0) & (s <= 1)).all() and s[2] > 0.5 and s[4] > 0.5 and s[3] < 0.3 and s[5] < 0.3
    alone = quality.score(model, np.frombuffer(texts[4], np.uint8), np.array([0, len(texts[4])]))
    assert abs(alone[0] - s[4]) < 1e-5


def test_chunks_cover_every_byte():
    for n in (0, 1, 11, 12, 13, 395, 396, 397, 5000):
        data, begin, spans, many = quality.chunks(np.arange(n, dtype=np.int64).astype(np.uint8), np.array([0, n]))
        covered = np.zeros(max(n, 1), bool)
        for a, b in spans:
            for w in begin[a:b]:
                covered[w : w + quality.WINDOW] = True
        assert covered[:n].all() and hashlib.sha256(data[:n].tobytes()).hexdigest() == hashlib.sha256(np.arange(n).astype(np.uint8).tobytes()).hexdigest()


def test_scores_match_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(3)
    q = quality
    model = q.Model(*(x.astype(np.float32) for x in (rng.normal(0, 1, (256, q.WIDTH)), rng.normal(0, 1, (q.WINDOW * q.WIDTH, q.FILTERS)), rng.normal(0, 1, q.FILTERS), rng.normal(0, 0.2, 2 * q.FILTERS + 1))))
    texts = [b"", b"short", rng.bytes(396), rng.bytes(397), rng.bytes(2500)]
    monkeypatch.setattr(q, "CHUNKS", 3)
    got = q.score(model, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for text, s in zip(texts, got):
        n = max(1, -(-(len(text) - q.WINDOW) // q.STEP) + 1)
        raw = text.ljust((n - 1) * q.STEP + q.WINDOW, b"\0")
        windows = [sum(model.embed[raw[w * q.STEP + k]] @ model.filters[k * q.WIDTH : (k + 1) * q.WIDTH] for k in range(q.WINDOW)) for w in range(n)]
        starts = range(0, max(1, -(-(n - q.CHUNK) // q.HOP) + 1) * q.HOP, q.HOP)
        pooled = [np.maximum(np.max(windows[a : a + q.CHUNK], 0) + model.bias, 0) for a in starts]
        z = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0), [1]]) @ model.out
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-4


def test_other_operators_tasks_drop_what_token_workers_remember():
    import pyarrow as pa

    from pyspark import cloudpickle

    from lodestone.llm import common

    def sent(task):  # as to a worker
        return cloudpickle.loads(cloudpickle.dumps(task))

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])
    token_files.encoder(vocabulary()).encode(np.frombuffer(b"some words", np.uint8), np.array([0, 10]))
    assert list(sent(common.lean(lambda batches: batches, keeps="token_files"))([batch])) == [batch]
    assert token_files._encoders
    assert list(sent(common.lean(lambda batches: batches))([batch])) == [batch]
    assert not token_files._encoders and not common._powers
    token_files.encoder(vocabulary())
    common._tidied = float("-inf")
    assert sent(common.lean_groups(lambda rows: rows))(7) == 7
    assert not token_files._encoders


def test_pieces_in_several_batches_give_the_same_ids(monkeypatch):
    data = np.frombuffer(" ".join(f"piece{chr(97 + i % 26)}x{i} naïve" for i in range(300)).encode(), np.uint8)
    at = np.array([0, len(data)])
    plain, _ = token_files.Encoder(vocabulary()).plainly(data, at)
    monkeypatch.setattr(token_files, "BATCH_PIECES", 7)
    ids, counts = token_files.Encoder(vocabulary()).encode(data, at)
    assert ids.tolist() == plain.tolist() and counts.tolist() == [len(plain)]
