import hashlib
import random

import pytest

from lectern.llm import suffix


def brute(rows, length):
    """By every window's bytes; rows in the order of their ids."""
    first, out = {}, []
    for order, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first.setdefault(b[s:s + length], (order, s)) != (order, s):
                hit[s:s + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        out.append((i, len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length, parts=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(parts)
    r = suffix.remove_repeats(df, length).collect()
    return sorted([(x["doc_id"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in r], key=str)


def corpus(seed, n, alphabet, size):
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choice(alphabet) for _ in range(m))
    shared = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(0, size)) for _ in range(rng.randint(0, 6)))
        rows.append((i, t))
    rows[2] = (2, "ab" * 40)
    rows[3] = (3, "a" * 150)
    rows[4] = (4, rows[5][1])
    return rows


@pytest.mark.parametrize(("length", "alphabet", "size"), [(10, "ab", 12), (24, "abcdé", 40), (3, "abc", 20), (1, "abc", 3)])
def test_equals_brute_force(spark, length, alphabet, size):
    rows = corpus(length, 40, alphabet, size)
    assert got(spark, rows, length) == brute(rows, length)


def test_small_units_and_pieces(spark, monkeypatch):
    """Tasks that send early, and texts longer than a piece, give the same."""
    rows = corpus(7, 30, "abc", 60)
    rows.append((100, "".join(random.Random(1).choice("ab") for _ in range(900)) + rows[0][1] * 2))
    monkeypatch.setattr(suffix, "UNIT", 40)
    from pyspark.sql import functions as F  # noqa: F401
    docs = [(i, t.encode()) for i, t in rows]
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix, "PIECE", 128)
    monkeypatch.setattr(suffix, "BUFFER", 64)
    monkeypatch.setattr(suffix, "_POS", np.uint64(127))
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([0] * len(docs)), pa.array([d[1] for d in docs], pa.binary())], ["d", "t", "data"])
    length = 10
    sent = pa.Table.from_batches(list(suffix._find_runs(length)([batch]))).sort_by([(c, "ascending") for c in ("key", "f", "d", "t", "at")])
    settled = pa.Table.from_batches(list(suffix._settle(False)(sent.to_batches(max_chunksize=17)))).to_pylist()
    opened = {}
    for r in settled:
        if r["open"]:
            opened.setdefault(r["d"], []).append((r["start"], r["n"]))
    texts = dict(docs)
    b2 = pa.RecordBatch.from_arrays([pa.array(list(opened)), pa.array([0] * len(opened)), pa.array([texts[d] for d in opened], pa.binary()),
                                     pa.array([[x[0] for x in v] for v in opened.values()], pa.list_(pa.int64())), pa.array([[x[1] for x in v] for v in opened.values()], pa.list_(pa.int64()))],
                                    ["d", "t", "data", "starts", "ns"])
    sent = pa.Table.from_batches(list(suffix._find_windows(length)([b2]))).sort_by([(c, "ascending") for c in ("key", "f", "d", "t", "at")])
    settled += pa.Table.from_batches(list(suffix._settle(True)(sent.to_batches(max_chunksize=17)))).to_pylist()
    hit = {d: bytearray(len(t)) for d, t in docs}
    for r in settled:
        if not r["open"]:
            hit[r["d"]][r["start"]:r["start"] + r["n"] + length - 1] = b"\1" * (r["n"] + length - 1)
    for i, removed, _, _ in brute(rows, length):
        assert sum(hit[i]) == removed


def test_nulls_repeats_and_empty(spark):
    t = "x" * 5 + "".join(chr(97 + k % 23) for k in range(80))
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, t + "q"), (None, t)]
    r = dict()
    for i, removed, spans, _ in got(spark, rows, 20):
        r.setdefault(i, []).append((removed, spans))
    own = brute([(3, t)], 20)[0][1:3]
    assert r[1] == [(0, 0)] and r[2] == [(0, 0)] and r[3] == [own, own]
    assert r[4] == [(len(t), 1)] and r[None] == [(len(t), 1)]
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 20).count() == 0


def by_text_hash(spark, rows):
    """The rows in the order that documents have: by id, null ids last, texts of one id by their hash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))


def ordered_brute(rows, length):
    first, out = {}, []
    for order, (i, t) in enumerate(rows):
        b = t.encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first.setdefault(b[s:s + length], (order, s)) != (order, s):
                hit[s:s + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        out.append((i, len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_many_texts_of_one_id(spark):
    """20,000 distinct texts without an id and 5,000 of one id, every second with a repeat of its own, some with shared ones."""
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(40))
    shared = [word() + word() for _ in range(50)]
    rows = []
    for i in range(25_000):
        own = word()
        rows.append((None if i < 20_000 else 7, f"{i} {own} " + (own if i % 2 else word()) + (rng.choice(shared) if i % 5 == 0 else "") + "x" * (i % 3)))
    rows += [(1, shared[0]), (9, shared[1] + shared[2])]
    assert got(spark, rows, 36, 4) == ordered_brute(by_text_hash(spark, rows), 36)
