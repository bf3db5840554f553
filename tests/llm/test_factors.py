import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import factors


def brute(rows, window):
    """By every window's words; null ids are last and equal."""
    order = lambda i: (i is None, i or 0)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            first[x] = min(first.get(x, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < order(i):
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return sorted(out, key=str)


def got(spark, rows, window, parts=3):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, lo int").repartition(parts)
    r = factors.remove_passages(df, window)
    assert r.columns == ["doc_id", "lo", "kept", "n_words", "n_removed"]
    return sorted([(x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in r.collect()], key=str)


def corpus(seed, n, size, vocabulary):
    rng = random.Random(seed)
    text = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    shared = [text(rng.randint(2, 3 * size)) for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            w += p if rng.random() < 0.4 else p[rng.randint(0, len(p) // 2):] if rng.random() < 0.3 else text(rng.randint(0, size))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows[3] = (3, rows[9][1])
    return rows


@pytest.mark.parametrize(("window", "vocabulary"), [(1, "ab"), (3, "ab"), (7, "abc"), (20, ["a", "bc", "é", "ß" * 9]), (50, ["a", "bc", "x" * 30])])
def test_equals_brute_force(spark, window, vocabulary):
    rows = corpus(window, 50, window, vocabulary)
    assert got(spark, rows, window) == brute(rows, window)


def test_edges(spark):
    """Null ids, null, empty and long texts, rows that repeat an id or a whole row, boundaries that only later references have."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 40)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, " ".join(base)), (4, " ".join(base[100:300])), (5, " ".join(base[90:140])), (5, " ".join(base[90:140]))]
    rows += [(None, " ".join(base[50:200])), (None, " ".join(base[50:200])), (None, " ".join(base[60:120] + ["new"] * 80)), (None, "new " * 100)]
    for i in range(10, 40):  # one seed, contexts of its own on either side, some of them shared
        left, right = f"l{i % 4} " * 9, f"r{i % 7} " * 9
        rows.append((i, left + " ".join(base[10:13]) + " " + right))
    rows.append((100, " ".join(base * 40)))
    for window in (9, 12):
        assert got(spark, rows, window) == brute(rows, window)
    assert got(spark, [], 5) == []


def test_many_rows_without_id(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(60))
    rows = [(0, passage)] + [(None, f"{i} {i * 7} " + (passage if i % 3 == 0 else "short")) for i in range(9000)]
    assert got(spark, rows, 50) == brute(rows, 50)


def test_pieces(monkeypatch):
    """Runs of a text that is parsed in pieces have every window once, with the seed it has elsewhere."""
    rng = random.Random(2)
    h = factors.Hashes().of([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(900)])
    whole = {lo + x: (s, p) for lo, n, p, s, _ in zip(*factors.runs(h, 10)) for x in range(n)}
    monkeypatch.setattr(factors, "PIECE", 128)
    text = b" ".join(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(5))
    assert sorted(whole) == list(range(891)) and text
    rng = random.Random(2)
    data = b" ".join(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(900))
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([data], pa.binary())], ["d", "t", "data"])
    rows = pa.Table.from_batches(list(factors._find_runs(10)([b]))).to_pylist()
    windows = [r["lo"] + x for r in rows for x in range(r["n"])]
    assert sorted(windows) == list(range(891))
    for r in rows:
        assert all(r["lo"] + x <= r["place"] <= r["lo"] + x + 9 for x in range(r["n"]))
        seed = np.array([r["seed"]]).view(np.uint64)[0]
        assert sum(whole[r["lo"] + x][0] == seed for x in range(r["n"])) == r["n"]


def test_longest_factor():
    a = np.array([9, 1, 2, 3, 4, 5, 8])
    assert factors.longest_factor(a, 2, np.array([1, 2, 3, 4, 6, 8]), 1, 2) == (1, 5)
    assert factors.longest_factor(a, 2, a, 2, 2) == (0, 7)


def test_query(spark, tmp_path):
    rows = corpus(50, 60, 60, ["the", "of", "ein", "für"] + [f"v{i}" for i in range(30)])
    rows += [(200 + i, rows[7][1] + f" end {i}") for i in range(30)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    r = factors.op12_passages(spark, str(tmp_path))
    assert r.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 50)]
    assert sorted([tuple(x) for x in r.collect()], key=str) == sorted(want, key=str)
