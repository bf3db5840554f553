import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import lm


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def brute(train, texts):
    """Interpolated modified Kneser-Ney of order two, by dictionaries."""
    c, c1 = Counter(), Counter()
    for t in train:
        ws = words(t)
        c1.update(ws)
        c.update(zip(["<s>", *ws], ws))
    n, v = sum(c1.values()), len(c1)
    d2 = lm.discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4)))
    after, before, total = defaultdict(Counter), Counter(), Counter()
    for (u, w), x in c.items():
        after[u][min(x, 3)] += 1
        before[w] += 1
        total[u] += x
    d1 = lm.discounts(*(sum(x == k for x in before.values()) for k in (1, 2, 3, 4)))
    free1 = sum(d1[min(x, 3) - 1] for x in before.values())
    cut = lambda x, d: max(x - d[min(x, 3) - 1], 0) if x else 0
    p1 = lambda w: (cut(before[w], d1) + free1 / (v + 1)) / len(c) if c else 1 / (v + 1)
    out = []
    for t in texts:
        ws = words(t)
        s = 0.0
        for u, w in zip(["<s>", *ws], ws):
            if total[u]:
                s += math.log10((cut(c[u, w], d2) + sum(d2[k - 1] * m for k, m in after[u].items()) * p1(w)) / total[u])
            else:
                s += math.log10(p1(w))
        out.append((len(ws), sum(c1[w] > 0 for w in ws), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in ws), s))
    return out


def texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "\u00e9t\u00e9", "\u00c9t\u00e9", "x,y", *[f"w{k}" for k in range(60)]]
    return [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b"]).join(rng.choices(vocabulary, [60, 50, 40, 9, 9, 9, *[60 / (k + 2) for k in range(60)]], k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("n", "share"), [(120, 1 << 30), (120, 600), (0, 1 << 30)])
def test_equals_brute_force(spark, monkeypatch, n, share):
    monkeypatch.setattr(lm, "SHARE_BYTES", share)
    rows = [(i, t) for i, t in enumerate(texts(n))] + [(1000, None), (1001, ""), (1002, "never seen"), (None, "the of")]
    out = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    if not n:
        rows, out = rows[:3], [True] * 3
    d = spark.createDataFrame([(i, t, h, 1.5) for (i, t), h in zip(rows, out)], "doc_id long, text string, held boolean, score double").repartition(3)
    files = lm.fit(d.where("not held"))
    got = {r["doc_id"]: r for r in lm.score(d, files).collect()}
    want = brute([t for (_, t), h in zip(rows, out) if not h], [t for _, t in rows])
    for (i, _), (tokens, known, total, base, score) in zip(rows, want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], files.n) == (tokens, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([(t,) for t in texts(60)], "text string")
    m = lm.Arrays(lm.fit(d))
    vocabulary = np.unique(lm.tokens([t.encode() for t in texts(60)])[0])
    every = np.append(vocabulary, lm.tokens([b"unseen"])[0][0])
    free, c, p = m.word(every)
    p1 = m.unigram(p)
    assert p1.sum() == pytest.approx(1, abs=1e-9)
    for u in range(5):
        g = lm.pair(np.full(len(every), every[u]), every)
        order = np.argsort(g)
        n = np.empty(len(g), np.int64)
        n[order] = m.pair(g[order])
        assert ((np.maximum(n - lm._discount(n, m.files.d2), 0) + free[u] * p1) / c[u]).sum() == pytest.approx(1, abs=1e-9)


def test_chunks_do_not_cut_words(monkeypatch):
    t = [x.encode() for x in texts(40)] + [b"x" * 50]
    whole = lm.tokens(t)
    monkeypatch.setattr(lm, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, lm.tokens(t)))


def test_counts_beyond_32_bits(tmp_path):
    """Counts and predecessors of a word that no table here could hold."""
    h = np.sort(lm.tokens([b"the of"])[0])
    used, before = np.array([5_000_000_000, 7, (1 << 40) + 3]), np.array([1, (1 << 33) + 1, 255])
    zero = np.zeros(3, np.int64)
    order = np.argsort(h & lm._CUT)
    short = lm._pack_words(h[order], [zero, zero, zero, before[order]], True)
    rows = [{"share": 0, "kind": 1, "n": 3, "data": lm._pack_words(h, [used])}, {"share": 0, "kind": 2, "n": 3, "data": short}]
    out = list(lm._word_share(tmp_path.as_uri(), (0.5, 1.0, 1.5))([pa.RecordBatch.from_pylist(rows, lm._BLOBS)]))[0].to_pylist()[0]
    meta, name = lm._meta(out["data"], 8)
    assert meta[1] == used.sum()
    files = lm.Files(1, {}, {0: (meta[0], name)}, meta[1], meta[2], (0.5, 1, 1.5), (0.5, 1, 1.5), 1.0, 1)
    _, c, p = lm.Arrays(files).word(h)
    assert c.tolist() == used.tolist() and p.tolist() == before.tolist()


def test_very_long_text_ties_and_repeats(spark):
    long = " ".join(f"w{k % 700}" for k in range(300_000))
    rows = [(1, long), (1, long), (2, "w1 w2 w3"), (3, "w1 w2 w3"), (4, None)]
    d = spark.createDataFrame([(i, t, 2.0) for i, t in rows], "doc_id long, text string, perplexity double")
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.score(d, lm.fit(d)).collect())
    want = brute([t for _, t in rows], [t for _, t in rows])
    for (_, n, s), w in zip(got, want):
        assert n == w[0] and s == pytest.approx(w[4], rel=1e-9)
