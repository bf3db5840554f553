import math
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import topk


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()


def brute(queries, docs, k):
    n, mean = len(docs), sum(len(words(t)) for _, t in docs) / max(1, len(docs))
    df = Counter(w for _, t in docs for w in set(words(t)))
    out = {}
    for q, text in queries:
        qtf, rows = Counter(words(text)), []
        for d, t in docs:
            tf, ln = Counter(words(t)), len(words(t))
            s = sum(qtf[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * ln / mean)) for w in qtf if w in tf)
            if s > 0:
                rows.append((d, s))
        out[q] = sorted(rows, key=lambda r: (-round(r[1], 9), r[0] is None, r[0]))[:k]
    return out


def corpus(n, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["The", "the"]
    rows = [(i, " ".join(rng.choices(vocabulary, [100 / (k + 1) for k in range(80)] + [40, 40], k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(6)]
    return [*rows, (n + 10, None), (n + 11, ""), (None, rows[3][1])]


def got(spark, queries, docs, k):
    q = spark.createDataFrame([(*r, 1) for r in queries], "query_id long, text string, rank int")
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double").repartition(3)
    out = {}
    for r in topk.search(q, d, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [8192, 20])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "BITS", 2)
    monkeypatch.setattr(topk, "LED", 2)
    docs = corpus(150)
    if shard < 8192:
        monkeypatch.setattr(topk, "SHARD_DOCS", shard)
    queries = [d for d in docs[:60:6]] + [(900, "never seen"), (901, None), (None, "the")]
    want = {q: r for q, r in brute(queries, docs, 5).items() if r and q is not None}
    have = got(spark, queries, docs, 5)
    assert set(have) == set(want)
    for q in want:
        assert [d for d, _ in have[q]] == [d for d, _ in want[q]]
        assert [s for _, s in have[q]] == pytest.approx([s for _, s in want[q]], rel=1e-9)


def test_empty_tables(spark):
    assert got(spark, [(1, "a")], [], 3) == {}
    assert got(spark, [], [(1, "a")], 3) == {}


def test_a_shard_without_frequent_words(spark):
    """No word is in a hundredth of the documents, and few blocks of documents stay open."""
    docs = [(i, f"only{i} twice{i // 2}") for i in range(400)]
    have = got(spark, docs[::50], docs, 2)
    assert {q: [d for d, _ in r] for q, r in have.items()} == {i: [i, i + 1] for i in range(0, 400, 50)}


def test_only_terms_behind_the_pivot():
    """Once the k-th score is known, a copy keeps a block of documents open for a query whose frequent words are all behind the pivot."""
    toks, count = topk.words([f"the only{i} rare{i}".encode() for i in range(400)])
    p = topk.postings(toks, count)
    ids = np.empty(400, np.int64)
    ids[p["place"]] = np.arange(400)
    shard = topk.Shard(p | {"ids": ids}, 3.0)
    own, w = np.unique(toks[21:24]), {toks[21]: 0.001, toks[22]: 5.0, toks[23]: 5.0}
    own = own[np.argsort(own != toks[21], kind="stable")]  # the most frequent first
    terms, place = np.unique(own, return_inverse=True)
    q = {"ids": np.array([9]), "start": np.array([0, 3]), "terms": terms, "own": place, "query": np.zeros(3, np.int32), "w": np.array([w[x] for x in own])}
    best, theta = [(np.zeros(0), np.zeros(0, np.int64))], np.zeros(1)
    shard.search(q, 1, best, theta)
    found = best[0][1].tolist(), theta[0]
    assert found == ([7], pytest.approx(10.001))
    again = [(np.zeros(0), np.zeros(0, np.int64))]
    shard.search(q, 1, again, theta)
    assert again[0][1].tolist() == [7]


def test_index_is_narrow():
    """Numbers take as few bytes as the largest needs, and large ones stay whole."""
    toks = topk.words([b"a " * 70_000, b"a b"])
    p = topk.postings(*toks)
    assert p["doc"].itemsize == 1 and p["tf"].itemsize == 4 and sorted(p["tf"].tolist()) == [1, 1, 70_000]
    assert topk.postings(*topk.words([b"a b"] * 3))["tf"].itemsize == 1 and len(topk.postings(*topk.words([b""]))["tf"]) == 0


@pytest.mark.parametrize("shard", [8192, 20])
def test_rounded_scores_of_words_that_count_once(spark, monkeypatch, shard):
    """Scores that are equal after rounding go to the smaller id, also across shards; repeats in a query count once."""
    for name, value in {"BLOCK": 3, "BITS": 2, "LED": 2, "SHARD_DOCS": shard}.items():
        monkeypatch.setattr(topk, name, value)
    docs = [d for d in corpus(150) if d[0] is not None]
    queries = [d for d in docs[:60:6] if d[1]]
    want = brute([(q, " ".join(dict.fromkeys(words(t)))) for q, t in queries], docs, len(docs))
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    have = {}
    for r in topk.search(q, d, 9, once=True, places=1).orderBy("query_id", "rank").collect():
        have.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    tied = {q: sorted(((x, math.floor(s * 10 + 0.5) / 10) for x, s in r), key=lambda x: (-x[1], x[0]))[:9] for q, r in want.items() if r}
    assert have == {q: [(x, pytest.approx(s)) for x, s in r] for q, r in tied.items()}
