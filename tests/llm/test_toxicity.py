import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import toxicity

RARE = ["zorvexa", "zorvexi", "kradulon", "mupheti"]


def brute_segments(s):
    """All maximal segments by definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(s)):
        for j in range(i, len(s)):
            t = sum(s[i:j + 1])
            if t > 1e-12 and (best is None or t > best[0] + 1e-12 or (abs(t - best[0]) <= 1e-12 and (i, -j) < (best[1], -best[2]))):
                best = (t, i, j)
    if best is None:
        return []
    t, i, j = best
    return [*brute_segments(s[:i]), best, *[(a, b + j + 1, c + j + 1) for a, b, c in brute_segments(s[j + 1:])]]


@pytest.mark.parametrize("seed", range(6))
def test_segments_by_definition(seed):
    s = np.random.default_rng(seed).normal(-0.2, 1, 30)
    got = toxicity.maximal_segments(s)
    assert [(a, b) for _, a, b in got] == [(b, c) for _, b, c in brute_segments(list(s))]


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("mel", "tor", "sin", "quo") for b in ("ana", "ore", "ipi", "usu") for c in ("st", "rn", "ld")]
    rows, labels = [], []
    for i in range(n):
        ws = rng.choices(plain, k=rng.randint(20, 200))
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(ws))
            ws[at:at] = rng.choices(RARE + plain[:3], k=8)
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).select("doc_id", (toxicity.held("doc_id") == 1).alias("out"), "score", "passages").collect()}
    out = [i for i, r in got.items() if r["out"]]
    assert len(out) > 200 and np.mean([(got[i]["score"] >= 0.7) == truth[i] for i in out]) > 0.97
    hit = next(i for i in out if truth[i])
    assert got[hit]["passages"] and all(not got[i]["passages"] or truth[i] for i in out)


def test_nulls_empty_and_unlabelled(spark):
    docs, labels, _ = corpus(spark, 120)
    odd = docs.unionByName(spark.createDataFrame([(None, None, "x"), (901, "", "x"), (901, "", "x"), (902, None, "x")], docs.schema))
    more = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (77777, 1), (901, 0)], labels.schema))
    rows = toxicity.score(odd, toxicity.fit(odd, more)).collect()
    assert len(rows) == 124 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r["score"] < 0.01 for r in toxicity.score(docs, None).collect()} == {True}
    assert toxicity.score(docs.limit(0), None).count() == 0


def brute_fit(rows, labels):
    """The model by dictionaries and plain loops, over rows (doc_id, text) with distinct texts and labels of the rows to learn from."""
    sets = {i: set(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in rows}
    n = Counter(labels[i] for i in labels)
    count = {(stem, t): Counter() for stem in (0, 1) for t in (0, 1)}
    for i, t in labels.items():
        count[0, t].update(sets[i])
        count[1, t].update({w[:5] for w in sets[i]})
    words = [set(count[s, 0]) | set(count[s, 1]) for s in (0, 1)]
    share = n[1] / (n[1] + n[0])
    least = math.sqrt(2 * math.log(len(words[0]) + len(words[1])))
    found = [{}, {}]
    for stem in (0, 1):
        for w in words[stem]:
            y1, y0 = count[stem, 1][w], count[stem, 0][w]
            s1, s0 = count[1, 1][w[:5]], count[1, 0][w[:5]]
            p = share if stem else (s1 + 4 * share) / (s1 + s0 + 4)
            d = math.log((y1 + 4 * p) / (y0 + 4 * (1 - p))) - math.log(n[1] / n[0])
            if abs(d) / math.sqrt(1 / (y1 + 4 * p) + 1 / (y0 + 4 * (1 - p))) >= least:
                found[stem][w] = d
    return found


def brute_score(model, text):
    """A text's score by definition: segments one by one, the evidence of the r best for every r."""
    ws = re.findall(r"[^\W\d_]+", (text or "").lower())
    s = [model.own.get(w, model.stems.get(w[:5], 0.0)) - 1.0 for w in ws]
    segments = sorted((x for x, _, _ in brute_segments(s)), reverse=True)
    x, t = 0.0, 0.0
    for r, v in enumerate(segments, 1):
        v = model.lam * v - math.log(max(model.k * len(ws), 1e-12))
        if v <= 0:
            break
        t += v
        x = max(x, t - (r - 1) * math.log(t) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)) if t > 1 else t)
    return 1 / (1 + math.exp(-max(-40, min(40, model.a + model.b * math.log1p(x)))))


def test_model_and_scores_by_definition(spark):
    docs, labels, truth = corpus(spark, 300, seed=3)
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    own, stems = brute_fit(rows, {i: t for i, t in truth.items() if zlib.crc32(str(i).encode()) % 3 != 1})
    assert model.own == pytest.approx(own) and model.stems == pytest.approx(stems)
    assert own and stems
    long = " ".join(["plain zorvexa zorvexa"] * 70) + " x" * 30
    odd = spark.createDataFrame([(1000, long, "x"), (1001, "", "x"), (1002, None, "x")], docs.schema)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id < 60").unionByName(odd), model).collect()}
    for i, t in [*rows[:60], (1000, long), (1001, ""), (1002, None)]:
        assert got[i] == pytest.approx(brute_score(model, t), abs=1e-9)


def test_every_segment_counts():
    few, many = (toxicity.evidence([9.0] * n, 1000, 1.0, 0.01) for n in (50, 400))
    assert many > 2 * few


def test_ties_long_and_repeated_texts(spark):
    docs, labels, _ = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    clean = "melanast torore sinipi " * 40_000
    rows = [(1, clean, "x"), (1, clean, "x"), (2, clean + "zorvexa zorvexi kradulon mupheti " * 3, "x"), (3, "zorvexa kradulon mupheti zorvexi", "x"), (4, "zorvexa kradulon mupheti zorvexi", "x")]
    got = toxicity.score(spark.createDataFrame(rows, docs.schema), model).collect()
    score = {i: {r["score"] for r in got if r["doc_id"] == i} for i in (1, 2, 3, 4)}
    assert len(got) == 5 and all(len(s) == 1 for s in score.values())
    assert score[3] == score[4] and max(score[1]) < 0.1 < min(score[3])
    assert len(next(r["passages"] for r in got if r["doc_id"] == 2)) >= 1
