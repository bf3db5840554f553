import numpy as np
import pytest

from lectern.llm import ann


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v] if v is not None else None, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string").repartition(3)


def run(spark, df, step=20, **shape):
    v = ann.usable(df)
    shards = ann.index(v, **shape)
    return [tuple(r) for r in ann.search(v.where(f"vec_id % {step} = 0"), shards).orderBy("query_id", "rank").collect()]


def brute(vectors, step=20, k=20):
    v = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for i in range(0, len(v), step):
        s = ann.exact(np.broadcast_to(v[i], v.shape), v)
        out[i] = [(j, s[j]) for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))][:k]
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    vectors = centres[rng.integers(0, 8, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    got, want = {}, brute(vectors)
    for q, rank, v, s in run(spark, frame(spark, vectors), shard=400):
        got.setdefault(q, []).append(v)
        assert len(got[q]) == rank and s == pytest.approx(dict(enumerate(ann.exact(np.broadcast_to(np.float32(vectors[q]).astype(float), vectors.shape), np.float32(vectors).astype(float))))[v], abs=0)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_copies_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(2)
    vectors = [list(x) for x in rng.normal(size=(60, 4))]
    for i in range(0, 60, 2):
        vectors[i] = [1.0, 0.5, 0.0, 0.0]  # half of all: ties go to the smaller id
    assert {q: [(v, s) for _, _, v, s in rows] for q, rows in group(run(spark, frame(spark, vectors))).items()} == brute(vectors)
    odd = [*vectors, None, [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0, 0, 0], [], [3.0, 4.0]]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(odd)] + [(None, [1.0] * 4), (5, [float(x) for x in vectors[5]])], "vec_id long, embedding array<float>")
    assert {q: [(v, s) for _, _, v, s in rows] for q, rows in group(run(spark, df)).items() if q < 60} == brute(vectors)


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_few_candidates_and_empty(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    assert [(q, r, v) for q, r, v, _ in run(spark, frame(spark, vectors))] == [(0, 1, 1), (0, 2, 2)]
    assert run(spark, frame(spark, [[1.0, 2.0]])) == []
    assert run(spark, frame(spark, [])) == []


def test_recall_query(spark):
    found = ann.ann_recall(spark, "/root/testdata/sf0.001").collect()
    assert found and min(r["recall"] for r in found) >= 0.5
