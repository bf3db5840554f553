import random

import pytest

from lectern.llm import mixing


def targets(sizes):
    """Shares by weight, capped at three times a source's size, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out = sum(sizes.values()), {}
    while len(out) < len(names):
        open_ = [s for s in names if s not in out]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
    return out


def docs(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(n)]
    return rows + [(n, None, "a"), (None, "x y", "b"), (3, "x", "only"), (3, "x", "only")]


def test_targets_and_takes(spark):
    rows = docs(spark)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    n = mixing.repeat_documents(df.where("doc_id < 600"), mixing.mix(df.where("doc_id < 600"))).count()
    assert n == sum(r["copies"] for r in mixing.mix(df.where("doc_id < 600")).collect())


def test_empty_and_wordless(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], kind)).collect()
    assert [(x["size"], x["target"], x["taken"]) for x in r] == [(0, 0.0, 0), (0, 0.0, 0)]
