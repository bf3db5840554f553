"""Experiments against numpy and brute force."""

import itertools
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import experiments as X
from lectern.sources import index


def test_minimum_cover_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    items, options, want = [], [], {}
    for case in range(30):
        m = int(rng.integers(1, 13)) if case else 12
        items += [(case, i) for i in range(m)]
        own = []
        for o in range(int(rng.integers(0, 8))):
            covers = [int(i) for i in np.flatnonzero(rng.random(m) < 0.45)]
            cost = (int(rng.integers(1, 4)), float(rng.integers(1, 4)) / 2)
            options += [(case, f"o{o}", i, *cost) for i in [*covers, 99]]
            if covers:
                own.append((f"o{o}", frozenset(covers), *cost))
        best = ((0, []), 0, 0, 0.0, ())
        for n in range(1, len(own) + 1):
            for pick in itertools.combinations(own, n):
                covered = sorted(set().union(*[p[1] for p in pick]))
                x = ((len(covered), covered), n, sum(p[2] for p in pick), round(sum(p[3] for p in pick), 9), tuple(p[0] for p in pick))
                if x[0] > best[0] or (x[0] == best[0] and x[1:] < best[1:]):
                    best = x
        want[case] = (m, best[0][0], best[0][0] == m, best[1], best[2], best[3], list(best[4]))
    items += [(100, i) for i in range(13)]
    options += [(100, "o0", 0, 1, 1.0)]
    got = X.minimum_cover(spark.createDataFrame(options, "case int, option string, item int, requests int, latency double"), spark.createDataFrame(items, "case int, item int")).collect()
    got = {r["case"]: tuple(r[c] for c in ("universe", "covered", "complete", "n_options", "requests", "latency", "options")) for r in got}
    assert got.pop(100) == (13, None, None, None, None, None, None)
    assert got == want


def test_component_statistics_and_ratios(spark):
    rng = np.random.default_rng(11)
    rows = [(g, c, i, float(rng.normal(0, 1)), float(rng.normal(0.4, 1)), float(rng.exponential(1)), float(rng.exponential(3) + 0.1)) for g in "ab" for c in range(40) for i in range(int(rng.integers(1, 9)))]
    d = spark.createDataFrame([*rows, ("none", 1, 1, None, None, None, None)], "g string, c int, i int, a double, b double, x double, y double").repartition(5)
    got = {r["g"]: r for r in X.component_test(d, "a", "b", "c", ["g"]).collect()}
    ratio = {r["g"]: r for r in X.ratio_interval(d, "x", "y", "c", ["g"]).collect()}
    for g in "ab":
        of = {}
        for r in (r for r in rows if r[0] == g):
            of.setdefault(r[1], []).append(r)
        units = np.array([np.mean([r[4] - r[3] for r in v]) for v in of.values()])
        drawn = rng.choice(units, (60000, len(units))).mean(axis=1)
        assert got[g]["units"] == len(units) and got[g]["difference"] == pytest.approx(units.mean(), abs=1e-6)
        assert (got[g]["low"], got[g]["high"]) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.02)
        p = np.mean(np.abs(rng.choice([-1.0, 1.0], (60000, len(units))) @ units) >= abs(units.sum()))
        assert got[g]["p"] == pytest.approx(p, abs=0.01) and got[g]["method"] == "monte_carlo_sign_flip"
        num, den = (np.array([sum(r[k] for r in v) for v in of.values()]) for k in (5, 6))
        pick = rng.integers(0, len(num), (60000, len(num)))
        drawn = num[pick].sum(axis=1) / den[pick].sum(axis=1)
        assert ratio[g]["ratio"] == pytest.approx(num.sum() / den.sum(), abs=1e-6) and ratio[g]["components"] == len(of) and ratio[g]["cases"] == sum(map(len, of.values()))
        assert (ratio[g]["low"], ratio[g]["high"]) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.005)
    assert ratio["none"]["low"] is None and ratio["none"]["components"] == 0


def test_ratio_blocks_agree(spark, monkeypatch):
    from lectern.operators import stats

    rng = np.random.default_rng(12)
    d = spark.createDataFrame([("g", i, float(x), 1.0) for i, x in enumerate(rng.exponential(2, 90))], "g string, c int, x double, y double")
    whole = X.ratio_interval(d, "x", "y", "c", ["g"]).first()
    monkeypatch.setattr(stats, "BLOCK", 10)
    parts = X.ratio_interval(d.repartition(4), "x", "y", "c", ["g"]).first()
    assert (parts["low"], parts["high"]) == pytest.approx((whole["low"], whole["high"]), abs=0.03)


def test_labels_move_as_patterns(spark):
    rng = np.random.default_rng(9)
    rows = [(c, f"{c}-{i}", int(rng.random() < 0.4), float(rng.normal())) for c in range(60) for i in range(1 + c % 4)]
    d = spark.createDataFrame(rows, "c int, k string, label int, v double")
    got = X.permuted_labels(d.repartition(3), "c", "k", "label", 8).collect()
    again = X.permuted_labels(d.repartition(5), "c", "k", "label", 8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 8 * len(rows)
    pattern = lambda rs: {c: tuple(x for _, x in sorted((k, x) for c2, k, x in rs if c2 == c)) for c in range(60)}
    own, moved = sorted(pattern([(r[0], r[1], r[2]) for r in rows]).values()), 0
    for n in range(8):
        p = pattern([(r["c"], r["k"], r["label"]) for r in got if r["round"] == n])
        assert sorted(p.values()) == own
        moved += p != pattern([(r[0], r[1], r[2]) for r in rows])
    assert moved == 8
    t = X.component_permutation(d, "c", "k", "label", "v", rounds=300).first()
    v, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    assert t["rounds"] == 300 and t["labelled"] == y.sum() and t["difference"] == pytest.approx(abs(v[y == 1].mean() - v[y == 0].mean()), abs=1e-6)
    shuffled = [rng.permutation(y) for _ in range(4000)]
    p = np.mean([abs(v[s == 1].mean() - v[s == 0].mean()) >= t["difference"] - 1e-9 for s in shuffled])
    assert t["p"] == pytest.approx(p, abs=0.12)


def test_component_permutation_in_blocks(spark, monkeypatch):
    """The rounds of permuted_labels, in one block and in many, with unknown labels and values; components of ten cases take more than a byte."""
    rng = np.random.default_rng(12)
    rows = [(c, i, None if rng.random() < 0.1 else int(rng.random() < 0.4), None if rng.random() < 0.1 else float(rng.normal())) for c in range(90) for i in range((1, 3, 10)[c % 3])]
    d = spark.createDataFrame(rows, "c int, k int, label int, v double").repartition(3)
    v = {(c, k): x for c, k, _, x in rows}
    gap = lambda y: abs(np.mean([v[k] for k, x in y.items() if x == 1 and v[k] is not None]) - np.mean([v[k] for k, x in y.items() if x == 0 and v[k] is not None]))
    own, drawn = gap({(c, k): x for c, k, x, _ in rows}), {}
    for r in X.permuted_labels(d, "c", "k", "label", 30).collect():
        drawn.setdefault(r["round"], {})[r["c"], r["k"]] = r["label"]
    p = round((sum(gap(y) >= own - 1e-9 for y in drawn.values()) + 1) / 31, 6)
    monkeypatch.setattr(X, "ROUNDS", 8)
    for cases in (20, 1 << 16):
        monkeypatch.setattr(X, "CASES", cases)
        t = X.component_permutation(d, "c", "k", "label", "v", rounds=30).first()
        assert (t["p"], t["rounds"]) == (p, 30) and t["difference"] == pytest.approx(own, abs=2e-6)
    monkeypatch.setattr(X, "permuted_labels", None)  # no row for each case and round
    assert X.component_permutation(d, "c", "k", "label", "v", rounds=8).first()["rounds"] == 8


def test_logistic_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 50, 0.01], (240, 3)) + [0, 1000, 0]
    y = (x[:, 0] + rng.normal(0, 1, 240) > 0.8).astype(int)
    rows = [(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    d = spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1.0)], "id int, y int, a double, b double, c double").repartition(4)
    out, weights = X.logistic(d, "id", "y", ["a", "b", "c"], folds=3, steps=60)
    got = {r["key"]: r for r in out.collect()}
    fold = np.array([got[i]["fold"] for i in range(240)])
    for k in range(3):
        t = fold != k
        mean, sd = x[t].mean(axis=0), x[t].std(axis=0, ddof=1)
        z, w = (x[t] - mean) / sd, np.zeros(4)
        balance = np.where(y[t] == 1, t.sum() / (2 * y[t].sum()), t.sum() / (2 * (1 - y[t]).sum()))
        for _ in range(60):
            e = (1 / (1 + np.exp(-(w[0] + z @ w[1:]))) - y[t]) * balance
            w = w - X.RATE * (np.r_[e.sum(), e @ z] / t.sum() + np.r_[0, X.PENALTY * w[1:]])
        assert weights[k] == pytest.approx(w, abs=1e-6)
        p = 1 / (1 + np.exp(-(w[0] + (x[~t] - mean) / sd @ w[1:])))
        assert [got[i]["p"] for i in np.flatnonzero(~t)] == pytest.approx(list(p), abs=1e-6)
    with pytest.raises(ValueError):
        X.logistic(d.where("y = 1"), "id", "y", ["a"], folds=3, steps=1)


def test_stage_recall_is_one_aggregate(spark):
    rows = [(1, 1, "s", 2, True, False), (1, 2, "s", 2, True, None), (2, 1, "s", 1, False, False), (3, 5, None, 1, True, True)]
    d = spark.createDataFrame(rows, "query_id int, doc int, stratum string, gold_total int, first boolean, last boolean")
    out = X.stage_recall(d, ["first", "last"])
    got = {(r["stage"], r["stratum"], r["level"]): (r["gold"], r["found"], r["micro"], r["macro"]) for r in out.collect()}
    assert got[("first", None, 1)] == (4, 3, 0.75, pytest.approx(2 / 3, abs=1e-6)) and got[("first", "s", 0)] == (3, 2, pytest.approx(2 / 3, abs=1e-6), 0.5)
    assert got[("first", None, 0)] == (1, 1, 1.0, 1.0) and got[("last", None, 1)] == (4, 1, 0.25, pytest.approx(1 / 3, abs=1e-6)) and len(got) == 6
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_parity_is_of_multisets(spark):
    a = [(1, "x", 1), (1, "x", 1), (1, "y", None), (2, "x", 1), (3, "z", 1)]
    b = [(1, "x", 1), (1, "y", None), (1, "x", 1), (2, "x", 2), (4, "z", 1)]
    d = lambda r: spark.createDataFrame(r, "case int, title string, year int")
    got = {r["case"]: tuple(r)[1:] for r in X.parity(d(a), d(b), "case", ["title", "year"]).collect()}
    assert got == {1: (3, 3, 0, 0, True), 2: (1, 1, 1, 1, False), 3: (1, 0, 1, 0, False), 4: (0, 1, 0, 1, False)}
    got = {r["case"]: tuple(r)[1:] for r in X.parity(d(a), d(a[1:]), "case", ["title", "year"]).collect()}
    assert got[1] == (3, 2, 1, 0, False)


def test_index_is_reused_or_refused(spark, tmp_path):
    docs = [(i, f"word{i % 5} text {i}" if i % 7 else None) for i in range(50)]
    d = lambda r: spark.createDataFrame(r, "doc long, text string")
    path = f"file://{tmp_path}/one"
    index.save(d(docs), T.tokens(F.col("text")), path, "words-1")
    post, lengths = index.load(spark, path, d(docs[::-1]).repartition(7), "words-1")
    assert post.where("term = 'word1'").count() == sum(1 for i, t in docs if t and "word1 " in t) and lengths.count() == 50
    for other, tokenizer in ((docs[:-1] + [(49, "word4 text 50")], "words-1"), (docs[:-1], "words-1"), (docs + docs[:1], "words-1"), (docs, "words-2"), ([(0, "")] + docs[1:], "words-1")):
        with pytest.raises(index.IndexMismatch):
            index.load(spark, path, d(other), tokenizer)
    changed = docs[:3] + [(3, "new")] + docs[4:]
    *_, reused = index.load_or_save(d(changed), T.tokens(F.col("text")), path, f"file://{tmp_path}/two", "words-1")
    *_, again = index.load_or_save(d(changed), T.tokens(F.col("text")), f"file://{tmp_path}/two", f"file://{tmp_path}/three", "words-1")
    assert not reused and again
    spark.range(3).select(F.col("id").alias("doc"), F.lit("x").alias("term"), F.lit(1).alias("tf")).write.mode("append").parquet(f"{path}/postings")
    with pytest.raises(index.IndexMismatch):
        index.load(spark, path, d(docs), "words-1")


def test_nfkc_of_all_code_points(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"{c} " for c in points[i:i + 500]) for i in range(0, len(points), 500)] + ["plain", "", None, "é Å Ａ　ﬁ"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    for r in d.select("i", T.nfkc(F.col("t")).alias("n"), T.visible_query(F.col("t")).alias("v")).collect():
        t = rows[r["i"]]
        assert r["n"] == (None if t is None else unicodedata.normalize("NFKC", t))
        if t is not None:
            shown = "".join(c for c in unicodedata.normalize("NFKC", t) if c in "\t\n\r" or unicodedata.category(c) != "Cc")
            assert r["v"] == " ".join(shown.split())
    got = spark.createDataFrame([("GPT－4 Ｆｏｏ_bar+x 中文检索 a-", )], "t string").select(T.academic_tokens(F.col("t"))).first()[0]
    assert got == ["GPT-4", "Foo_bar+x", "中文检索", "a"]
