"""Inputs on which an operator once did less than the whole job."""

import hashlib
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import audit, boolean, diagnostics, fusion, identity, judgement, retrieval, stats
from lectern.plans import registry
from lectern.shared import materialize


def test_permutation_keeps_every_group(spark):
    rng = np.random.default_rng(3)
    big = [float(x) for x in rng.normal(0.3, 1, 60)]
    mid = [float(x) for x in rng.normal(0.3, 1, 15)]
    rows = [("mid", i, x) for i, x in enumerate(mid)] + [("big", i, x) for i, x in enumerate(big)] + [("ties", i, 0.0) for i in range(3)] + [("none", 0, None)] + [(None, i, 1.0) for i in range(3)]
    d = spark.createDataFrame(rows, "g string, i int, d double").repartition(3)
    got = {r["g"]: r for r in stats.permutation(d, "d", ["g"], "i", rounds=20000).collect()}
    assert {g: r["method"] for g, r in got.items()} == {"mid": "exact_sign_flip", "big": "monte_carlo_sign_flip", "ties": "exact_all_ties", "none": "no_evaluable_pairs", None: "exact_sign_flip"}
    signs = 1 - 2.0 * ((np.arange(1 << 15)[:, None] >> np.arange(15)) & 1)
    assert got["mid"]["p"] == pytest.approx(np.mean(np.abs(signs @ mid) >= abs(sum(mid)) - 1e-9), abs=1e-6) and got["mid"]["evaluated"] == 1 << 15
    drawn = np.abs(rng.choice([-1.0, 1.0], (100000, 60)) @ big) >= abs(sum(big))
    assert got["big"]["p"] == pytest.approx(drawn.mean(), abs=0.012) and got["big"]["evaluated"] == 20000
    assert got["ties"]["p"] == 1.0 and got["none"]["p"] is None and got[None]["p"] == 0.25
    assert {r["g"] for r in stats.exact_sign_flip(d, "d", ["g"], "i").collect()} == set(got)


def test_exact_sign_flip_goes_on_where_its_sql_ends(spark, tmp_path):
    """The SQL has no row for a nation of more than 12 suppliers; the query equals it below and every sign pattern above."""
    rng = np.random.default_rng(12)
    sizes = [1, 5, 11, 12, 13, 17, 20, 26]
    values = {n: [round(float(x), 2) for x in rng.normal(1500, 4000, n)] for n in sizes}
    rows = [(100 * n + i, n, x) for n in sizes for i, x in enumerate(values[n])]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["seg"]: r["p"] for r in registry.QUERIES["exact_sign_flip_test"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    sql = dict(con.execute(registry.ORACLE["exact_sign_flip_test"]).fetchall())
    assert sorted(got) == sizes and sorted(sql) == sizes[:4]
    assert {n: got[n] for n in sql} == sql
    for n in (13, 17, 20):
        sums = np.zeros(1)
        for x in values[n]:
            sums = np.concatenate((sums + x, sums - x))
        assert got[n] == pytest.approx(np.mean(np.abs(sums) >= abs(sum(values[n])) - 1e-6), abs=1e-6)
    cents = [round(100 * abs(x)) for x in values[26]]
    share = np.zeros(sum(cents) + 1)  # of the patterns, by the sum of the values with a plus
    share[0] = 1.0
    for x in cents:
        share[x:] = (share[x:] + share[:-x]) / 2
        share[:x] /= 2
    p = share[np.abs(2 * np.arange(len(share)) - sum(cents)) >= abs(round(100 * sum(values[26])))].sum()
    assert got[26] == pytest.approx(p, abs=5 * (p * (1 - p) / 100000) ** 0.5 + 1e-5)


def test_dense_ties_go_to_the_smallest_ids(spark):
    """A hundred copies of one vector, in descending order of their ids."""
    v = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(100, 0, -1)] + [(500, [0.9, 0.5]), (501, [0.1, 0.2])], "doc long, vec array<double>").coalesce(1)
    q = v.where("doc in (1, 50, 500)").withColumnRenamed("doc", "query_id")
    for block in (2048, 16):
        got = {}
        for r in retrieval.dense(q, v, 3, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc"])
        assert got == {1: [2, 3, 4], 50: [1, 2, 3], 500: [1, 2, 3]}
    assert retrieval._rounded(np.array([0.0078125, -0.0078125, 2.5e-7])).tolist() == [0.007813, -0.007813, 0.0]


def test_bootstrap_draws_are_no_rows(spark, monkeypatch):
    """The draws of SQL in one block and in many, with unknown values, and no draw is a row that a join could broadcast."""
    monkeypatch.setattr(stats, "ROUNDS", 16)
    cases = {"a": [float(i * i % 31) for i in range(40)], "b": [1.5, None, 4.0], "c": [2.0], "d": [None]}
    d = spark.createDataFrame([(g, i, v) for g, vs in cases.items() for i, v in enumerate(vs)], "g string, i int, v double").repartition(3)
    want = {}
    for g, vs in cases.items():
        means = []
        for r in range(40):
            x = [vs[int(hashlib.md5(f"boot:{r}:{i}".encode()).hexdigest()[:8], 16) % len(vs)] for i in range(len(vs))]
            x = [v for v in x if v is not None]
            means += [sum(x) / len(x)] if x else []
        want[g] = (pytest.approx(np.percentile(means, 2.5), abs=2e-6), pytest.approx(np.percentile(means, 97.5), abs=2e-6), 40) if means else (None, None, 40)
    for block in (7, 16384):
        monkeypatch.setattr(stats, "BLOCK", block)
        got = stats.bootstrap(d, "v", ["g"], "i", 40)
        assert {r["g"]: (r["low"], r["high"], r["rounds"]) for r in got.collect()} == want
        assert "Generate" not in got._jdf.queryExecution().toString()


def test_draws_in_pairs(monkeypatch):
    """Sums of paired draws are those of single ones: exact counts, mean and spread, in whole cells, a short one and one of a single value."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 700):
        v = rng.normal(2, 1, n) + 1j
        many = rng.integers(0, 2 * n + 2, 4000)
        got = stats.drawn_sums(v, many, rng)
        assert np.array_equal(got.imag, many)  # every draw is made once
        z = (got.real - many * v.real.mean())[many > 0] / np.sqrt(many[many > 0])
        assert abs(z.mean()) < 0.08 and z.std() == pytest.approx(v.real.std(), abs=0.06)
    each = stats.drawn_sums(np.eye(3)[:, 1] + 0j, np.full(30000, 2), rng).real
    assert np.bincount(each.astype(int)) / 30000 == pytest.approx([4 / 9, 4 / 9, 1 / 9], abs=0.015)


def test_dense_broadcasts_no_block(spark, monkeypatch):
    """Blocks meet by shuffles, and Python workers get few pairs at once."""
    kept, write = {}, retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda d, tag, **kind: kept.setdefault((tag, len(kept)), (d._jdf.queryExecution().executedPlan().toString(), kind)) and write(d, tag, **kind))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(60, None)], "doc long, vec array<double>")
    got = retrieval.dense(v.where("doc < 3").withColumnRenamed("doc", "query_id"), v, 2, 16).collect()
    assert sorted((r["query_id"], r["rank"], r["doc"]) for r in got) == [(q, i + 1, d) for q in range(3) for i, d in enumerate(sorted([d for d in range(60) if d != q], key=lambda d: (-(q % 7) * (d % 7), d))[:2])]
    plan, kind = next(x for (tag, _), x in kept.items() if tag == "near")
    assert "Broadcast" not in plan and kind == {"rows": 4}


def test_nearest_equals_dense_with_every_vector_asked(spark, monkeypatch):
    """Groups and tiles of few vectors, copies, negative scores, a vector that is not finite, rows without an id or a vector."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(150, 0, -1)] + [(200 + i, [1.0, -0.5, 0.25, 0.0]) for i in range(40, 0, -1)]
    rows += [(300, [float("nan"), 0.0, 0.0, 1.0]), (None, [1.0] * 4), (301, None)]
    v = spark.createDataFrame(rows, "doc long, vec array<float>").repartition(3)
    q = v.withColumnRenamed("doc", "query_id")
    told = lambda d: sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 6)) for r in d.collect())
    want = told(retrieval.dense(q, v, 7))
    assert len(want) == 190 * 7 and told(retrieval.nearest(q, v, 7)) == want
    monkeypatch.setattr(retrieval, "SIDE", 60)
    monkeypatch.setattr(retrieval, "TILE", 9)
    assert told(retrieval.nearest(q, v, 7)) == want
    assert told(retrieval.nearest(q.where("query_id % 50 = 0"), v, 7)) == [r for r in want if r[0] % 50 == 0]
    assert retrieval.nearest(q.limit(0), v, 7).count() == 0


def test_label_agreement_asks_every_vector(spark):
    from lectern.plans import retrieval as plans

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert plans.knn_label_agreement(spark, "/root/testdata/sf0.001").count() == v.count() == 500


def test_hybrid_reads_whole_texts_and_every_id(spark, tmp_path):
    """Words behind the twelfth are asked for, once each; a document without a vector and a vector without a document are asked too."""
    from lectern.plans import retrieval as plans

    fill = " ".join(f"f{i}" for i in range(14))
    docs = [(0, f"{fill} Éclair"), (50, f"{fill} rare, rare rare other"), (7, "rare"), (8, "other words"), (9, "éclair éclair"), (51, None), (52, ""), (100, "")] + [(10 + i, f"f{i} x{i}") for i in range(14)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in (0, 7, 8, 100, 150)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cols = ["query_id", "doc", "score", "lists", "rank"]
    got = [tuple(r[c] for c in cols) for r in plans.hybrid_topk(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE['hybrid_topk']})").fetchall()
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} == {0, 50, 100, 150} and {7, 8} <= {r[1] for r in got if r[0] == 50} and 9 in {r[1] for r in got if r[0] == 0}


def test_hybrid_makes_no_row_for_a_pair(spark, monkeypatch):
    """No join of queries and postings: bm25_over_hits and hits are not called."""
    from lectern.plans import retrieval as plans

    monkeypatch.setattr(retrieval, "bm25_over_hits", None)
    monkeypatch.setattr(retrieval, "hits", None)
    assert plans.hybrid_topk(spark, "/root/testdata/sf0.001").where("rank = 1").count() == 10


def test_padded_makes_no_postings_of_unasked_terms(spark, monkeypatch):
    from lectern.plans import binding
    from lectern.plans import retrieval as plans

    monkeypatch.setattr(binding, "postings", None)
    got = plans.bm25_padded(spark, "/root/testdata/sf0.001").where("query_id = -1").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21)) and {r["score"] for r in got} == {0.0}


def test_hybrid_makes_no_postings_of_unasked_terms(spark, monkeypatch):
    from lectern.plans import binding
    from lectern.plans import retrieval as plans

    monkeypatch.setattr(binding, "postings", None)
    assert plans.hybrid_topk(spark, "/root/testdata/sf0.001").where("rank = 1").count() > 0


def test_interval_has_all_rounds(spark, monkeypatch):
    """Bounds of 20,000 rounds lie close to those of another generator, in one block and in many."""
    rng = np.random.default_rng(4)
    v = [float(x) for x in rng.exponential(2, 80)]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("none", 0, None)], "g string, i int, d double").repartition(3)
    low, high = np.percentile(rng.choice(v, (100000, 80)).mean(axis=1), [2.5, 97.5])
    for block in (stats.BLOCK, 9):
        monkeypatch.setattr(stats, "BLOCK", block)
        got = {r["g"]: r for r in stats.interval(d, "d", ["g"], "i").collect()}
        assert got["a"]["rounds"] == 20000 and got["a"]["n"] == 80 and got["none"]["low"] is None
        assert got["a"]["low"] == pytest.approx(low, abs=0.02) and got["a"]["high"] == pytest.approx(high, abs=0.03)
    again = {r["g"]: r for r in stats.interval(d.repartition(5), "d", ["g"], "i").collect()}
    assert again["a"]["low"] == pytest.approx(got["a"]["low"], abs=1e-6)


def test_hybrid(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1)], "query_id long, doc long, rank int")
    got = [(r["query_id"], r["doc"], r["lists"]) for r in fusion.hybrid(a, b, top=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 2), (1, 10, 1), (2, 10, 1)]


def test_ordinals_of_wide_rows_are_distinct(spark):
    """A range exchange that is planned twice samples twice: with more columns than the key, ordinals once collided."""
    d = spark.range(3_000_000).select((F.hash("id") % 1_000_003).alias("k"), "id")
    got = diagnostics.numbered(d, "k").agg(F.count_distinct("ordinal").alias("n"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most")).first()
    assert tuple(got) == (3_000_000, 0, 2_999_999)


def test_timeliness_of_open_ranges(spark):
    rows = [(2020, None, 2020), (2020, None, 2031), (2020, None, 2019), (None, 2010, 1990), (None, 2010, 2011), (2010, 2010, 2010), (2000, 2015, 2015), (2000, 2015, 2000), (2020, None, None)]
    d = spark.createDataFrame(rows, "a int, b int, year int").withColumn("years", F.struct(F.col("a").alias("start_year"), F.col("b").alias("end_year")))
    got = [r[0] for r in d.select(judgement.timeliness(F.col("years"), F.col("year"), 2025)).collect()]
    assert got == [0.85, 0.85, 0.0, 0.85, 0.0, 0.85, 1.0, 0.7, 0.0]


def test_grams_of_passages_are_hashed_once(spark):
    """Against plain sets of n-grams, with short and empty texts, nulls and rows that share an id; no n-gram is made as text."""
    said = {1: ["a b c d e f a b c"], 2: ["b c d", "b c d x"], 3: ["a b"], 4: [None], 5: ["", "c d e f"], 6: ["A  B, c"]}
    asked = {"p": "a b c d e f", "q": "b c d", "r": "a b", "s": "", "t": "d e f a b c q", "u": None}
    d = spark.createDataFrame([(k, x) for k, xs in said.items() for x in xs], "doc long, text string").repartition(3)
    p = spark.createDataFrame(list(asked.items()), "passage string, text string")

    def grams(text):
        w = (text or "").lower().replace(",", " ").split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())

    want = {(k, a): (len(grams(t) & set().union(*map(grams, xs))), len(grams(t))) for k, xs in said.items() for a, t in asked.items()}
    got = audit.passage_containment(d, p, 3)
    assert {(r["doc"], r["passage"]): (r["hits"], r["total"]) for r in got.collect()} == {k: v for k, v in want.items() if v[0]}


def test_meetings_hold_every_link_and_no_pairs(spark):
    """The groups stand for just those links that the rule gives pair by pair, and 600 papers of one title make a few rows each."""
    rng = np.random.default_rng(4)
    some = lambda p, k, n: f"{p}{rng.integers(n)}" if rng.random() < k else None
    rows = [(i, f"T {rng.integers(6)}" if i % 9 else "", [f"A {x}" for x in rng.integers(4, size=rng.integers(3))], 2000 + int(rng.integers(2)) if i % 11 else None, some("10.1/d", 0.4, 30), some("a", 0.4, 30), some("", 0.1, 9), some("p", 0.3, 20)) for i in range(150)]
    kind = "paper_id long, title string, authors array<string>, year int, doi string, arxiv_id string, s2orc_corpus_id string, pubmed_id string"
    p = materialize(identity.profiles(spark.createDataFrame(rows, kind)), "profiles")
    got = {}
    for r in identity.meetings(p).collect():
        got.setdefault(r["group"], {}).setdefault(r["side"], []).append(r["node"])
    links = {tuple(sorted((a, b))) for g in got.values() for a in g.get(0, g.get(2, [])) for b in g.get(1, g.get(2, [])) if a != b}
    want = {(r["left"], r["right"]) for r in identity.pairs(p).collect() if r["rule"] in ("shared_stable_identifier", "exact_title_author_year")}
    assert links == want and len(want) > 100
    big = spark.createDataFrame([(i, "One title", ["A"], 2000, f"10.1/x{i}" if i % 3 == 0 else None) for i in range(600)], "paper_id long, title string, authors array<string>, year int, doi string")
    assert identity.meetings(materialize(identity.profiles(big), "profiles")).count() <= 1200


def test_boolean_matches_need_no_table_of_pairs(spark):
    """Both ways agree, also for repeated ids and queries without an answer, and neither counts nor hits are grouped before a shuffle."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(int(i), [f"w{x}" for x in rng.integers(9, size=rng.integers(30))]) for i in range(300)] + [(None, ["w1"]), (7, ["w1", "w2"]), (8, [])], "doc long, tokens array<string>").repartition(3)
    rows = [(q, c, " ".join(f"w{x}" for x in rng.integers(9, size=rng.integers(1, 4)))) for q in range(12) for c in range(2) for _ in range(3)] + [(20, 0, "..."), (21, 0, "zz"), (None, 0, "w1")]
    clauses = spark.createDataFrame(rows, "query_id int, clause int, alternative string")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc", "alternatives").collect())
    got = boolean.matching(clauses, docs)
    assert "HashAggregate" not in got._jdf.queryExecution().toString()
    own, q = key(got), spark.createDataFrame([(i, ["w1", "w2", f"w{i}"]) for i in range(5)], "query_id long, terms array<string>")
    packed = [(i, r["doc"], m) for r in boolean.matching_by_doc(clauses, docs).collect() for i, m in zip(r["q"], r["m"])]
    hit = sorted(tuple(r) for r in retrieval.hits(q, docs).collect() if r["doc"] is not None)
    assert own == sorted(packed) and len(own) > 100
    only = boolean.matching_by_doc(clauses, docs)
    pairs = only.select("doc", F.explode(F.arrays_zip("q", "m")).alias("x")).select(F.col("x.q").alias("query_id"), "doc", F.col("x.m").alias("mark"))
    best = [sorted(tuple(r) for r in retrieval.best(q, materialize(retrieval.hits(q, docs), "hits"), docs, 5, only=o).select("query_id", "doc", "score", "rank", "mark").collect()) for o in (only, pairs)]
    assert best[0] == best[1] and best[0]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "few", lambda asked: False)
        m.setattr(boolean, "few", lambda asked: False)
        assert hit == sorted(tuple(r) for r in retrieval.hits(q, docs).collect() if r["doc"] is not None)
        assert [r for r in key(boolean.matching(clauses, docs)) if r[1] != 7] == [r for r in own if r[1] != 7]


def test_hits_of_a_saved_index(spark):
    """Stored postings give the hits that the texts give, and the ranking that scoring pair by pair gives."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(int(i), [f"w{x}" for x in rng.integers(40, size=rng.integers(30))]) for i in range(200)] + [(900, [])], "doc long, tokens array<string>").repartition(3)
    post, lengths = retrieval.postings(docs, "doc", F.col("tokens")), docs.select("doc", F.size("tokens").alias("dl"))
    q = spark.createDataFrame([(i, [f"w{i}", "w3", "never"]) for i in range(9)], "query_id long, terms array<string>")
    hit = materialize(retrieval.hits_of_index(q, post, lengths), "hits")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(hit.select("doc", "dl", "term", "tf")) == rows(retrieval.hits(q, docs).select("doc", "dl", "term", "tf"))
    assert rows(retrieval.best(q, hit, docs, 7).select("query_id", "doc", "score", "rank")) == rows(retrieval.top_k(retrieval.bm25(q, post, lengths.select("doc")), 7).select("query_id", "doc", "score", "rank"))


def test_blocks_of_scores_stay_small():
    """What a Python task holds for a block of documents does not grow with the corpus: a few arrays of at most 4 MB."""
    assert 8 * max(retrieval.CELLS, retrieval.PRODUCTS) <= 4 << 20


def test_workers_hold_the_same_of_more_documents():
    """Five times the batches take no more memory at once, also where a block holds few documents for many queries, and less than blocks once did."""
    rng = np.random.default_rng(9)

    class Shared:
        def __init__(self, wide):
            per = min(wide, 40)
            self.value = np.arange(0, 2001 * per, per), np.concatenate([rng.choice(wide, per, replace=False) for _ in range(2000)]), rng.random(2000 * per), np.arange(wide)

    def batch(i, docs=1024, terms=300):
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * terms, pa.int32()), pa.array(x)) for x in (rng.integers(2000, size=docs * terms).astype(np.int32), rng.random(docs * terms))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(docs) + i * docs), *lists], ["doc", "t", "x"])

    def peak(shared, n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in retrieval._blocks(shared, 20, False)(batch(i) for i in range(n)))
        most = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        return most, rows

    for wide in (200, 1000):
        few, many = peak(Shared(wide), 2), peak(Shared(wide), 10)
        assert many[1] > 4 * few[1] > 0 and many[0] < 1.1 * few[0] and many[0] < 50


def test_whoever_ranks_gives_python_small_batches(spark, monkeypatch):
    """The ranking itself sets the limits of its batches, so queries that do not write it have them too."""
    seen = []
    blocks = retrieval._blocks

    def noted(*args):
        run = blocks(*args)

        def counted(batches):
            for b in batches:
                assert b.num_rows <= 1024
                yield from run([b])
        return counted

    monkeypatch.setattr(retrieval, "_blocks", lambda *args: seen.append(args) or noted(*args))
    docs = spark.range(5000).select(F.col("id").alias("doc"), F.array(F.lit("a"), F.concat(F.lit("w"), F.col("id") % 3)).alias("tokens")).coalesce(1)
    q = spark.createDataFrame([(1, ["a", "w1"])], "query_id long, terms array<string>")
    hit = materialize(retrieval.hits(q, docs), "hits").coalesce(1)
    got = retrieval.best(q, hit, docs, 3).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [1, 4, 7] and len(seen) == 1
