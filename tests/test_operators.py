"""Semantics that are easy to get wrong."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, fusion, graph, identity, judgement, metrics, planning, retrieval, stats
from lectern.shared import materialize
from lectern.sources import corpora


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def papers(spark, *ps):
    base = {"title": "", "abstract": "", "authors": [], "year": None, "venue": None, "source": "s", "citation_count": None, "doi": None, "arxiv_id": None, "openalex_id": None, "semantic_scholar_id": None, "s2orc_corpus_id": None, "pubmed_id": None}
    kind = "paper_id long, title string, abstract string, authors array<string>, year int, venue string, source string, citation_count int, doi string, arxiv_id string, openalex_id string, semantic_scholar_id string, s2orc_corpus_id string, pubmed_id string"
    return spark.createDataFrame([(i, *(base | p).values()) for i, p in enumerate(ps)], kind)


def clusters(spark, *ps):
    return [c for _, c in rows(identity.clusters(papers(spark, *ps)), "paper_id")]


def test_identity_rules(spark):
    """All cases in one table: their identifiers and titles do not meet."""
    same = {"title": "A {\\em B}!", "year": 2001, "authors": ["X Y"]}
    other = {"title": "C", "year": 2001, "authors": ["X Y"]}
    got = clusters(
        spark, {"doi": "10.1/A"}, {"doi": "https://doi.org/10.1/a?x"}, {"doi": "10.1/b"},
        {"doi": "10.48550/arXiv.2101.1v2"}, {"arxiv_id": "2101.1v5"},
        {"doi": "10.1/c", "arxiv_id": "1"}, {"doi": "10.1/c", "arxiv_id": "2"},  # a conflict vetoes
        same, same | {"title": "a b"}, same | {"year": 2002}, same | {"authors": ["Z"]},
        other, other | {"s2orc_corpus_id": "9"},  # no title match then
        {}, {}, {"doi": "1", "pubmed_id": "5"}, {"pubmed_id": "5", "openalex_id": "W1"}, {"openalex_id": "w1"})
    assert got == [0, 0, 2, 3, 3, 5, 6, 7, 7, 9, 10, 11, 12, 13, 14, 15, 15, 15]


def test_merge_is_strict(spark):
    p = papers(spark, {"title": "Untitled work of length", "abstract": "ab", "source": "A", "year": None, "doi": "1", "citation_count": 3}, {"title": "Short", "abstract": "cd", "source": "a ", "year": 2001, "doi": "1"},
               {"title": "Other", "abstract": "abc", "source": "b", "year": 2002, "doi": "1"})
    c = materialize(identity.clusters(p), "clusters")
    record = materialize(identity.merged(p, c), "merged")
    r = record.first()
    assert (r["title"], r["abstract"], r["year"], r["citation_count"], r["sources"], r["members"]) == ("Short", "abc", 2001, 3, ["a", "b"], 3)
    assert rows(identity.lineage(p, c, record).where("field = 'title'")) == [(0, "title", 1)]


def ranked(spark, *r):
    return spark.createDataFrame(list(r), "query_id long, doc long, rank int")


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = ranked(spark, (1, 10, 1), (1, 10, 2), (1, 11, 3))
    g = spark.createDataFrame([(1, 10, 2), (1, 10, 1), (1, 11, 1), (1, 12, 0), (1, 13, -1)], "query_id long, doc long, grade int")
    got = {x["query_id"]: x for x in metrics.per_query(q, r, g, (2, 5)).collect()}
    a = got[1]
    assert (a["gold"], a["recall_2"], a["precision_2"], a["recall_5"], a["precision_5"], a["mrr"]) == (2, 0.5, 0.5, 1.0, 0.4, 1.0)
    assert a["ndcg_5"] == pytest.approx((3 / 1 + 1 / 2) / (3 / 1 + 1 / 1.584962500721156), abs=1e-6)
    assert got[2]["gold"] == 0 and got[2]["ndcg_5"] == 0 and got[2]["f1_5"] == 0
    assert metrics.macro(metrics.per_query(q, r, g, (2,))).first()["recall_2"] == 0.25


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 5, 9), (1, "b", 5, 2), (1, "b", 6, 1)], "query_id long, list string, doc long, rank int")
    assert [(d, s) for _, d, s, *_ in rows(fusion.rrf(lists), "rank")] == [(5, round(1 / 61 + 1 / 62, 9)), (6, round(1 / 61, 9))]
    c = spark.createDataFrame([(1, "a", d, d) for d in range(4)] + [(1, "b", 0, 1), (1, "b", 9, 2)], "query_id long, source string, doc long, position int")
    assert [r[1] for r in rows(fusion.round_robin(c, 3), "rank")] == [0, 9, 1]
    assert len(rows(fusion.round_robin(c, 30))) == 5
    a, b = ranked(spark, (1, 1, 1), (1, 2, 2)), ranked(spark, (1, 2, 1), (1, 3, 2))
    assert rows(fusion.overlap(a, b, 2)) == [(1, pytest.approx(1 / 3), 1, 1.0)]
    assert rows(fusion.rbo(a, a, 0.9, 2))[0][1] == pytest.approx(1.0)


def test_bm25_pads_and_ties(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["rag model", "rag model", "other", "", "more"])], "doc long, text string")
    q = spark.createDataFrame([(1, ["rag"]), (2, ["nothing"])], "query_id long, terms array<string>")
    post = retrieval.postings(docs, "doc", T.tokens(F.col("text")))
    r = retrieval.top_k(retrieval.bm25(q, post, docs.select("doc")), 3)
    assert [(a, b) for a, b, *_ in rows(r, "query_id", "rank")] == [(1, 0), (1, 1)]
    p = retrieval.pad(r, q, docs, 3)
    assert [(x["query_id"], x["doc"], x["rank"]) for x in p.orderBy("query_id", "rank").collect()] == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]


def test_judgement_rules(spark):
    q = judgement.analysed(spark.createDataFrame([(1, "retrieval since 2020")], "query_id long, text string"), 2025)
    c = spark.createDataFrame([(1, 1, "Retrieval", "retrieval", "x", 2021, 5, 1, 1), (1, 2, "none", "retrieval", "x", None, 0, 1, 1), (1, 3, "Retrieval", "", "x", 2017, 0, 1, 1)], "query_id long, doc long, title string, abstract string, venue string, year int, citation_count int, n_sources int, n_ids int")
    j = {r["doc"]: r for r in judgement.judge(q.join(c, "query_id")).collect()}
    assert (j[1]["s_topic"], j[2]["s_topic"]) == (0.12, 0.06)  # the title's hit hides the abstract's
    assert (j[1]["s_time"], j[2]["s_time"], j[3]["s_time"]) == (0.08, 0.0, -0.15)
    r = judgement.rerank(judgement.breakdown(judgement.judge(q.join(c, "query_id"))))
    t = {x["doc"]: x["timeliness"] for x in r.collect()}
    assert t[2] == 0.0 and t[3] == 0.0 and t[1] == 0.85
    assert sorted(x["rank"] for x in r.collect()) == [1, 2, 3]
    e = q.join(c, "query_id").withColumn("excludes", F.array(F.lit("none")))
    assert {x["doc"]: x["score"] for x in judgement.judge(e).collect()}[2] == 0.0


def test_jaccard_of_nothing_and_planning(spark):
    e = spark.range(1).select(F.array().cast("array<string>").alias("a"))
    assert e.select(T.jaccard(F.col("a"), F.col("a")), T.jaccard(F.col("a"), F.col("a"), 1.0)).first() == (0.0, 1.0)
    q = judgement.analysed(spark.createDataFrame([(1, "RAG methods on the SciFact dataset at ACL since 2020")], "query_id long, text string"), 2025)
    assert [r[0] for r in rows(planning.facets(q).select("facet", "priority"), "priority")] == ["method", "dataset", "type", "venue", "temporal"]
    assert [r[1] for r in rows(planning.subqueries(q, 3).select("place", "purpose"))] == ["original", "keywords", "method"]
    new = planning.new_queries(spark.createDataFrame([(1, "A b!"), (1, "c")], "query_id long, text string"), spark.createDataFrame([(1, "a B")], "query_id long, text string"))
    assert [r["text"] for r in new.collect()] == ["c"]
    assert planning.profile("fast", 30) == (10, 2) and planning.profile("high_recall", 10) == (30, 5)


def test_permutation_and_kappa(spark):
    d = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 0.0])], "g string, i int, d double")
    assert rows(stats.exact_sign_flip(d, "d", ["g"], "i")) == [("g", 0.25)]
    p = rows(stats.sign_flip(d, "d", ["g"], "i", rounds=99))[0][1]
    assert (p * 100) % 1 == pytest.approx(0, abs=1e-6) or (p * 100) % 1 == pytest.approx(1, abs=1e-6)
    k = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "a int, b int")
    assert rows(stats.kappa(k, "a", "b")) == [(4, 0.75, 0.5)]


def test_similar_queries_lose_nothing(spark):
    import random

    rng = random.Random(5)
    sets = [[f"w{x}" for x in rng.sample(range(14), rng.randint(6, 10))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "query_id long, text string")
    got = {(a, b) for a, b, _ in rows(audit.similar_queries(df))}
    reps = {}
    for i, s in enumerate(sets):
        reps.setdefault(frozenset(s), i)
    want = {(min(i, j), max(i, j)) for a, i in reps.items() for b, j in reps.items() if i < j and len(a & b) / len(a | b) >= 0.8}
    assert got == want
    comp = dict(rows(audit.independence(df)))
    assert all(comp[a] == comp[b] for a, b in want)


def test_similar_queries_write_few_candidates(spark, monkeypatch):
    """Sets that share a rare token but little else are ruled out in the join, in long sets too; what is written holds every pair."""
    import random

    rng, sets = random.Random(8), []
    for i in range(120):
        own = {f"c{i % 6}", *(f"w{x}" for x in rng.sample(range(3000), rng.choice([12, 40, 150])))}
        sets += [own, own - set(rng.sample(sorted(own), len(own) // 10)) | {f"n{i}"}]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "query_id long, text string")
    kept, write = {}, audit.materialize
    monkeypatch.setattr(audit, "materialize", lambda d, tag, **kind: kept.setdefault(tag, write(d, tag, **kind)))
    got = {(a, b) for a, b, _ in rows(audit.similar_queries(df))}
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert len(got) > 60 and kept["candidates"].count() < 2 * len(got)


def test_inverted_in_the_row(spark):
    texts = [(1, "b a b c a b".split()), (2, []), (3, None), (4, ["x"])]
    d = spark.createDataFrame(texts, "i int, t array<string>").select("i", corpora.inverted(F.col("t")).alias("m"))
    assert {r["i"]: r["m"] for r in d.collect()} == {1: {"a": [1, 4], "b": [0, 2, 5], "c": [3]}, 2: None, 3: None, 4: {"x": [0]}}
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "1", "title": " T ", "authors": "A, B,A", "update_date": "2019-03-02"}, {"paper_id": "1", "Title": "Z"}, {"id": "2"}, {"title": "x"}]) + "\n\n")
    got, report = corpora.convert(corpora.read_records(spark, str(tmp_path / "a.jsonl")))
    assert [(r["id"], r["title"], r["authors"], r["year"]) for r in got.collect()] == [("1", "T", ["A", "B"], 2019)]
    assert dict(rows(report)) == {"missing_title": 1, "missing_id": 1, "repeated_id": 1}
    (tmp_path / "m.json").write_text(json.dumps({"7": "Title seven", "8": {"title": "Eight", "abstract": "a"}}))
    m, _ = corpora.convert(corpora.read_records(spark, str(tmp_path / "m.json"), "map"))
    assert sorted((r["id"], r["title"], r["abstract"]) for r in m.collect()) == [("7", "Title seven", ""), ("8", "Eight", "a")]
    e = spark.createDataFrame([("k", "one")], "key string, content string")
    path = str(tmp_path / "snap")
    assert corpora.write_snapshots(e, path).count() == 0
    assert corpora.write_snapshots(spark.createDataFrame([("k", "two"), ("l", "x")], e.schema), path).count() == 1
    stored = spark.read.parquet(path)
    assert {r["key"]: r["status"] for r in corpora.replay(spark.createDataFrame([(1, "k"), (2, "q")], "query_id long, key string"), stored).collect()} == {"k": "hit", "q": "missing"}
    p = corpora.paragraphs(spark.createDataFrame([(1, "ab\n\n\ncde\n\nf")], "id long, t string"), "id", "t")
    assert [(r["paragraph"], r["start"], r["end"]) for r in p.orderBy("index").collect()] == [("ab", 0, 2), ("cde", 5, 8), ("f", 10, 11)]
    assert spark.sql("SELECT map('b', array(1), 'a', array(0, 2)) AS m").select(corpora.inverted_abstract(F.col("m"))).first()[0] == "a b a"


def test_graph_limits(spark):
    seeds = ranked(spark, (1, 1, 1), (1, 2, 2))
    edges = spark.createDataFrame([(d, r) for d in (1, 2) for r in range(9)], "doc long, ref long")
    assert len(rows(graph.references(seeds, edges, per_seed=3, total=5))) == 5
    assert dict((d, k) for _, d, k in rows(graph.citation_nodes(seeds, graph.references(seeds, edges, 3, 5))))[2] == "ranked"


def test_guard_of_clusters(spark):
    """No cluster has two values of a field; clusters are connected; without conflicts nothing changes."""
    import random

    from lectern.operators import identity

    rng = random.Random(9)
    recs = []
    for i in range(120):
        t = rng.randrange(14)
        recs.append((i, f"A title number {t}", [f"Author {t % 3}", f"Author {rng.randrange(6)}"], 2000 + t % 2, f"10.1/d{rng.randrange(40)}" if rng.random() < 0.4 else None, f"2001.{rng.randrange(30):05d}" if rng.random() < 0.3 else None))
    df = spark.createDataFrame(recs, "paper_id long, title string, authors array<string>, year int, doi string, arxiv_id string")
    got = {r["paper_id"]: r["cluster"] for r in identity.clusters(df).collect()}
    loose = {r["paper_id"]: r["cluster"] for r in identity.clusters(df, guard=False).collect()}
    members, ties = {}, {}
    for i, c in got.items():
        members.setdefault(c, set()).add(i)
    for i, c in loose.items():
        ties.setdefault(c, set()).add(i)
    doi, arx = {r[0]: r[4] for r in recs}, {r[0]: r[5] for r in recs}
    several = lambda m: any(len({v[i] for i in m if v[i]}) > 1 for v in (doi, arx))
    assert any(several(m) for m in ties.values()) and not any(several(m) for m in members.values())
    assert all(min(m) == c for c, m in members.items())
    assert all(m in members.values() for m in ties.values() if not several(m))

    def linked(a, b):
        if any(v[a] and v[b] and v[a] != v[b] for v in (doi, arx)):
            return False
        same = recs[a][1] == recs[b][1] and recs[a][3] == recs[b][3] and set(recs[a][2]) & set(recs[b][2])
        return bool(any(v[a] and v[a] == v[b] for v in (doi, arx)) or same)

    for m in members.values():
        seen, todo = set(), [min(m)]
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += [v for v in m if linked(u, v)]
        assert seen == m


def test_power_by_the_normal_distribution(spark):
    from statistics import NormalDist

    d = spark.createDataFrame([(2.0,), (0.0,), (None,)], "sd double").select("sd", stats.power(F.col("sd"), 0.1, future=900).alias("p")).select("sd", "p.*").collect()
    z = NormalDist()
    shift = 0.1 * 30 / 2
    want = 1 - z.cdf(z.inv_cdf(0.975) - shift) + z.cdf(-z.inv_cdf(0.975) - shift)
    got = {r["sd"]: r for r in d}
    assert got[2.0]["required"] == math.ceil(((z.inv_cdf(0.975) + z.inv_cdf(0.8)) * 2 / 0.1) ** 2) and got[2.0]["power"] == pytest.approx(want)
    assert not got[0.0]["available"] and got[None]["required"] is None and got[0.0]["power"] is None
