"""Boolean retrieval, adaptive retrieval and evolution against plain versions."""

import random

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.operators import adaptive, boolean, evolution

DOCS = "doc long, tokens array<string>"


def test_clauses_with_phrases_and_musts(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "d", "e"]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 14))]) for i in range(120)]
    queries = {1: [["a b", "c c c"], ["d"]], 2: [["a b c"]], 3: [["e", "d"]], 4: [["a", "zz"], ["b b"], ["c d"]], 5: [["..."], ["a"]], 6: [["a", "..."]], 7: [["b", "B "]]}
    rows = [(q, n, alt) for q, cs in queries.items() for n, c in enumerate(cs) for alt in c]
    got = boolean.matching(spark.createDataFrame(rows, "query_id int, clause int, alternative string"), spark.createDataFrame(docs, DOCS).repartition(3)).collect()
    want = set()
    for q, cs in queries.items():
        cs = [{" ".join(w for w in a.lower().split() if w.isalnum()) for a in c} for c in cs]
        for d, t in docs:
            said = f" {' '.join(t)} "
            held = [sum(bool(a) and f" {a} " in said for a in c) for c in cs]
            if all(held):
                want.add((q, d, sum(held)))
    assert {(r["query_id"], r["doc"], r["alternatives"]) for r in got} == want and len(got) == len(want)


def test_expression_keeps_musts(spark):
    rows = [(["deep learning", "graph", "Graph", "x/y"], ["protein"]), (["m"], ["m"]), ([], ["a b", "c"]), (["w" * 100, "v" * 100, "u" * 100], ["must " * 20]), (["(odd)", "", None], [])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, m array<string>").select(boolean.expression(F.array_compact("a"), F.col("m"))).collect()]
    assert got[0] == '(all:"deep learning" OR all:graph OR all:"x y") AND all:protein'
    assert got[1] == "all:m" and got[2] == 'all:"a b" AND all:c' and got[4] == "(all:odd)"
    assert got[3] == f'(all:{"w" * 100}) AND all:"{("must " * 20).strip()}"' and len(got[3]) <= C.DISJUNCTIVE_LENGTH
    long = spark.createDataFrame([(["x"], ["y" * 300])], "a array<string>, m array<string>").select(boolean.expression(F.col("a"), F.col("m"))).first()[0]
    assert long == "all:" + "y" * 300


def _gaps(spark, rows):
    schema = "query_id long, topics array<string>, methods array<string>, datasets array<string>, required array<string>, needs_evolution boolean"
    return spark.createDataFrame(rows, schema)


def test_seeds_equal_a_sequential_choice(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(7)]
    titles = [" ".join(rng.sample(words, rng.randint(0, 6))) for _ in range(150)]
    judged = [(i % 5, i, t, rng.choice(["text on graphs", "text", ""]), "V", 2000, rng.choice(["highly_relevant", "partially_relevant", "irrelevant"]), rng.choice([0.3, 0.5, 0.5, 0.9])) for i, t in enumerate(titles)]
    d = spark.createDataFrame(judged, "query_id long, doc long, title string, abstract string, venue string, year int, category string, score double").repartition(4)
    gaps = _gaps(spark, [(q, ["graphs", "word1"], [], [], [], q != 4) for q in range(5)])
    got = {}
    for r in evolution.gap_seeds(gaps, d).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["doc"]
    for q in range(5):
        ordered = []
        for _, doc, t, a, _, _, c, s in (x for x in judged if x[0] == q):
            hit = any(w in f" {t} {a} v ".split() for w in ("graphs", "word1"))
            if (t or a) and (c == "highly_relevant" or (c == "partially_relevant" and s >= 0.45 and hit)):
                ordered.append((c != "highly_relevant", not hit, not (t and a), -s, doc, set(t.split())))
        taken = []
        for x in sorted(ordered, key=lambda x: x[:5]):
            near = any(y[5] and x[5] and len(y[5] & x[5]) / len(y[5] | x[5]) >= 0.8 for y in taken)
            if not near and len(taken) < 3 and q != 4:
                taken.append(x)
        assert [got.get(q, {}).get(i + 1) for i in range(len(taken))] == [x[4] for x in taken] and len(got.get(q, {})) == len(taken) <= 3


def test_present(spark):
    rows = [("c++", "we use c++ daily", True), ("rag", "storage", False), ("rag", "rag-based", True), ("deep net", "a deep network", True), ("net", "a network", False), ("", "x", False), ("c", "c++ and c", True), ("gpt-4", "gpt-4o", False)]
    got = spark.createDataFrame(rows, "t string, x string, want boolean").select(evolution.present(F.col("t"), F.col("x")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_only_insufficient_queries_are_searched_again(spark):
    schema = "query_id long, candidates int, core_terms int, core_matched int, dimensions int, missing array<string>, with_metadata int, succeeded boolean"
    facts = [(1, 10, 3, 3, 0, [], 10, True), (2, 0, 3, 0, 0, [], 0, True), (3, 10, 6, 2, 0, [], 10, True), (4, 9, 1, 1, 2, ["methods", "venues"], 3, True), (5, 2, 1, 1, 0, [], 2, False), (6, 2, 1, 1, 0, [], 2, True), (7, 2, 1, 1, 0, [], 2, True), (8, 2, 1, 1, 0, [], 2, True)]
    judged = adaptive.sufficiency(spark.createDataFrame(facts, schema), 10)
    assert {r["query_id"]: r["reasons"] for r in judged.collect()} == {1: [], 2: ["empty"], 3: ["low_core_coverage"], 4: ["missing_methods", "low_constraint_coverage", "low_metadata_coverage"], 5: ["failed", "few_candidates"], 6: ["few_candidates"], 7: ["few_candidates"], 8: ["few_candidates"]}
    forms = [(i, "long query", "short", 0.9) for i in range(1, 6)] + [(6, "Same  Query", "same query", 1.0), (7, "long query", "short", 0.4), (8, "long query", "short", 0.9)]
    decided = adaptive.decisions(judged, spark.createDataFrame(forms, "query_id long, safe string, compact string, retention double"), spark.createDataFrame([(8,)], "query_id long"))
    assert {r["query_id"]: r["skip"] for r in decided.collect()} == {1: "sufficient_results", 2: None, 3: None, 4: None, 5: "source_failed", 6: "equivalent_query", 7: "low_information_retention", 8: "budget_exhausted"}
    first = spark.createDataFrame([(q, 100 + r, r) for q in (1, 3, 4) for r in range(1, 4)], "query_id long, doc long, rank int")
    asked = []

    def search(q):
        asked.extend(sorted(r["query_id"] for r in q.collect()))
        return q.select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (101, 7, 8, 9)])).alias("doc")).withColumn("rank", F.when(F.col("doc") == 101, 1).otherwise(F.col("doc") - 5))

    got = {}
    for r in adaptive.second_pass(first, decided, search, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc"], r["step"]))
    assert asked == [2, 3, 4]
    assert sorted(got[1]) == [(1, 101, "safe"), (2, 102, "safe"), (3, 103, "safe")]
    assert sorted(got[3])[3:] == [(4, 7, "compact"), (5, 8, "compact")] and sorted(got[2]) == [(1, 101, "compact"), (2, 7, "compact"), (3, 8, "compact"), (4, 9, "compact")]
