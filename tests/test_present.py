"""Presentation against plain versions on made cases."""

import random

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.operators import present

RANKED = "query_id long, rank int, doc long, category string, title string, abstract string, venue string, final double, methods array<string>, matched_terms array<string>, evidence array<struct<source:string,text:string>>"


def _made(seed):
    r = random.Random(seed)
    rows = []
    for q in range(24):
        for rank in range(1, r.randint(2, 30)):
            ev = [(r.choice(["title", "abstract", "venue", "metadata", "full_text", None]), r.choice(["  ", None, "plain  text", "x" * 300, "word " * 60])) for _ in range(r.randint(0, 5))]
            rows.append((q, rank, 100 * q + rank, r.choice(list(C.CATEGORY_MULTIPLIER)), r.choice([None, "Storage agents", "An evaluation", "Plain"]), r.choice(["", None, "reference chain"]), r.choice([None, "", "KDD"]),
                         1 / rank, r.choice([None, [], ["Diffusion ", "plain", "agent", "DIFFUSION"]]), r.choice([None, [], ["b", "a", "c", "d"], ["A"]]), r.choice([None, ev, ev, ev])))
    return rows


def _rows(ranked):
    """One query after the other, rank by rank."""
    out, cited = [], {}
    for q, rank, doc, category, title, _, venue, final, _, terms, ev in sorted(ranked, key=lambda x: (x[0], x[1])):
        good = [e for e in ev or [] if e[0] in C.EVIDENCE_SOURCES and e[1] and e[1].strip()]
        if category in C.NOT_CITED or not good or cited.get(q, 0) >= C.CITED_PAPERS:
            continue
        cited[q] = cited.get(q, 0) + 1
        for i, (source, text) in enumerate(good[:C.EVIDENCE_ROWS], 1):
            flat = " ".join(text.split())
            out.append((q, rank, f"R{rank}-E{i}", source, flat if len(flat) <= 240 else flat[:237].rstrip() + "...", title or "", venue, final, terms or []))
    return out


def test_rows_findings_and_coverage(spark):
    made = _made(1)
    df = spark.createDataFrame(made, RANKED).repartition(3)
    want = _rows(made)
    rows = present.evidence_rows(df)
    got = sorted((r["query_id"], r["rank"], r["row_id"], r["source"], r["text"]) for r in rows.collect())
    assert got == sorted(w[:5] for w in want) and len(got) > 30
    first = {}
    for w in want:
        if w[2].endswith("-E1"):
            first.setdefault(w[0], []).append(w)
    expected = []
    for q, ws in first.items():
        for place, (_, rank, row_id, source, _, title, venue, final, terms) in enumerate(ws[:C.FINDINGS], 1):
            topic = ", ".join(terms[:3]) or (f"evidence from {venue}" if venue else "the search query")
            expected.append((q, place, row_id, final, f"{title} provides {source} evidence for {topic} [R{rank}]."))
    found = present.findings(rows)
    assert sorted((r["query_id"], r["place"], r["row_id"], r["confidence"], r["text"]) for r in found.collect()) == sorted(expected)
    queries = spark.createDataFrame([(q,) for q in [*range(24), 99]], "query_id long")
    cov = {r["query_id"]: r for r in present.coverage(queries, df, rows, found).collect()}
    assert (cov[99]["ranked"], cov[99]["cited"], cov[99]["ratio"]) == (0, 0, 0.0)
    for q in range(24):
        n, keys = sum(x[0] == q for x in made), {w[2].split("-")[0] for w in want if w[0] == q}
        left = sum(len(x[10] or []) - len([e for e in x[10] or [] if e[0] in C.EVIDENCE_SOURCES and e[1] and e[1].strip()]) for x in made if x[0] == q and x[3] not in C.NOT_CITED)
        shown = {f"R{w[1]}" for w in first.get(q, [])[:C.FINDINGS]}
        assert (cov[q]["ranked"], cov[q]["cited"], cov[q]["evidence_rows"], cov[q]["cited_rows"], cov[q]["unsupported"], cov[q]["ratio"]) == (
            n, len(keys), sum(w[0] == q for w in want), sum(w[0] == q and w[2].split("-")[0] in shown for w in want), left, round(len(keys) / n, 4))


def test_themes(spark):
    made = _made(2)
    counts = {}
    for w in _rows(made):
        for t in w[8]:
            counts.setdefault(w[0], {}).setdefault(t, 0)
            counts[w[0]][t] += 1
    want = sorted((q, i, t, n) for q, c in counts.items() for i, (t, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].lower(), x[0]))[:4], 1))
    got = present.themes(present.evidence_rows(spark.createDataFrame(made, RANKED)))
    assert sorted((r["query_id"], r["place"], r["term"], r["n"]) for r in got.collect()) == want


def test_method_groups(spark):
    made = _made(3) + [(50, 1, 1, "irrelevant", "nothing", None, None, 0.1, None, None, None), (50, 2, 2, "irrelevant", None, "", None, 0.1, [" "], None, None)]
    known = {n.lower() for n, _ in C.METHOD_CLUSTERS}
    groups = {}
    for q, rank, _, _, title, abstract, _, _, methods, _, ev in made:
        text = " ".join([title or "", abstract or "", *[e[1] or "" for e in ev or []]]).lower()
        names = [(n.lower(), words) for n, words in C.METHOD_CLUSTERS] + [(m.strip().lower(), (m.strip().lower(),)) for m in methods or [] if m.strip() and m.strip().lower() not in known]
        own = groups.setdefault(q, {})
        for n, words in names:
            if any(w.lower() in text for w in words):
                own.setdefault(n, set()).add(rank)
    for q, own in groups.items():
        if not own:
            own["general"] = {x[1] for x in made if x[0] == q}
    got = {}
    for r in present.method_clusters(spark.createDataFrame(made, RANKED)).collect():
        got.setdefault(r["query_id"], {})[r["name"].lower()] = set(r["ranks"])
        assert r["ranks"] == sorted(r["ranks"])
    assert got == groups and got[50] == {"general": {1, 2}}


def test_evidence_shows_each_place_once(spark):
    rows = [(1, "neural ranking of papers", "computer_science", ["missing"], ["survey"], ["k d-d"], (2000, None), "Neural nets", "We rank. This SURVEY covers ranking! No more", "KDD", 2001),
            (2, "neural", "general_science", [], [], [], None, None, None, None, None), (3, None, None, None, None, None, None, "", "", "", 5)]
    df = spark.createDataFrame(rows, "query_id long, text string, domain string, must array<string>, types array<string>, venues array<string>, years struct<start_year:int,end_year:int>, title string, abstract string, venue string, year int")
    got = {r["query_id"]: r for r in present.evidence(df).select("query_id", "matched_terms", "evidence").collect()}
    assert got[1]["matched_terms"] == ["neural", "ranking", "survey"]
    assert [tuple(e) for e in got[1]["evidence"]] == [("title", "Neural nets"), ("abstract", "This SURVEY covers ranking!"), ("venue", "KDD"), ("metadata", "year=2001")]
    assert got[2]["matched_terms"] == [] and got[2]["evidence"] == [] and not got[3]["evidence"]


def test_empty_ranking(spark):
    none = spark.createDataFrame([], RANKED)
    rows = present.evidence_rows(none)
    assert rows.count() == 0 and present.findings(rows).count() == 0 and present.themes(rows).count() == 0 and present.method_clusters(none).count() == 0
    assert present.coverage(spark.createDataFrame([(1,)], "query_id long"), none, rows, present.findings(rows)).select(F.sum("ratio")).first()[0] == 0
