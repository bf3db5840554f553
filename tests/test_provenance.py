"""Provenance and ledgers against plain versions on made cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import identity, provenance
from lectern.sources import ledger

PAPERS = "paper_id long, title string, authors array<string>, year int, doi string, arxiv_id string, semantic_scholar_id string"


def _profiles(spark, rows):
    return identity.profiles(spark.createDataFrame(rows, PAPERS))


def _hash(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_tie_keys(spark):
    p = _profiles(spark, [(1, "A Title", ["Zoë", "Ann B"], 2001, "10.1/X", "1234.5v2", None), (2, "A title!", ["Ann B", "Zoë"], 2001, None, None, None), (3, "", None, None, None, None, None), (4, "", None, None, None, None, None), (5, None, [], None, None, None, None), (6, "", None, None, None, None, None)])
    details = [(3, ["Web ", "web", ""], ["record:b", "record:a", "record:a"], "ＡＣＬ  Long\n", 3), (4, ["x"], ["row:1"], "", None), (5, None, None, None, None)]
    got = {r["paper_id"]: r["tie_key"] for r in provenance.tie_keys(p, spark.createDataFrame(details, "paper_id long, sources array<string>, refs array<string>, abstract string, citation_count int")).collect()}
    assert got[1] == "0:" + _hash({"kind": "stable_identifiers", "identifiers": ["arxiv:1234.5", "doi:10.1/x"]})
    assert got[2] == "1:" + _hash({"kind": "exact_title_author_year", "title": "a title", "authors": ["ann b", "zoë"], "year": 2001})
    fields = {"title": "", "authors": [], "year": None, "venue": "", "abstract": "acl long", "landing_page": "", "pdf": "", "citation_count": 3}
    assert got[3] == "2:" + _hash({"kind": "source_record_and_normalized_fields", "sources": ["web"], "source_record_refs": ["record:a", "record:b"], "field_summary_sha256": _hash(fields)})
    assert got[4] is None and got[5] is None and got[6] is None and len(got) == 6


def test_stable_order_and_strict(spark):
    base = ("highly_relevant", 0.5, 0.5, 3, 2000, "T")
    rows = [(1, 10, *base), (1, 11, *base), (1, 12, *base), (1, 13, "irrelevant", 0.9, 0.9, None, None, None), (2, 10, *base), (1, 14, "highly_relevant", 0.5, 0.5, -1, 2000, "T")]
    s = spark.createDataFrame(rows, "query_id long, doc long, category string, final double, score double, citation_count int, year int, title string")
    keys = spark.createDataFrame([(10, "0:b"), (11, "0:a"), (12, "0:b"), (14, "0:b")], "paper_id long, tie_key string")
    got = {(r["query_id"], r["doc"]): (r["rank"], r["tie"]) for r in provenance.stable_order(s, keys).collect()}
    assert got[(1, 11)] == (1, None) and {got[(1, 10)], got[(1, 12)]} == {(2, "collision"), (3, "collision")} and got[(1, 14)] == (4, None) and got[(1, 13)] == (5, "unavailable") and got[(2, 10)] == (1, None)
    sound = provenance.stable_order(s.where("doc in (11, 14) or query_id = 2"), keys, strict=True)
    assert sorted(r["rank"] for r in sound.collect()) == [1, 1, 2]
    for bad in ("doc in (10, 12)", "doc = 13"):
        with pytest.raises(Exception, match="tie_"):
            provenance.stable_order(s.where(bad), keys, strict=True).collect()


def test_order_does_not_depend_on_input(spark):
    r = random.Random(5)
    rows = [(q, d, "highly_relevant", 0.5, r.choice([0.1, 0.2]), r.choice([1, 2]), 2000, r.choice("ab")) for q in range(3) for d in range(40)]
    schema = "query_id long, doc long, category string, final double, score double, citation_count int, year int, title string"
    keys = spark.createDataFrame([(d, f"1:{d * 7919 % 101:03d}") for d in range(40)], "paper_id long, tie_key string")
    want = {}
    for q in range(3):
        for i, x in enumerate(sorted((x for x in rows if x[0] == q), key=lambda x: (-x[4], -x[5], x[7], f"1:{x[1] * 7919 % 101:03d}")), 1):
            want[(q, x[1])] = i
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = provenance.stable_order(spark.createDataFrame(rows, schema).repartition(seed + 2), keys)
        assert {(x["query_id"], x["doc"]): x["rank"] for x in got.collect()} == want


LINE = {"paper_identifier": "doi:10.1/x", "signal_name": "retraction_status", "state": "clear", "source": "s", "source_record_id": "r"}


def _line(**other):
    return json.dumps(LINE | other)


def test_ledger_lines(spark):
    lines = [_line(), _line(state="flagged"), _line(signal_name="duplicate_risk"), "  ", None, "[]", '"x"', "{", '{"a":NaN}', _line()[:-1] + ', "state": "clear"}', _line() + " x", _line() + _line(), _line(extra="x"), _line(state="maybe"),
             _line(source=""), _line(source=None), _line(source=3), _line(source={"source": "s"}), _line(paper_identifier="10.1/x"), _line(paper_identifier="doi:10.1/X"), _line(paper_identifier="arxiv:1234.5v1"), _line(paper_identifier="arxiv:1234.5"),
             _line(schema_version="other"), _line(paper_identifier="s2:abc", schema_version=ledger.VERSION), json.dumps({k: v for k, v in LINE.items() if k != "state"}), _line(paper_identifier="doi:10.1/y", source='a "quoted" \\ é\n' + "x" * 100000), "{}", _line()[:-1] + ",}"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string").repartition(4)
    got = {r["line"]: r["problem"] for r in ledger.read(df).collect()}
    bad = {2: "duplicate_signal", 6: "invalid_line", 7: "invalid_line", 8: "invalid_line", 9: "invalid_line", 10: "invalid_line", 11: "invalid_line", 12: "invalid_line", 13: "schema_invalid", 14: "schema_invalid", 15: "schema_invalid", 16: "invalid_line", 17: "invalid_line",
           18: "invalid_line", 19: "identifier_invalid", 20: "identifier_invalid", 21: "identifier_invalid", 23: "schema_invalid", 25: "schema_invalid", 27: "schema_invalid", 28: "invalid_line"}
    assert got == {i: bad.get(i) for i in range(1, len(lines) + 1) if i not in (4, 5)}
    with pytest.raises(ledger.LedgerError, match="duplicate_signal:2"):
        ledger.verified(df)
    with pytest.raises(ledger.LedgerError, match="empty"):
        ledger.verified(df.where("line = 4"))
    assert ledger.verified(df.where("line in (1, 3, 22)")).count() == 3


def test_verified_evidence(spark):
    p = _profiles(spark, [(1, "t", None, None, "10.1/a", "1.1", None), (2, "t", None, None, "10.1/a", None, None), (3, "t", None, None, None, None, None), (4, "t", None, None, None, "2.2", None)])
    says = spark.createDataFrame([("doi:10.1/a", "retraction_status", "clear", "r"), ("arxiv:1.1", "retraction_status", "flagged", "r"), ("arxiv:1.1", "duplicate_risk", "clear", "r"), ("doi:10.9/z", "duplicate_risk", "clear", "r")], "paper_identifier string, signal_name string, state string, source_record_id string")
    got = {(r["paper_id"], r["signal_name"]): (r["state"], r["records"]) for r in provenance.verified(p, says).collect()}
    assert got == {(1, "retraction_status"): ("conflict", 2), (1, "duplicate_risk"): ("clear", 1), (2, "retraction_status"): ("clear", 1)}


def test_gold_relations(spark):
    rows = [(1, "T", ["A"], 2000, "10.1/a", None, None), (2, "T", ["A"], 2000, "10.1/b", "1.1", None), (3, "T", ["A"], 2000, None, None, None), (4, "T", None, None, None, None, None), (5, "", None, None, None, None, None), (6, None, None, 1999, None, None, None)]
    m = spark.createDataFrame([("conflict", 1), ("conflict", 2), ("id", 1), ("id", 3), ("title", 3), ("title", 5), ("some", 4), ("none", 5), ("year", 6)], "g string, paper_id long").join(_profiles(spark, rows), "paper_id")
    got = {r["g"]: (r["status"], r["identified"], r["conflicts"]) for r in provenance.gold_relations(m, ["g"]).collect()}
    assert got == {"conflict": ("identifier_conflict", ["arxiv_id", "doi"], ["doi"]), "id": ("stable_identifier_evaluable", ["doi"], []), "title": ("conservative_title_evidence_evaluable", [], []),
                   "some": ("identity_ambiguous", [], []), "none": ("insufficient_information", [], []), "year": ("identity_ambiguous", [], [])}


def test_rank_provenance(spark):
    rows = [(1, "T", ["A"], 2000, "10.1/a", None, None), (2, "U", ["A"], 2000, "10.1/a", None, None), (3, "T", ["A"], 2000, "10.1/c", None, None), (4, "", None, None, None, None, None), (5, "V", ["B"], 2001, None, None, None), (6, "V", ["B"], 2001, None, None, None)]
    entries = [(1, "x", "q", 2, 2), (1, "x", "q", 1, 1), (1, "y", "q", 4, 2), (1, "z", "q", 0, 1), (1, "x", "q", 3, 3), (1, "x", "q", 5, 4), (2, "x", "q", 1, 5), (2, "x", "r", 7, 6)]
    c = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (2, 5), (2, 6), (2, 1)], "query_id long, doc long")
    status, parts = provenance.rank_provenance(c, spark.createDataFrame(entries, "query_id long, source string, subquery string, rank int, doc long"), _profiles(spark, rows))
    got = {(r["query_id"], r["doc"]): (r["lists"], r["rrf_score"], r["status"]) for r in status.collect()}
    assert got == {(1, 1): (2, round(1 / 61 + 1 / 64, 9), "traced"), (1, 3): (1, round(1 / 63, 9), "traced"), (1, 4): (0, 0.0, "missing"), (2, 5): (2, round(1 / 61 + 1 / 67, 9), "ambiguous"), (2, 6): (2, round(1 / 61 + 1 / 67, 9), "ambiguous"), (2, 1): (0, 0.0, "missing")}
    assert {(r["doc"], r["source"], r["rank"]) for r in parts.where("query_id = 1").collect()} == {(1, "x", 1), (1, "y", 4), (3, "x", 3)}


def test_resolutions_and_seeds(spark):
    own = _profiles(spark, [(1, "a", None, None, "10.1/a", "1.1", None), (2, "b", None, None, None, "2.2", None), (3, "c", None, None, "10.1/c", None, "S2:c3"), (4, "d", None, None, None, None, None), (5, "e", None, None, "10.1/a", None, None), (6, "f", None, None, "10.1/f", "6.6", None), (7, "g", None, None, "10.1/g", None, None)])
    found = _profiles(spark, [(90, "a", None, None, "10.1/a", None, "x1"), (91, "a", None, None, "10.1/a", None, "x2"), (92, "b", None, None, None, "2.2", None), (96, "f", None, None, "10.1/f", "9.9", "x6")])
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 8)] + [(2, 1, 5)], "query_id long, rank int, doc long")
    r = provenance.resolutions(ranked, own, found)
    got = {(x["query_id"], x["doc"]): (x["requested"], x["status"], x["rule"], x["semantic_scholar_id"]) for x in r.collect()}
    assert got == {(1, 1): ("doi:10.1/a", "resolved", "shared_stable_identifier", "x1"), (1, 2): ("arxiv:2.2", "conflict", "shared_stable_identifier", None), (1, 6): ("doi:10.1/f", "conflict", "conflicting_stable_identifier", "x6"),
                   (1, 7): ("doi:10.1/g", "missing", None, None), (2, 5): ("doi:10.1/a", "resolved", "shared_stable_identifier", "x1")}
    seeds = sorted((x["query_id"], x["place"], x["rank"], x["semantic_scholar_id"], x["source"]) for x in provenance.expansion_seeds(ranked, own, r, 2).collect())
    assert seeds == [(1, 1, 1, "x1", "resolved"), (1, 2, 3, "c3", "direct"), (2, 1, 1, "x1", "resolved")]
    assert provenance.resolutions(ranked, own, found, 1).where("query_id = 1").count() == 1 and provenance.resolutions(ranked.where("false"), own, found).select(F.count("*")).first()[0] == 0
