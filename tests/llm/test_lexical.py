import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k):
    """(item, rank, doc, score) by the formula, one document after another."""
    c = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(x) for _, x in c), sum(x.total() for _, x in c)
    df = Counter(t for _, x in c for t in x)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, x in c:
            m = 10 + 90 * x.total() * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * x[t] // (1000 * x[t] + 8 * m)) for t in want if t in x)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, items, docs, k):
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, row int, term string").repartition(3)
    return sorted([tuple(r) for r in lexical.search(i, d, k).select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = ["Über", "straße", "ÀB", "x1", "the", "The", "中文", "a_b", "it's", " ", "…", "q"]
    text = lambda n: rng.choice([" ", ", ", "\t"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 12))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " ,.;\x00\x7f"), (103, text(9000)), (None, "the x1 the"), (None, "the x1 the"), (7, "Über q"), (7, "Über q"), (105, docs[3][1]), (104, docs[3][1])]
    items = [(1, "the THE über"), (2, "x1 q 中文 straße"), (3, None), (4, "unseen"), (5, "ÀB"), (5, "àb x1"), (None, "it's a_b"), (6, "")]
    return items, docs


@pytest.mark.parametrize("rows", [lexical.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, rows):
    """With broadcast terms, and with shuffled ones."""
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", rows)
    items, docs = corpus()
    assert got(spark, items, docs, 4) == brute(items, docs, 4)
    assert got(spark, items, docs, 1000) == brute(items, docs, 1000)


def test_empty_tables(spark):
    items, docs = corpus()
    assert got(spark, [], docs, 3) == got(spark, items, [], 3) == got(spark, items, [(1, None), (2, "...")], 3) == []


def test_postings_are_dealt_by_term_and_part(spark):
    d = spark.createDataFrame([(i, "the " * (i % 3 + 1) + f"w{i}") for i in range(400)], "doc_id long, text string")
    p = lexical.postings(lexical.counted(d))
    assert p.count() == 800
    assert p.where("term = 'the'").select("part").distinct().count() == lexical.PARTS
    assert {r["tf"] for r in p.where("term = 'the'").collect()} == {1, 2, 3}
