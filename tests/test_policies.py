"""Plan policies against plain versions on made cases."""

from lectern.operators import policies

SCHEMA = ("query_id long, text string, must array<string>, methods array<string>, datasets array<string>, types array<string>, venues array<string>, "
          "years struct<start_year:int,end_year:int>, excludes array<string>, explicit array<string>, own_terms array<string>")
NOW = "query_id long, place int, purpose string, text string"


def _row(q, text, must=(), methods=(), datasets=(), types=(), venues=(), years=None, excludes=(), explicit=(), own=()):
    return (q, text, list(must), list(methods), list(datasets), list(types), list(venues), years, list(excludes), list(explicit), list(own))


def _plan(df):
    return [(r["query_id"], r["place"], r["purpose"], r["text"]) for r in df.orderBy("query_id", "place").collect()]


def test_facets_are_balanced(spark):
    rows = [_row(1, "graph networks for protein folding", methods=["GNN"], datasets=["PDB"], years=(2020, None), explicit=["datasets", "must"], must=["folding"]),
            _row(2, "Graph"), _row(3, ""), _row(4, None), _row(5, "graph networks", methods=["graph"], types=["survey"], venues=["ACL"])]
    got = _plan(policies.balanced(spark.createDataFrame(rows, SCHEMA), 3))
    assert got[:3] == [(1, 1, "original", rows[0][1]), (1, 2, "facet_dataset", "folding graph networks protein PDB"), (1, 3, "facet_topic_compact", "folding graph networks protein")]
    assert [g for g in got if g[0] == 2] == [(2, 1, "original", "Graph")]  # one topic term makes no search of its own
    assert [g[:3] for g in got if g[0] in (3, 4)] == [(3, 1, "original"), (4, 1, "original")]
    five = [g for g in got if g[0] == 5]
    assert [g[2] for g in five] == ["original", "facet_method", "facet_paper_type"] and five[1][3] == "networks graph"


def test_nothing_is_appended_beyond_the_limit_or_twice(spark):
    q = [_row(i, "causal inference with neural ranking", methods=["neural ranking"], explicit=["methods"]) for i in (1, 2, 3)]
    now = [(1, 1, "original", "x"), (1, 2, "keywords", "y"), (2, 1, "original", "x"), (2, 2, "keywords", "y"), (2, 3, "method", "z"), (3, 1, "original", '"Neural  Ranking"')]
    got = _plan(policies.with_facet(spark.createDataFrame(q, SCHEMA), spark.createDataFrame(now, NOW), 2))
    assert got == sorted(now + [(1, 3, "facet_union_method", '"neural ranking"')])


def test_topic_terms_of_most_letters_in_their_order(spark):
    q = [_row(1, "tiny graph transformers predict crystalline materials"), _row(2, "graph"), _row(3, "")]
    now = [(i, 1, "original", "x") for i in (1, 2, 3)]
    got = _plan(policies.with_facet(spark.createDataFrame(q, SCHEMA), spark.createDataFrame(now, NOW), 3))
    assert [g for g in got if g[2] != "original"] == [(1, 2, "facet_union_topic", "transformers crystalline materials")]


def test_concepts_stand_as_the_query_names_them(spark):
    text = "The 3rd Graph  Neural network of C++ without subgraph, graph neural NETWORK, and year (beta) topics\\E"
    rows = [_row(1, text, must=["graph neural network", "year", "3rd", "C++", "missing", "topics\\E", "subgraph"], excludes=["beta"]), _row(2, "alpha beta", must=["alpha", "beta"]), _row(3, None, must=["a"]), _row(4, "x alpha", must=["alpha"], excludes=["alpha"])]
    got = {r["query_id"]: r["concepts"] for r in policies.concepts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][:3] == ["Graph  Neural network", "Graph", "Neural"] and "subgraph" in got[1] and "C++" in got[1] and "topics\\E" in got[1]
    assert not {"3rd", "year", "beta", "missing", "without"} & set(got[1]) and got[2] == ["alpha", "beta"] and not got[3] and got[4] == []


def test_concepts_replace_the_last_derived_query(spark):
    q = [_row(i, "find alpha in beta", must=["alpha", "beta"]) for i in (1, 2, 3)]
    now = [(1, 1, "original", "find alpha in beta"), (1, 2, "keywords", "k"), (1, 3, "method", "m"), (1, 4, "venue", "v"), (2, 1, "original", "find alpha in beta"), (3, 1, "original", "o"), (3, 2, "keywords", "ALPHA  beta")]
    got = _plan(policies.projected(spark.createDataFrame(q, SCHEMA), spark.createDataFrame(now, NOW), 3))
    want = [*now[:2], (1, 3, "concept_projection", "alpha beta"), *now[4:]]
    assert got == want
