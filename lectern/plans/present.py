"""Queries of presentation and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.operators import judgement, present
from lectern.shared import materialize

from . import analysis as A
from . import binding as B

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def short_sql(x: str) -> str:
    return rf"rtrim(substr(trim(regexp_replace({x}, '\s+', ' ', 'g')), 1, 160))"


def _words(lists) -> str:
    return "[" + B.sql_list([w for words in lists for w in words]) + "]"


TYPED = {k: C.PAPER_TYPE_TERMS[k] for k in C.PAPER_TYPE_TERMS if k in ("method", "survey")}
DOMAIN_WORDS = "CASE domain " + " ".join(f"WHEN '{k}' THEN {_words([v])}" for k, v in C.DOMAIN_TERMS.items()) + " END"
EVIDENCE = rf"""asked_of AS (SELECT query_id, doc, generate_subscripts(labels, 1) AS i, unnest(labels) AS label, unnest(terms) AS term, t, a, t_p, a_p, title, abstract FROM (SELECT *,
  list_concat(own, must, methods, datasets, CASE WHEN typed THEN {_words([[k] * len(v) for k, v in TYPED.items()])} ELSE [] END, {DOMAIN_WORDS}) AS labels,
  list_concat(own, must, methods, datasets, CASE WHEN typed THEN {_words(TYPED.values())} ELSE [] END, {DOMAIN_WORDS}) AS terms FROM reranked)),
spots AS MATERIALIZED (SELECT query_id, doc, i, label, term, title, abstract, CASE WHEN {A.hit_sql('t', 'term')} THEN 2 WHEN {A.hit_sql('a', 'term')} THEN 1 ELSE 0 END AS p FROM asked_of),
said AS MATERIALIZED (SELECT query_id, doc, source, text, min(i) AS i FROM (
  SELECT query_id, doc, i, CASE p WHEN 2 THEN 'title' ELSE 'abstract' END AS source, {short_sql(r"CASE p WHEN 2 THEN title ELSE coalesce(list_filter(string_split(regexp_replace(trim(abstract), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), term))[1], abstract) END")} AS text FROM spots WHERE p > 0
  UNION ALL SELECT query_id, doc, 100000, 'venue', venue FROM reranked WHERE placed AND v UNION ALL SELECT query_id, doc, 100001, 'metadata', 'year=' || year FROM reranked WHERE start_year IS NOT NULL) GROUP BY ALL),
labelled AS (SELECT query_id, doc, list(label ORDER BY i) AS terms FROM (SELECT query_id, doc, label, min(i) AS i FROM spots WHERE p > 0 GROUP BY ALL) GROUP BY ALL),
pieces AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY i) AS row, dense_rank() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM said JOIN reranked USING (query_id, doc) WHERE trim(said.text) <> '' AND category NOT IN ({B.sql_list(C.NOT_CITED)})),
erows AS MATERIALIZED (SELECT query_id, rank, doc, title, venue, final, coalesce(labelled.terms, []) AS terms, row, 'R' || rank || '-E' || row AS row_id, 'R' || rank AS citation_key, source, CASE WHEN length(flat) > {C.EVIDENCE_LENGTH} THEN rtrim(substr(flat, 1, {C.EVIDENCE_LENGTH - 3})) || '...' ELSE flat END AS text
  FROM (SELECT query_id, rank, doc, title, venue, final, row, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM pieces WHERE nth <= {C.CITED_PAPERS} AND row <= {C.EVIDENCE_ROWS}) LEFT JOIN labelled USING (query_id, doc)),
finds AS MATERIALIZED (SELECT query_id, place, citation_key, row_id, final AS confidence, title || ' provides ' || source || ' evidence for ' || CASE WHEN len(terms) > 0 THEN array_to_string(terms[1:3], ', ') WHEN venue <> '' THEN 'evidence from ' || venue ELSE 'the search query' END || ' [' || citation_key || '].' AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM erows WHERE row = 1) WHERE place <= {C.FINDINGS})""".replace("said JOIN reranked USING (query_id, doc) WHERE trim(said.text)", "said JOIN (SELECT * EXCLUDE (text) FROM reranked) USING (query_id, doc) WHERE trim(said.text)")
SHOWN = f"{A.JUDGE}, {A.FINAL}, {EVIDENCE}"


def _ranked(spark, sf_dir):
    r = judgement.rerank(judgement.breakdown(A.judged(spark, sf_dir), A.CONFIG))
    return materialize(present.evidence(r), "presented")


def _rows(spark, sf_dir, ranked=None):
    return present.evidence_rows(_ranked(spark, sf_dir) if ranked is None else ranked)


@query(f"WITH {SHOWN} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(row AS INTEGER) AS row, row_id, citation_key, source, text, title || ' has ' || source || ' evidence ' || CASE WHEN len(terms) > 0 THEN 'related to ' || array_to_string(terms[1:3], ', ') ELSE 'relevant to the query' END || '.' AS claim FROM erows")
def evidence_rows(spark, sf_dir):
    """What an answer cites: up to three pieces of evidence of up to eight papers of a query."""
    return _rows(spark, sf_dir).select("query_id", "rank", "row", "row_id", "citation_key", "source", "text", "claim")


@query(f"WITH {SHOWN} SELECT query_id, CAST(place AS INTEGER) AS place, citation_key, row_id, confidence, text FROM finds")
def answer_findings(spark, sf_dir):
    return present.findings(_rows(spark, sf_dir))


@query(f"""WITH {SHOWN}, n AS (SELECT query_id, count(*) AS ranked FROM reranked GROUP BY query_id),
u AS (SELECT query_id, count(*) AS unsupported FROM said JOIN (SELECT query_id, doc, category FROM reranked) USING (query_id, doc) WHERE trim(text) = '' AND category NOT IN ({B.sql_list(C.NOT_CITED)}) GROUP BY query_id),
c AS (SELECT query_id, count(*) FILTER (row = 1) AS cited, count(*) AS evidence_rows, count(*) FILTER (EXISTS (SELECT 1 FROM finds f WHERE f.query_id = erows.query_id AND f.citation_key = erows.citation_key)) AS cited_rows FROM erows GROUP BY query_id)
SELECT query_id, coalesce(ranked, 0) AS ranked, coalesce(cited, 0) AS cited, coalesce(evidence_rows, 0) AS evidence_rows, coalesce(cited_rows, 0) AS cited_rows, coalesce(unsupported, 0) AS unsupported, CASE WHEN ranked > 0 THEN round(least(1::DOUBLE, coalesce(cited, 0) / ranked::DOUBLE), 4) ELSE 0 END AS ratio
FROM queries LEFT JOIN n USING (query_id) LEFT JOIN u USING (query_id) LEFT JOIN c USING (query_id)""")
def citation_coverage(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    rows = materialize(_rows(spark, sf_dir, r), "rows")
    return present.coverage(B.queries(spark, sf_dir), r, rows, present.findings(rows))


@query(f"""WITH {SHOWN}, c AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, trim(unnest(terms)) AS term FROM erows) WHERE term <> '' GROUP BY ALL)
SELECT query_id, CAST(place AS INTEGER) AS place, term, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, lower(term), term) AS place FROM c) WHERE place <= 4""")
def answer_themes(spark, sf_dir):
    return present.themes(_rows(spark, sf_dir))


GROUPS = ", ".join(f"CASE WHEN {A.any_sql('whole', words)} THEN {{'place': {i}, 'name': '{name}'}} END" for i, (name, words) in enumerate(C.METHOD_CLUSTERS))
KNOWN = B.sql_list([name.lower() for name, _ in C.METHOD_CLUSTERS])


@query(f"""WITH {SHOWN}, whole AS (SELECT query_id, rank, methods, lower(concat_ws(' ', title, abstract, shown)) AS whole FROM reranked LEFT JOIN (SELECT query_id, doc, string_agg(text, ' ' ORDER BY i) AS shown FROM said GROUP BY ALL) USING (query_id, doc)),
member AS (SELECT query_id, rank, g.place AS place, lower(g.name) AS name FROM (SELECT query_id, rank, unnest([{GROUPS}]) AS g FROM whole) WHERE g IS NOT NULL
  UNION ALL SELECT query_id, rank, 100 AS place, m FROM (SELECT query_id, rank, whole, lower(trim(unnest(methods))) AS m FROM whole) WHERE m <> '' AND m NOT IN ({KNOWN}) AND contains(whole, m)),
spelled AS (SELECT query_id, name, min(place) AS place, list_sort(list(DISTINCT rank)) AS ranks FROM member GROUP BY ALL
  UNION ALL SELECT query_id, 'general', 0, list_sort(list(DISTINCT rank)) FROM whole WHERE query_id NOT IN (SELECT query_id FROM member) GROUP BY query_id)
SELECT query_id, name, array_to_string(ranks, ',') AS ranks FROM spelled""")
def method_clusters(spark, sf_dir):
    """Which ranks of a query's papers speak of which methods."""
    return present.method_clusters(_ranked(spark, sf_dir)).select("query_id", F.lower("name").alias("name"), F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))
