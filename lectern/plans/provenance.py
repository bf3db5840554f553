"""Queries of provenance and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import fusion, identity, judgement, provenance
from lectern.shared import materialize
from lectern.sources import ledger

from . import analysis as A
from . import binding as B
from . import records as E
from . import retrieval as R

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


RECORDS = E.RECORDS.split(",\npairs AS")[0]
NAMED = f"named AS (SELECT *, list_filter([CASE WHEN arxiv IS NOT NULL THEN 'arxiv:' || arxiv END, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi END], lambda x: x IS NOT NULL) AS keys, list_sort(list_filter([a1, {A.title_sql('a2')}], lambda x: x <> '')) AS authors FROM records)"


def _profiles(spark, sf_dir):
    r = E.records(spark, sf_dir)
    return r, materialize(identity.profiles(r), "profiles")


# gold: the documents of one source that hold a query's passage stand for one relation

NAMES = "list_filter([CASE WHEN {} THEN 'arxiv_id' END, CASE WHEN {} THEN 'doi' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {RECORDS}, {NAMED}, {B.GOLD}, rel AS (SELECT query_id, source, min(arxiv) AS a, max(arxiv) AS b, min(doi) AS c, max(doi) AS d, max(len(keys)) AS keyed, bool_or(title <> '' AND len(authors) > 0 AND year IS NOT NULL) AS whole, bool_or(title <> '' OR len(authors) > 0 OR year IS NOT NULL) AS any_part
  FROM gold JOIN named ON doc = id GROUP BY query_id, source)
SELECT query_id, source, CASE WHEN len(con) > 0 THEN 'identifier_conflict' WHEN keyed > 0 THEN 'stable_identifier_evaluable' WHEN whole THEN 'conservative_title_evidence_evaluable' WHEN any_part THEN 'identity_ambiguous' ELSE 'insufficient_information' END AS status, array_to_string(idf, ',') AS identified, array_to_string(con, ',') AS conflicts
FROM (SELECT *, {NAMES.format('a IS NOT NULL', 'c IS NOT NULL')} AS idf, {NAMES.format('a <> b', 'c <> d')} AS con FROM rel)""")
def gold_relations(spark, sf_dir):
    """What the identity of a query's gold rests on, by source."""
    r, p = _profiles(spark, sf_dir)
    m = B.gold(spark, sf_dir).select("query_id", F.col("doc").alias("paper_id")).join(p, "paper_id").join(r.select("paper_id", "source"), "paper_id")
    return provenance.gold_relations(m, ["query_id", "source"]).withColumns({c: F.array_join(c, ",") for c in ("identified", "conflicts")})


# ties

TIES = f"""tied AS (SELECT id AS doc, CASE WHEN len(keys) > 0 THEN '0:' || sha256(to_json({{'identifiers': keys, 'kind': 'stable_identifiers'}})::VARCHAR) WHEN title <> '' AND len(authors) > 0 THEN '1:' || sha256(to_json({{'authors': authors, 'kind': 'exact_title_author_year', 'title': title, 'year': year}})::VARCHAR)
  ELSE '2:' || sha256(to_json({{'field_summary_sha256': sha256(to_json({{'abstract': '', 'authors': authors, 'citation_count': n_chars % 997, 'landing_page': '', 'pdf': '', 'title': title, 'venue': {A.title_sql("coalesce(lang, '')")}, 'year': year}})::VARCHAR), 'kind': 'source_record_and_normalized_fields', 'source_record_refs': ['record:' || id], 'sources': list_filter([lower(trim(source))], lambda x: x <> '')}})::VARCHAR) END AS tie_key FROM named)"""


def _ties(spark, sf_dir):
    r, p = _profiles(spark, sf_dir)
    details = r.select("paper_id", F.array("source").alias("sources"), F.array(F.concat(F.lit("record:"), F.col("paper_id").cast("string"))).alias("refs"), "venue", "citation_count")
    return provenance.tie_keys(p, details)


@query(f"WITH {RECORDS}, {NAMED}, {TIES} SELECT doc AS paper_id, tie_key FROM tied")
def tie_keys(spark, sf_dir):
    return _ties(spark, sf_dir)


@query(f"""WITH {RECORDS}, {NAMED}, {TIES}, {A.JUDGE}, {A.FINAL}
SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_position({A.TIERS}, category), final DESC, score DESC, citation_count DESC, year DESC, lower(title), tie_key, sha256(doc::VARCHAR)) AS INTEGER) AS rank,
  CASE WHEN tie_key IS NULL THEN 'unavailable' WHEN count(*) OVER (PARTITION BY query_id, category, final, score, citation_count, year, lower(title), tie_key) > 1 THEN 'collision' END AS tie FROM final JOIN tied USING (doc)""")
def stable_order(spark, sf_dir):
    """The rules' ranking with ties decided by what papers are, and those that cannot be told apart."""
    scored = judgement.breakdown(A.judged(spark, sf_dir), A.CONFIG).select("query_id", "doc", "category", "final", "score", "citation_count", "year", "title")
    return provenance.stable_order(scored, materialize(_ties(spark, sf_dir), "ties")).select("query_id", "doc", "rank", "tie")


# verified evidence: labels say of a document's DOI whether it is toxic, of its arXiv id whether it is of low quality

LEDGER = """told AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
entries AS (SELECT 2 * id AS line, 'doi:' || doi AS paper_identifier, 'retraction_status' AS signal_name, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'clear' END AS state, source FROM records JOIN told ON id = doc_id WHERE doi IS NOT NULL
  UNION ALL SELECT 2 * id + 1, 'arxiv:' || arxiv, 'retraction_status', CASE WHEN quality = 0 THEN 'flagged' ELSE 'clear' END, source FROM records JOIN told ON id = doc_id WHERE arxiv IS NOT NULL),
checked AS (SELECT *, CASE WHEN coalesce(source, '') = '' THEN 'schema_invalid' WHEN row_number() OVER (PARTITION BY paper_identifier, signal_name, coalesce(source, '') = '' ORDER BY line) > 1 THEN 'duplicate_signal' END AS problem FROM entries)"""


def _ledger(spark, sf_dir):
    r, p = _profiles(spark, sf_dir)
    told = B.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    own = p.join(told, "paper_id").join(r.select("paper_id", "source"), "paper_id")
    entry = lambda prefix, value, bad: F.to_json(F.struct(F.concat(F.lit(prefix), value).alias("paper_identifier"), F.lit("retraction_status").alias("signal_name"), F.when(bad, "flagged").otherwise("clear").alias("state"), F.col("source"), F.col("paper_id").cast("string").alias("source_record_id")))
    lines = own.where("n_doi IS NOT NULL").select((2 * F.col("paper_id")).alias("line"), entry("doi:", F.col("n_doi"), F.col("toxic") == 1).alias("value")).unionByName(
        own.where("n_arxiv_id IS NOT NULL").select((2 * F.col("paper_id") + 1).alias("line"), entry("arxiv:", F.col("n_arxiv_id"), F.col("quality") == 0).alias("value")))
    return p, materialize(ledger.read(lines), "ledger")


@query(f"WITH {RECORDS}, {LEDGER} SELECT coalesce(problem, 'none') AS problem, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM checked GROUP BY ALL")
def ledger_problems(spark, sf_dir):
    return _ledger(spark, sf_dir)[1].groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"))


@query(f"""WITH {RECORDS}, {LEDGER}, hit AS (SELECT id, signal_name, state FROM records JOIN checked ON paper_identifier = 'doi:' || doi OR paper_identifier = 'arxiv:' || arxiv WHERE problem IS NULL)
SELECT id AS paper_id, signal_name, CASE WHEN min(state) = max(state) THEN min(state) ELSE 'conflict' END AS state, count(*) AS records FROM hit GROUP BY id, signal_name""")
def verified_quality(spark, sf_dir):
    """What the ledger says of every paper by any of its identifiers."""
    p, found = _ledger(spark, sf_dir)
    return provenance.verified(p, found.where("problem IS NULL"))


# lists and seeds

SAME = "NOT coalesce(a.doi <> b.doi, false) AND NOT coalesce(a.arxiv <> b.arxiv, false) AND (a.doi = b.doi OR a.arxiv = b.arxiv OR (a.title <> '' AND a.title = b.title AND a.year = b.year AND list_has_any(a.authors, b.authors)))"


@query(f"""WITH {R.BOTH}, {R.FUSED}, {RECORDS}, {NAMED}, cand AS (SELECT query_id, doc FROM fused WHERE rank <= 10),
pairs AS (SELECT DISTINCT c.query_id, c.doc, l.doc AS entry FROM cand c JOIN lists l ON l.query_id = c.query_id JOIN named a ON a.id = c.doc JOIN named b ON b.id = l.doc WHERE {SAME}),
many AS (SELECT *, count(*) OVER (PARTITION BY query_id, entry) AS n FROM pairs),
best AS (SELECT m.query_id, m.doc, l.list, min(l.rank) AS rank, bool_or(n > 1) AS shared FROM many m JOIN lists l ON l.query_id = m.query_id AND l.doc = m.entry GROUP BY ALL)
SELECT query_id, doc, count(list) AS lists, coalesce(round(sum(1 / (60.0::DOUBLE + rank)), 9), 0) AS rrf_score, CASE WHEN count(list) = 0 THEN 'missing' WHEN bool_or(shared) THEN 'ambiguous' ELSE 'traced' END AS status FROM cand LEFT JOIN best USING (query_id, doc) GROUP BY query_id, doc""")
def rank_provenance(spark, sf_dir):
    """Which lists gave a fused candidate, by identity."""
    lists = R._lists(spark, sf_dir)[2]
    candidates = materialize(fusion.rrf(lists, top=10).select("query_id", "doc"), "candidates")
    entries = lists.select("query_id", F.col("list").alias("source"), F.lit("original").alias("subquery"), "rank", "doc")
    return provenance.rank_provenance(candidates, entries, _profiles(spark, sf_dir)[1])[0]


def _resolved(spark, sf_dir):
    r = E.records(spark, sf_dir)
    s2 = F.concat(F.lit("s2:"), F.substring(F.md5("abstract"), 9, 10))
    own = materialize(identity.profiles(r.withColumn("semantic_scholar_id", F.when(F.col("year") % 4 == 0, s2))), "profiles")
    found = materialize(identity.profiles(r.where("year % 2 = 0 OR year % 3 = 0").withColumn("semantic_scholar_id", F.when(F.col("year") % 2 == 0, s2))), "found")
    ranked = B.ranked(spark, sf_dir).select("query_id", "rank", "doc")
    return ranked, own, provenance.resolutions(ranked, own, found)


RESOLVED = f"""service AS (SELECT id, doi, arxiv, CASE WHEN year % 2 = 0 THEN substr(md5(text), 9, 10) END AS s2 FROM records WHERE year % 2 = 0 OR year % 3 = 0),
request AS (SELECT * FROM (SELECT query_id, rank, doc, coalesce('doi:' || doi, 'arxiv:' || arxiv) AS requested, row_number() OVER (PARTITION BY query_id, coalesce('doi:' || doi, 'arxiv:' || arxiv) ORDER BY rank) AS n FROM ranked JOIN records ON doc = id WHERE year % 4 <> 0) WHERE requested IS NOT NULL AND n = 1),
mapped AS (SELECT key, min(id) AS id FROM (SELECT 'doi:' || doi AS key, id FROM service UNION ALL SELECT 'arxiv:' || arxiv, id FROM service) WHERE key IS NOT NULL GROUP BY key),
resolved AS (SELECT query_id, rank, doc, requested, CASE WHEN m.id IS NULL THEN 'missing' WHEN s2 IS NULL THEN 'conflict' ELSE 'resolved' END AS status, CASE WHEN m.id IS NOT NULL THEN 'shared_stable_identifier' END AS rule, s2 AS semantic_scholar_id FROM request LEFT JOIN mapped m ON key = requested LEFT JOIN service s ON s.id = m.id)"""


@query(f"WITH {B.BASE}, {B.bm25_sql('ranked')}, {RECORDS}, {RESOLVED} SELECT * FROM resolved")
def seed_resolutions(spark, sf_dir):
    """Ranked papers without an S2 id, looked up by another identifier."""
    return _resolved(spark, sf_dir)[2]


@query(f"""WITH {B.BASE}, {B.bm25_sql('ranked')}, {RECORDS}, {RESOLVED},
ids AS (SELECT r.query_id, r.rank, CASE WHEN year % 4 = 0 THEN substr(md5(text), 9, 10) ELSE semantic_scholar_id END AS s2, CASE WHEN year % 4 = 0 THEN 'direct' ELSE 'resolved' END AS source FROM ranked r JOIN records ON r.doc = id LEFT JOIN (SELECT * FROM resolved WHERE status = 'resolved') x ON x.query_id = r.query_id AND x.doc = r.doc),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, s2 ORDER BY rank) AS n FROM ids WHERE s2 IS NOT NULL)
SELECT query_id, CAST(place AS INTEGER) AS place, rank, s2 AS semantic_scholar_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM once WHERE n = 1) WHERE place <= 5""")
def resolved_seeds(spark, sf_dir):
    ranked, own, found = _resolved(spark, sf_dir)
    return provenance.expansion_seeds(ranked, own, materialize(found, "resolved"))
