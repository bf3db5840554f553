"""How the engine's concepts are read from the test tables, in DataFrames and in SQL.

documents are papers (title: the first line; venue: lang; year, citations and identifiers derived from n_chars and
doc_id), benchmark rows are queries, and a document is gold for a query of which it holds half of the 13-grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T
from lectern.operators import audit, retrieval
from lectern.shared import materialize, spread

AS_OF, K = 2025, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), "source", F.col("lang").alias("venue"),
                    (1990 + F.col("n_chars") % 36).cast("int").alias("year"), (F.col("n_chars") % 997).alias("citation_count"), F.lit(1).alias("n_sources"), (F.col("doc_id") % 6).alias("n_ids"))


PAPERS = """papers AS (SELECT doc_id AS doc, split_part(text, chr(10), 1) AS title, text AS abstract, source, lang AS venue, 1990 + n_chars % 36 AS year, n_chars % 997 AS citation_count, 1 AS n_sources, doc_id % 6 AS n_ids FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return materialize(retrieval.postings(docs, "doc", T.tokens(F.col("text"))), "postings"), docs.select("doc")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("query_id", T.query_tokens(F.col("text")).alias("terms"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.tokens(F.col("text")).alias("tokens"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(retrieval.hits(asked(spark, sf_dir), tokenised(spark, sf_dir)), "hits", rows=1024, mb=4)


def ranked(spark: SparkSession, sf_dir: str, k: int = K, hit: DataFrame | None = None, **kind) -> DataFrame:
    """The k best documents of every query; `hit`: hits that another ranking has made already."""
    hit = hits(spark, sf_dir) if hit is None else hit
    return retrieval.best(asked(spark, sf_dir), hit, tokenised(spark, sf_dir), k, **kind)


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
TERMS = f"""asked AS (SELECT query_id, CASE WHEN len(f) > 0 THEN f ELSE t END AS terms FROM (
  SELECT query_id, t, list_filter(t, lambda x: x NOT IN ({sql_list(C.QUERY_STOPWORDS)})) AS f FROM (SELECT query_id, {TOK.format('text')} AS t FROM queries))),
post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
length AS (SELECT doc, sum(tf) AS dl FROM post GROUP BY doc),
size AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM length)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
freq AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"""


def bm25_sql(name: str, k: int = K) -> str:
    return f"""{name}_s AS (SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
  FROM (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked) JOIN freq USING (term) JOIN post USING (term) JOIN length USING (doc), size GROUP BY query_id, doc),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {name}_s) WHERE rank <= {k})"""


def okapi_sql(name: str, k: int = K) -> str:
    return f"""raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM freq, size), floor AS (SELECT 0.25::DOUBLE * avg(idf) AS low FROM raw),
{name}_s AS (SELECT query_id, doc, round(sum(qtf * CASE WHEN idf < 0 THEN low ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
  FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM asked) GROUP BY ALL) JOIN raw USING (term) JOIN post USING (term) JOIN length USING (doc), size, floor GROUP BY query_id, doc),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {name}_s) WHERE rank <= {k})"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    held = audit.passage_containment(docs, queries(spark, sf_dir).withColumnRenamed("query_id", "passage"))
    quality = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").alias("quality"))
    g = held.where("2 * hits >= total").join(quality, "doc", "left")
    return materialize(g.select(F.col("passage").alias("query_id"), "doc", (1 + F.coalesce("quality", F.lit(0))).alias("grade")), "gold")


def grams_sql(name: str, source: str, key: str, text: str, n: int = 13) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, gram FROM (SELECT {key}, unnest(CASE WHEN len(t) >= {n} THEN list_transform(range(len(t) - {n - 1}), lambda i: array_to_string(t[i + 1:i + {n}], ' ')) ELSE [array_to_string(t, ' ')] END) AS gram
  FROM (SELECT {key}, {TOK.format(text)} AS t FROM {source}) WHERE len(t) > 0))"""


GOLD = f"""{grams_sql('dgrams', '(SELECT doc_id AS doc, text FROM documents)', 'doc', 'text')},
{grams_sql('pgrams', '(SELECT item_id AS passage, text FROM benchmark)', 'passage', 'text')},
held AS (SELECT doc, passage, count(*) AS hits, any_value(total) AS total FROM dgrams JOIN pgrams USING (gram) JOIN (SELECT passage, count(*) AS total FROM pgrams GROUP BY passage) USING (passage) GROUP BY doc, passage),
gold AS (SELECT passage AS query_id, doc, 1 + coalesce(quality, 0) AS grade FROM held LEFT JOIN (SELECT doc_id AS doc, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc) WHERE 2 * hits >= total)"""


def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates by the source of their document: (query_id, source, doc, position)."""
    r = ranked(spark, sf_dir, 50)
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    return r.join(s, "doc").select("query_id", "source", "doc", F.col("rank").alias("position"))


CANDIDATES = "candidates AS (SELECT query_id, source, doc, rank AS position FROM ranked JOIN (SELECT doc_id AS doc, source FROM documents) USING (doc))"
BASE = f"{QUERIES},\n{TERMS}"
