"""Queries of identity, sources, graphs, statistics, audits and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, graph, identity, metrics, stats
from lectern.shared import materialize, scratch
from lectern.sources import corpora
from lectern.streaming import events as E

from . import binding as B
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


# identity: a document's identifiers are made from its text, so that exact copies share one


def records(spark, sf_dir):
    p = B.papers(spark, sf_dir).withColumnRenamed("doc", "paper_id").drop("n_sources", "n_ids")
    n, text = F.col("paper_id"), F.col("abstract")
    return p.withColumns({"doi": F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.upper(F.substring(F.md5(text), 1, 12)))),
                          "arxiv_id": F.when(n % 3 != 1, F.concat(F.lit("arXiv:"), F.substring(F.md5(F.concat(F.lit("a"), text)), 1, 10), F.lit("v"), (n % 4).cast("string"))),
                          "authors": F.array(F.concat(F.lit("Author "), F.substring(F.md5(text), 1, 6)), "source")})


RECORDS = """records AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || substr(md5(text), 1, 12) END AS doi, CASE WHEN doc_id % 3 <> 1 THEN substr(md5('a' || text), 1, 10) END AS arxiv,
  TITLE AS title, 1990 + n_chars % 36 AS year, 'author ' || substr(md5(text), 1, 6) AS a1, source AS a2, text, source, lang, n_chars FROM documents),
pairs AS (SELECT a.id AS l, b.id AS r FROM records a JOIN records b ON a.id < b.id AND (a.doi = b.doi OR a.arxiv = b.arxiv OR (a.title <> '' AND a.title = b.title AND a.year = b.year AND (a.a1 = b.a1 OR a.a2 = b.a2)))
  WHERE NOT coalesce(a.doi <> b.doi, false) AND NOT coalesce(a.arxiv <> b.arxiv, false)),
reach AS (SELECT id AS a, id AS b FROM records UNION SELECT reach.a, CASE WHEN p.l = reach.b THEN p.r ELSE p.l END FROM reach JOIN pairs p ON p.l = reach.b OR p.r = reach.b),
clusters AS (SELECT a AS paper_id, min(b) AS cluster FROM reach GROUP BY a)""".replace("TITLE", r"trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', ' ', 'g'))")


def clustered(spark, sf_dir):
    r = materialize(records(spark, sf_dir), "records")
    return r, materialize(identity.clusters(r), "clusters")


@query(f"WITH RECURSIVE {RECORDS} SELECT paper_id, cluster FROM clusters")
def entity_clusters(spark, sf_dir):
    return clustered(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {RECORDS}, d AS (SELECT c.cluster, r.*, split_part(text, chr(10), 1) AS raw FROM clusters c JOIN records r ON r.id = c.paper_id)
SELECT cluster, count(*) AS members, arg_max(raw, (CASE WHEN title LIKE 'untitled%' THEN 0 ELSE 1 END) * 1000000000000 + length(trim(raw)) * 100000000 - id) AS title, min_by(year, id) AS year, max(n_chars % 997) AS citation_count, list_sort(list(DISTINCT source)) AS sources FROM d GROUP BY cluster""")
def merged_records(spark, sf_dir):
    r, c = clustered(spark, sf_dir)
    return identity.merged(r, c).select("cluster", "members", "title", "year", "citation_count", "sources")


def disputed(spark, sf_dir):
    """The records with a DOI for every third document of its own, so that copies without one link copies that conflict."""
    r = records(spark, sf_dir)
    return materialize(r.withColumn("doi", F.when(F.col("doi").isNotNull(), F.concat(F.lit("10.1/x"), F.col("paper_id").cast("string")))).drop("arxiv_id"), "disputed")


DISPUTED = RECORDS.replace("'10.1/' || substr(md5(text), 1, 12)", "'10.1/x' || doc_id").replace("CASE WHEN doc_id % 3 <> 1 THEN substr(md5('a' || text), 1, 10) END AS arxiv", "NULL::VARCHAR AS arxiv")


@query(f"WITH RECURSIVE {DISPUTED} SELECT cluster, 'doi' AS field, count(DISTINCT doi) AS \"values\" FROM clusters JOIN records ON id = paper_id GROUP BY cluster HAVING count(DISTINCT doi) > 1")
def identity_conflicts(spark, sf_dir):
    """What clusters would hold without their guard."""
    r = disputed(spark, sf_dir)
    return identity.conflicts(r, identity.clusters(r, guard=False))


@query()
def guarded_clusters(spark, sf_dir):
    """(paper_id, cluster) of the disputed records, under the guard; tests hold it against its definition."""
    return identity.clusters(disputed(spark, sf_dir))


@query(f"""WITH RECURSIVE {RECORDS}, d AS (SELECT c.cluster, r.*, split_part(text, chr(10), 1) AS raw FROM clusters c JOIN records r ON r.id = c.paper_id),
m AS (SELECT cluster, arg_max(raw, (CASE WHEN title LIKE 'untitled%' THEN 0 ELSE 1 END) * 1000000000000 + length(trim(raw)) * 100000000 - id) AS m_title, arg_max(text, length(trim(text)) * 100000000 - id) AS m_abstract,
  min_by(year, id) FILTER (year IS NOT NULL) AS m_year, min_by(lang, id) FILTER (lang <> '') AS m_venue FROM d GROUP BY cluster)
SELECT cluster, field, min(id) AS paper_id FROM (SELECT d.cluster, id, unnest([CASE WHEN raw = m_title THEN 'title' END, CASE WHEN text = m_abstract THEN 'abstract' END, CASE WHEN year = m_year THEN 'year' END, CASE WHEN lang = m_venue THEN 'venue' END]) AS field FROM d JOIN m USING (cluster)) WHERE field IS NOT NULL GROUP BY cluster, field""")
def merge_lineage(spark, sf_dir):
    r, c = clustered(spark, sf_dir)
    return identity.lineage(r, c, materialize(identity.merged(r, c), "merged"))


IDENTITY = f"{RECORDS}, {B.BASE}, {B.bm25_sql('ranked')}, {B.GOLD}, own AS (SELECT query_id, cluster, min(doc) AS doc, max(grade) AS grade, count(DISTINCT doc) AS members FROM gold JOIN clusters ON doc = paper_id WHERE grade > 0 GROUP BY query_id, cluster)"


@query(f"WITH RECURSIVE {IDENTITY} SELECT * FROM own")
def gold_identities(spark, sf_dir):
    return metrics.gold_duplicates(B.gold(spark, sf_dir), clustered(spark, sf_dir)[1])


@query(f"""WITH RECURSIVE {IDENTITY}, r AS (SELECT query_id, doc, rank, cluster, row_number() OVER (PARTITION BY query_id, cluster ORDER BY rank) AS nth FROM ranked JOIN clusters ON doc = paper_id)
SELECT r.query_id, r.doc, r.rank, CASE WHEN nth = 1 THEN own.grade END AS grade FROM r LEFT JOIN own ON own.query_id = r.query_id AND own.cluster = r.cluster""")
def identity_matches(spark, sf_dir):
    return metrics.matched_by_identity(B.ranked(spark, sf_dir).select("query_id", "doc", "rank"), B.gold(spark, sf_dir), clustered(spark, sf_dir)[1])


# sources


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, list_distinct([source, lang]) [1] AS first_author, CASE WHEN n_chars % 2 = 0 THEN 1990 + n_chars % 36 END AS year
FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''""")
def converted_corpus(spark, sf_dir):
    """documents written as JSON records of varying field names and read through the alias rules."""
    d = B.table(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    a = F.struct(F.col("doc_id").cast("string").alias("_id"), title.alias("title"), F.concat_ws(",", "source", "lang").alias("authors"), F.concat((1990 + F.col("n_chars") % 36).cast("string"), F.lit("-01-02")).alias("update_date"))
    b = F.struct(F.col("doc_id").alias("paper_id"), title.alias("Title"), F.array("source", "lang").alias("author"))
    raw = d.select(F.when(F.col("n_chars") % 2 == 0, F.to_json(a)).otherwise(F.to_json(b)).alias("value"))
    got, _ = corpora.convert(raw)
    return got.select("id", "title", F.get("authors", F.lit(0)).alias("first_author"), F.col("year").cast("long").alias("year"))


ORACLE["converted_corpus"] = """SELECT CAST(doc_id AS VARCHAR) AS id, trim(split_part(text, chr(10), 1)) AS title, source AS first_author, CASE WHEN n_chars % 2 = 0 THEN 1990 + n_chars % 36 END AS year
FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''"""


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1".replace("SELECT * FROM", "SELECT o_custkey, o_orderkey, o_totalprice FROM"))
def latest_revision(spark, sf_dir):
    return corpora.latest(B.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT * FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)) GROUP BY o_custkey HAVING count(*) > 1")
def revision_conflicts(spark, sf_dir):
    return corpora.revision_conflicts(B.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("SELECT count(*) AS n, count(*) FILTER (doc_id IS NULL) AS without_id, count(doc_id) - count(DISTINCT doc_id) AS repeated, round(avg(CASE WHEN text <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS has_text, round(avg(CASE WHEN lang <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS has_lang FROM documents")
def corpus_completeness(spark, sf_dir):
    return audit.completeness(B.table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])


@query("SELECT p_partkey, p_brand, count(l_orderkey) AS lines, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def metadata_join(spark, sf_dir):
    """Title index joined with metadata, by exact id."""
    p, li = B.table(spark, sf_dir, "part"), B.table(spark, sf_dir, "lineitem")
    return p.join(li, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_partkey", "p_brand").agg(F.count("l_orderkey").alias("lines"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 2).alias("quantity"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'corrupt' ELSE 'hit' END AS status FROM documents")
def snapshot_replay(spark, sf_dir):
    """Recorded responses: every fifth is not recorded, every seventh was altered."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", corpora.snapshot_key(F.lit("local"), F.col("doc_id")).alias("key"), "text")
    path = scratch(spark, "snapshots")
    corpora.write_snapshots(d.where("doc_id % 5 <> 0").select("key", F.col("text").alias("content")), path)
    stored = spark.read.schema("key string, content string, digest string").parquet(path)
    altered = stored.join(d.select("key", "doc_id"), "key").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("doc_id")
    return corpora.replay(d.select("doc_id", "key"), altered).select("doc_id", "status")


@query(f"SELECT doc_id, array_to_string({B.TOK.format('text')}, ' ') AS abstract FROM documents")
def inverted_abstract(spark, sf_dir):
    """Abstracts from maps of words to positions: the maps of the documents' own words, each made in its document's row."""
    t = B.table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.coalesce(corpora.inverted_abstract(corpora.inverted(F.col("t"))), F.lit("")).alias("abstract"))


# citation graph: customers cite the parts that they ordered


def _edges(spark, sf_dir):
    o, li = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), F.col("l_partkey").alias("ref")).distinct()


def _seeds(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("doc"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank")).where("rank <= 3")


CITED = """edges AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS ref FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
seeds AS (SELECT * FROM (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3),
per AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY ref) AS nth FROM seeds JOIN edges USING (doc)),
refs AS (SELECT query_id, doc, ref FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc, ref) AS place FROM per WHERE nth <= 15) WHERE place <= 50)"""


@query(f"WITH {CITED} SELECT query_id, doc, ref FROM refs")
def reference_expansion(spark, sf_dir):
    return graph.references(_seeds(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {CITED} SELECT query_id, doc, max(kind) AS kind FROM (SELECT query_id, doc, 'ranked' AS kind FROM seeds UNION SELECT query_id, ref, 'reference' FROM refs WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = refs.query_id AND s.doc = refs.ref)) GROUP BY query_id, doc")
def citation_nodes(spark, sf_dir):
    s = _seeds(spark, sf_dir)
    return graph.citation_nodes(s, graph.references(s, _edges(spark, sf_dir)))


# statistics: of BM25 against Okapi, and of tables


PAIRED = f"{R.BOTH}, {B.GOLD}, rr AS (SELECT query_id, coalesce(max(CASE WHEN l.list = 'bm25' THEN 1 / rank::DOUBLE END), 0) AS a, coalesce(max(CASE WHEN l.list = 'okapi' THEN 1 / rank::DOUBLE END), 0) AS b FROM lists l JOIN gold USING (query_id, doc) GROUP BY query_id), paired AS (SELECT q.query_id, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b, 1 AS fam, round(coalesce(b, 0), 6) - round(coalesce(a, 0), 6) AS d FROM queries q LEFT JOIN rr USING (query_id))"


def paired_rows(spark, sf_dir):
    a, b, _ = R._lists(spark, sf_dir)
    q, g = B.queries(spark, sf_dir), B.gold(spark, sf_dir)
    x = metrics.per_query(q, a, g).select("query_id", F.col("mrr").alias("a"))
    y = metrics.per_query(q, b, g).select("query_id", F.col("mrr").alias("b"))
    return materialize(x.join(y, "query_id").withColumn("fam", F.lit(1)).withColumn("d", F.col("b") - F.col("a")), "paired")


@query(f"""WITH {PAIRED} SELECT fam, count(*) AS n, round(avg(a) + 1e-9, 6) AS baseline, round(avg(b) + 1e-9, 6) AS experiment, round(avg(d) + 1e-9, 6) AS difference, round(quantile_cont(d, 0.5) + 1e-9, 6) AS median_difference,
  round(stddev_samp(d), 6) AS sd, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS dz, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS tied, count(*) FILTER (d < 0) AS regressed FROM paired GROUP BY fam""")
def paired_statistics(spark, sf_dir):
    return stats.paired(paired_rows(spark, sf_dir), "a", "b", ["fam"])


@query("""WITH c AS (SELECT c_mktsegment AS seg, c_nationkey AS component, avg(c_acctbal) AS a, avg(abs(c_acctbal)) AS b FROM customer GROUP BY ALL), d AS (SELECT *, b - a AS d FROM c)
SELECT seg, count(*) AS n, round(avg(a) + 1e-9, 6) AS baseline, round(avg(b) + 1e-9, 6) AS experiment, round(avg(d) + 1e-9, 6) AS difference, round(quantile_cont(d, 0.5) + 1e-9, 6) AS median_difference, round(stddev_samp(d), 6) AS sd,
  round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS dz, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS tied, count(*) FILTER (d < 0) AS regressed FROM d GROUP BY seg""")
def component_statistics(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("component"), F.col("c_acctbal").alias("a"), F.abs("c_acctbal").alias("b"))
    return stats.clustered(c, "a", "b", "component", ["seg"])


@query("""SELECT c_mktsegment AS seg, count(*) AS n, stddev_samp(c_acctbal) > 0 AS available, greatest(2, CAST(ceil(pow((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * stddev_samp(c_acctbal) / 100, 2)) AS BIGINT)) AS required FROM customer GROUP BY c_mktsegment""")
def power_planning(spark, sf_dir):
    """Without the power itself, for which SQL has no normal distribution; a test holds it."""
    c = B.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"), F.stddev("c_acctbal").alias("sd"))
    return c.select("seg", "n", stats.power(F.col("sd"), 100.0).alias("p")).select("seg", "n", "p.available", "p.required")


def _events(spark, sf_dir):
    return B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


BALANCES = "b AS (SELECT c_custkey AS key, c_acctbal AS v, c_mktsegment AS seg, CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END AS g FROM customer)"


def balances(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_nationkey") < 12, 0).otherwise(1).alias("g"))


@query(f"WITH {BALANCES} SELECT seg, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, min(v) AS least, max(v) AS most, round(sum(v), 4) AS total FROM b GROUP BY seg")
def distribution_summary(spark, sf_dir):
    return stats.distribution(balances(spark, sf_dir), "v", ["seg"])


NUM = "c AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n FROM b)"


def drawn(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT)"


@query(f"""WITH {BALANCES}, {NUM}, d AS (SELECT seg, round, {drawn("'boot'", 'round', 'i')} % n AS pick FROM c, (SELECT unnest(range(0, 200)) AS round)),
m AS (SELECT d.seg, d.round, avg(c.v) AS mean FROM d JOIN c ON c.seg = d.seg AND c.i = d.pick GROUP BY ALL) SELECT seg, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS rounds FROM m GROUP BY seg""")
def bootstrap_interval(spark, sf_dir):
    """The 200 rounds of its SQL; resampled_interval has the whole number."""
    return stats.bootstrap(balances(spark, sf_dir), "v", ["seg"], "key", 200)


@query()
def resampled_interval(spark, sf_dir):
    return stats.interval(balances(spark, sf_dir), "v", ["seg"], "key")


@query(f"""WITH {BALANCES}, {NUM}, d AS (SELECT seg, round, abs(sum(CASE WHEN {drawn("'flip'", 'round', 'i')} % 2 = 0 THEN v ELSE -v END)) AS s FROM c, (SELECT unnest(range(0, 200)) AS round) GROUP BY seg, round),
o AS (SELECT seg, abs(sum(v)) AS own FROM c GROUP BY seg) SELECT seg, round((count(*) FILTER (s >= own - 1e-9) + 1) / 201.0::DOUBLE, 6) AS p FROM d JOIN o USING (seg) GROUP BY seg""")
def sign_flip_test(spark, sf_dir):
    """The 200 rounds of its SQL; random_sign_test has the whole number."""
    return stats.sign_flip(balances(spark, sf_dir), "v", ["seg"], "key", 200)


@query()
def random_sign_test(spark, sf_dir):
    return stats.permutation(balances(spark, sf_dir), "v", ["seg"], "key")


def suppliers(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("seg"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v"))


NATION = "e AS (SELECT s_nationkey AS seg, s_suppkey AS key, s_acctbal AS v FROM supplier), b AS (SELECT * FROM e)"


@query(f"""WITH {NATION}, {NUM}, k AS (SELECT * FROM c WHERE n <= 12), d AS (SELECT seg, pattern, abs(sum(CASE WHEN (pattern // CAST(pow(2, i) AS BIGINT)) % 2 = 1 THEN v ELSE -v END)) AS s FROM k JOIN (SELECT unnest(range(0, 4096)) AS pattern) ON pattern < pow(2, n) GROUP BY seg, pattern),
o AS (SELECT seg, abs(sum(v)) AS own FROM k GROUP BY seg) SELECT seg, round(count(*) FILTER (s >= own - 1e-9) / count(*)::DOUBLE, 6) AS p FROM d JOIN o USING (seg) GROUP BY seg""")
def exact_sign_flip_test(spark, sf_dir):
    """Every nation has a row. The SQL has none for nations of more than 12 suppliers, which start beyond sf0.01."""
    return stats.exact_sign_flip(suppliers(spark, sf_dir), "v", ["seg"], "key")


@query()
def paired_permutation_test(spark, sf_dir):
    """The same tests with their method; without SQL, as random signs have no plain form there."""
    return stats.permutation(suppliers(spark, sf_dir), "v", ["seg"], "key")


@query("""WITH p AS (SELECT n_nationkey AS key, (n_nationkey * n_nationkey + 1) / 5000.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS m FROM p),
a AS (SELECT key, p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM r) SELECT *, adjusted <= 0.05 AS rejected FROM a""")
def holm_correction(spark, sf_dir):
    p = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), ((F.col("n_nationkey") * F.col("n_nationkey") + 1) / 5000.0).alias("p"))
    return stats.holm(p, "p", "key")


@query(f"""WITH {BALANCES}, c AS (SELECT seg, v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS z FROM b GROUP BY ALL),
d AS (SELECT seg, abs(sum(a) OVER w / (sum(a) OVER t)::DOUBLE - sum(z) OVER w / (sum(z) OVER t)::DOUBLE) AS d FROM c WINDOW w AS (PARTITION BY seg ORDER BY v), t AS (PARTITION BY seg)) SELECT seg, round(max(d), 6) AS ks FROM d GROUP BY seg""")
def ks_distance(spark, sf_dir):
    return stats.ks_distance(balances(spark, sf_dir), "v", "g", ["seg"])


@query(f"WITH {BALANCES} SELECT seg, round((avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0)) / sqrt((var_samp(v) FILTER (g = 0) + var_samp(v) FILTER (g = 1)) / 2), 6) AS smd FROM b GROUP BY seg")
def standardized_difference(spark, sf_dir):
    return stats.standardized_difference(balances(spark, sf_dir), "v", "g", ["seg"])


@query(f"""WITH {BALANCES}, c AS (SELECT seg, count(*) FILTER (g = 0)::DOUBLE AS a, count(*) FILTER (g = 1)::DOUBLE AS z FROM b GROUP BY seg), p AS (SELECT a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM c)
SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS js FROM p""")
def js_distance(spark, sf_dir):
    return stats.js_distance(balances(spark, sf_dir), "seg", "g")


@query(f"""WITH {BALANCES}, x AS (SELECT seg, g, rank() OVER (PARTITION BY seg ORDER BY v) + (count(*) OVER (PARTITION BY seg, v) - 1) / 2.0::DOUBLE AS r FROM b),
s AS (SELECT seg, sum(r) FILTER (g = 1) AS rs, count(*) FILTER (g = 1)::DOUBLE AS n1, count(*) FILTER (g = 0)::DOUBLE AS n0 FROM x GROUP BY seg) SELECT seg, round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s""")
def rank_sum_auc(spark, sf_dir):
    return stats.auc(balances(spark, sf_dir), "v", "g", ["seg"])


@query("""WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po FROM l),
e AS (SELECT sum(r.c * s.c) / (SELECT n * n FROM t) AS pe FROM (SELECT a AS k, count(*)::DOUBLE AS c FROM l GROUP BY a) r JOIN (SELECT b AS k, count(*)::DOUBLE AS c FROM l GROUP BY b) s USING (k))
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END, 6) AS kappa FROM t, e""")
def cohen_kappa(spark, sf_dir):
    return stats.kappa(B.table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


@query("WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round(sum(n) * sum(n) / sum(n * n), 6) AS ess, round(sum(n * n) / (sum(n) * sum(n)), 6) AS herfindahl FROM c")
def source_concentration(spark, sf_dir):
    return stats.concentration(B.table(spark, sf_dir, "documents"), "source")


@query(f"WITH {B.BASE}, {B.bm25_sql('ranked')}, {B.GOLD}, p AS (SELECT DISTINCT query_id, doc FROM ranked), g AS (SELECT DISTINCT query_id, doc FROM gold) SELECT (SELECT count(*) FROM p JOIN g USING (query_id, doc)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (query_id, doc)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (query_id, doc)) AS fn")
def micro_counts(spark, sf_dir):
    return stats.micro(B.ranked(spark, sf_dir), B.gold(spark, sf_dir), ["query_id", "doc"])


# audits


@query(f"WITH {B.QUERIES}, {B.GOLD} SELECT doc, passage, hits, total FROM held")
def passage_containment(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return audit.passage_containment(docs, B.queries(spark, sf_dir).withColumnRenamed("query_id", "passage"))


@query(f"""WITH {B.QUERIES}, {B.GOLD}, {B.PAPERS}, p AS (SELECT query_id, doc, {B.TOK.format('text')} AS q, {B.TOK.format('title')} AS t, length(title) AS n FROM gold JOIN papers USING (doc) JOIN queries USING (query_id))
SELECT query_id, doc, CASE WHEN n >= 24 AND len(t) >= 3 AND contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(t, ' ') || ' ') THEN 'full_title' WHEN len(list_distinct(t)) >= 5 AND len(list_intersect(list_distinct(t), q)) / len(list_distinct(t))::DOUBLE >= 0.8 THEN 'title_coverage' ELSE 'none' END AS level FROM p""")
def title_leakage(spark, sf_dir):
    g = B.gold(spark, sf_dir).join(B.papers(spark, sf_dir).select("doc", "title"), "doc")
    return audit.leakage(B.queries(spark, sf_dir), g)


def _turns(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


SETS = f"""sets AS (SELECT min(query_id) AS query_id, s FROM (SELECT query_id, list_sort(list_distinct({B.TOK.format('text')})) AS s FROM turns) WHERE len(s) >= 6 GROUP BY s),
sim AS (SELECT a.query_id AS l, b.query_id AS r, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 6) AS jaccard FROM sets a JOIN sets b ON a.query_id < b.query_id AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s) WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE >= 0.8)"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations)"


@query(f'WITH {TURNS}, {SETS} SELECT l AS "left", r AS "right", jaccard FROM sim')
def similar_queries(spark, sf_dir):
    return audit.similar_queries(_turns(spark, sf_dir))


@query(f"""WITH RECURSIVE q AS (SELECT conv_id * 1000 + turn AS id, {B.TOK.format('text')} AS w FROM conversations), s AS (SELECT id, array_to_string(w, ' ') AS key, list_sort(list_distinct(w)) AS s FROM q),
reps AS (SELECT s, min(id) AS id FROM s WHERE len(s) >= 6 GROUP BY s),
e AS (SELECT s.id AS l, m.id AS r FROM s JOIN (SELECT key, min(id) AS id FROM s GROUP BY key) m USING (key) UNION SELECT s.id, reps.id FROM s JOIN reps USING (s)
  UNION SELECT a.id, b.id FROM reps a JOIN reps b ON a.id < b.id AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE >= 0.8),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT reach.a, CASE WHEN e.l = reach.b THEN e.r ELSE e.l END FROM reach JOIN e ON e.l = reach.b OR e.r = reach.b)
SELECT a AS query_id, min(b) AS component FROM reach GROUP BY a""")
def query_independence(spark, sf_dir):
    return audit.independence(_turns(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, event_type, lower(props) AS m FROM events) SELECT CASE WHEN regexp_matches(m, 'parse|json|xml|decode') THEN 'parse_failure' WHEN regexp_matches(m, 'http|status|429|5\\d\\d') THEN 'http_failure' WHEN regexp_matches(m, 'timeout|connection|network|dns') THEN 'transport_failure' WHEN regexp_matches(m, 'provider|source') THEN 'provider_failure' ELSE 'unknown_failure' END AS kind, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY 1""")
def failure_classes(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'error'").groupBy(audit.failure_class(F.col("props")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.BASE}, {B.bm25_sql('ranked', 200)}, c AS (SELECT count(*) FILTER (rank <= 200) AS a, count(*) FILTER (rank <= 50) AS b, count(*) FILTER (rank <= 20) AS c FROM ranked) SELECT 0 AS place, 'retrieved' AS stage, a AS n, 0 AS lost FROM c UNION ALL SELECT 1, 'pooled', b, a - b FROM c UNION ALL SELECT 2, 'ranked', c, b - c FROM c")
def candidate_funnel(spark, sf_dir):
    r = B.ranked(spark, sf_dir, 200)
    return audit.funnel([("retrieved", r), ("pooled", r.where("rank <= 50")), ("ranked", r.where("rank <= 20"))], ["query_id", "doc"])


# events


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return E.tumbling(_events(spark, sf_dir), "1 hour", "event_type")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    return E.sessions(_events(spark, sf_dir), "30 minutes", "user_id")


LAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, coalesce(ts < last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) {LAST} + INTERVAL '3600 seconds', false) AS blocked FROM events")
def source_cooldown(spark, sf_dir):
    return E.cooldown(_events(spark, sf_dir), "user_id", "error", 3600).select("event_id", "blocked")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, CASE WHEN event_type = 'error' THEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS streak FROM r)
SELECT event_id, CAST(streak AS BIGINT) AS streak, coalesce(lag(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 2, false) AS open FROM s""")
def circuit_breaker(spark, sf_dir):
    return E.breaker(_events(spark, sf_dir), "user_id", "error", 2).select("event_id", "streak", "open")


@query("WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS n, round(max(gap), 3) AS largest, round(avg(gap), 3) AS mean FROM g GROUP BY user_id")
def service_gaps(spark, sf_dir):
    return E.gaps(_events(spark, sf_dir), "user_id")


@query("WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT event_id, recent, recent > 3 AS denied FROM c")
def provider_pacing(spark, sf_dir):
    return E.pacing(_events(spark, sf_dir), "event_type", 600, 3).select("event_id", "recent", "denied")


@query("WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent, spent <= 500 AS admitted FROM s")
def conversation_budget(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").withColumn("cost", F.length("text"))
    return E.budget(c, "conv_id", ["turn"], "cost", 500).select("conv_id", "turn", "spent", "admitted")


@query("WITH f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS first FROM events) SELECT event_id, CAST(sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distinct_so_far FROM f")
def distinct_so_far(spark, sf_dir):
    return E.first_seen(_events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "distinct_so_far")


@query("WITH l AS (SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS t, max(ts) AS since, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, CASE t WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'queued' ELSE 'running' END AS state, since, n FROM l")
def run_states(spark, sf_dir):
    return E.states(_events(spark, sf_dir), "user_id")


def _stream(spark, sf_dir):
    """The events as files of a folder, in order of time, so that a stream takes them in several batches."""
    path = scratch(spark, "events")
    ev = _events(spark, sf_dir)
    ev.repartitionByRange(4, "ts").write.parquet(path)
    return E.read_stream(spark, path, ev.schema, 2)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return E.run_stream(E.tumbling(_stream(spark, sf_dir), "1 hour", "event_type"), scratch(spark, "out"), scratch(spark, "progress"), "complete")


@query("SELECT event_id, user_id FROM events")
def stream_distinct(spark, sf_dir):
    """Every event twice in the stream, once in the result."""
    s = _stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return E.run_stream(E.deduplicated(twice, ["event_id"], "400 days").select("event_id", "user_id"), scratch(spark, "out"), scratch(spark, "progress"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) AS total FROM events GROUP BY user_id")
def stream_failures(spark, sf_dir):
    s = E.failure_counts(_stream(spark, sf_dir).select("user_id", "event_type"), "user_id", "error")
    path = scratch(spark, "out")
    q = s.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", scratch(spark, "progress")).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(path)).start()
    q.awaitTermination()
    got = spark.read.schema("user_id long, failures long, total long, batch long").parquet(path)
    return got.groupBy("user_id").agg(F.max_by("failures", "batch").alias("failures"), F.max_by("total", "batch").alias("total"))
