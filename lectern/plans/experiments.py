"""Queries of calibration, covers, component statistics, stages, parity and saved indexes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import experiments as X
from lectern.operators import judgement, planning, retrieval, stats
from lectern.shared import materialize, scratch
from lectern.sources import index

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


# calibration

CONFIGS = "configs AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{c[k]}::INTEGER" if k in ("config", "evidence") else f"{c[k]}::DOUBLE" for k in ("config", *X.GRID, "distance")) + ")" for c in X.grid()) + ") t(config, " + ", ".join(X.GRID) + ", distance))"
EVALUATED = f"""{B.GOLD}, totals AS (SELECT query_id, count(*) AS gold_total FROM gold GROUP BY query_id), {CONFIGS},
cases AS (SELECT query_id, doc, len(list_filter(f_topic, lambda x: x = 2)) AS nt, len(list_filter(f_topic, lambda x: x = 1)) AS na, raw - s_topic AS rest, trim(a) <> '' AS has_abstract, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = judged.query_id AND g.doc = judged.doc) AS gold,
  coalesce((SELECT gold_total FROM totals t WHERE t.query_id = judged.query_id), 0) AS gold_total FROM judged),
marked AS MATERIALIZED (SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, rest + least(0.45::DOUBLE, nt * in_title + na * in_abstract) - CASE WHEN has_abstract THEN 0 ELSE no_abstract END)) + 1e-9::DOUBLE, 4) AS mark FROM cases, configs),
kept AS (SELECT *, mark >= partial AND nt + na >= evidence AS back FROM marked),
spots AS (SELECT *, CASE WHEN back THEN row_number() OVER (PARTITION BY query_id, config, back ORDER BY CASE WHEN mark >= high THEN 0 ELSE 1 END, mark DESC, doc) END AS spot FROM kept),
per AS (SELECT query_id, config, {', '.join(X.GRID)}, distance, count(*) FILTER (spot <= 20) AS n, count(*) FILTER (spot <= 20 AND gold) AS hit, count(*) FILTER (gold) AS found, count(*) FILTER (gold AND back) AS held, min(spot) FILTER (spot <= 20 AND gold) AS first, max(gold_total) AS every, count(*) FILTER (back) AS back FROM spots GROUP BY ALL),
rated AS (SELECT *, CASE WHEN n > 0 THEN hit / n::DOUBLE ELSE 0 END AS p, hit / every::DOUBLE AS r FROM per WHERE every > 0),
evaluated AS MATERIALIZED (SELECT config, {', '.join(X.GRID)}, distance, count(*) AS queries, round(avg(back) + 1e-9, 6) AS returned, round(avg(p) + 1e-9, 6) AS precision, round(avg(r) + 1e-9, 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) + 1e-9, 6) AS f1,
  round(avg(coalesce(1 / first::DOUBLE, 0)) + 1e-9, 6) AS mrr, round(CASE WHEN sum(found) > 0 THEN 1 - sum(held) / sum(found)::DOUBLE END + 1e-9, 6) AS lost FROM rated GROUP BY ALL)"""
JUDGED = f"{A.JUDGE}, {EVALUATED}"


def _cases(spark, sf_dir):
    j = A.judged(spark, sf_dir)
    terms = judgement.lowered(F.concat("own_terms", "must", "methods", "datasets"))
    t, a = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    d = j.withColumn("_terms", terms).withColumn("_title", T.contained(F.col("_terms"), t)).withColumn("_abstract", T.contained(F.array_except("_terms", "_title"), a))
    gold = B.gold(spark, sf_dir).select("query_id", "doc").distinct()
    total = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_total"))
    rest = sum((F.col(f"s_{p}") for p in judgement.PARTS if p not in ("topic", "abstract_penalty")), F.lit(0.0))
    d = d.join(gold.withColumn("gold", F.lit(True)), ["query_id", "doc"], "left").join(total, "query_id", "left")
    return materialize(d.select("query_id", "doc", F.size("_title").alias("topics_in_title"), F.size("_abstract").alias("topics_in_abstract"), rest.alias("rest"), (F.size("_title") + F.size("_abstract")).alias("evidence_found"),
                                (F.trim(a) != "").alias("has_abstract"), F.coalesce("gold", F.lit(False)).alias("gold"), F.coalesce("gold_total", F.lit(0)).alias("gold_total")), "cases")


def _evaluated(spark, sf_dir):
    return materialize(X.calibrated(_cases(spark, sf_dir)), "evaluated")


@query(f"WITH {JUDGED} SELECT * FROM evaluated")
def calibration_grid(spark, sf_dir):
    """All 128 configurations of the rules, in one pass over the judged candidates."""
    return _evaluated(spark, sf_dir)


@query(f"WITH {JUDGED} SELECT * FROM evaluated ORDER BY f1 DESC, recall DESC, coalesce(lost, 1), precision DESC, mrr DESC, distance, config LIMIT 1")
def best_configuration(spark, sf_dir):
    return X.best_config(_evaluated(spark, sf_dir))


@query(f"""WITH {JUDGED}, fields AS (SELECT unnest([{', '.join(f"{{'field': '{k}', 'value': {k}::DOUBLE}}" for k in X.GRID)}]) AS x, f1, recall, precision, returned FROM evaluated)
SELECT x.field AS field, x.value AS value, count(*) AS configurations, round(avg(f1) + 1e-9, 6) AS f1, round(avg(recall) + 1e-9, 6) AS recall, round(avg(precision) + 1e-9, 6) AS precision, round(avg(returned) + 1e-9, 6) AS returned FROM fields GROUP BY ALL""")
def threshold_sensitivity(spark, sf_dir):
    return X.sensitivity(_evaluated(spark, sf_dir))


# covers

SUBQUERIES = A.ORACLE["subqueries"].rsplit("SELECT query_id, CAST(place AS INTEGER)", 1)[0].split(A.WANTS, 1)[1].lstrip(", ")
COVER = f"""{B.BASE}, {A.KEYWORDS}, {A.OWN}, {A.ASKED}, {SUBQUERIES}, asks AS (SELECT query_id, purpose, lower(q) AS said FROM p WHERE place <= 5),
parts AS (SELECT query_id * 10 + row_number() OVER (PARTITION BY query_id ORDER BY purpose) AS query_id, query_id AS own, purpose, said, {B.TOK.format('said')} AS t FROM asks),
wanted AS (SELECT query_id, CASE WHEN len(f) > 0 THEN f ELSE t END AS terms FROM (SELECT query_id, t, list_filter(t, lambda w: w NOT IN ({B.sql_list(B.C.QUERY_STOPWORDS)})) AS f FROM parts)),
{B.bm25_sql('got').replace('FROM asked', 'FROM wanted')}, {B.GOLD},
universe AS (SELECT query_id, doc, dense_rank() OVER (PARTITION BY query_id ORDER BY doc) - 1 AS b FROM (SELECT DISTINCT query_id, doc FROM gold)), bounds AS (SELECT query_id, count(*) AS m FROM universe GROUP BY query_id),
opts AS (SELECT u.query_id, parts.purpose, bit_or(1 << u.b::INTEGER) AS mask, len(any_value(parts.t)) AS requests, length(any_value(parts.said)) / 1000.0::DOUBLE AS latency FROM got JOIN parts USING (query_id) JOIN universe u ON u.query_id = parts.own AND u.doc = got.doc JOIN bounds s ON s.query_id = u.query_id AND m <= {X.UNIVERSE} GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY purpose) - 1 AS i FROM opts),
tried AS (SELECT query_id, s, bit_or(mask) AS covered, count(*) AS n, CAST(sum(requests) AS BIGINT) AS requests, sum(latency) AS latency, list(purpose ORDER BY purpose) AS options FROM numbered, range(1, 32) r(s) WHERE (s >> i) & 1 = 1 GROUP BY query_id, s),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(covered) DESC, list_filter(range(0, 12), lambda x: (covered >> x::INTEGER) & 1 = 1) DESC, n, requests, round(latency, 9), options) AS place FROM tried)"""


@query(f"""WITH {COVER} SELECT s.query_id, CAST(m AS INTEGER) AS universe, CASE WHEN m <= {X.UNIVERSE} THEN coalesce(bit_count(covered), 0) END AS covered, CASE WHEN m <= {X.UNIVERSE} THEN coalesce(bit_count(covered) = m, false) END AS complete, CASE WHEN m <= {X.UNIVERSE} THEN coalesce(n, 0) END AS n_options,
  CASE WHEN m <= {X.UNIVERSE} THEN coalesce(requests, 0) END AS requests, CASE WHEN m <= {X.UNIVERSE} THEN round(coalesce(latency, 0), 6) END AS latency, CASE WHEN m <= {X.UNIVERSE} THEN coalesce(array_to_string(options, ','), '') END AS options FROM bounds s LEFT JOIN best b ON b.query_id = s.query_id AND place = 1""")
def minimum_covers(spark, sf_dir):
    """The fewest subqueries of each query that find all of its gold documents (terms count as requests, characters as latency)."""
    asks = A.subqueries(spark, sf_dir)
    number = F.row_number().over(X.Window.partitionBy("query_id").orderBy("purpose"))
    parts = materialize(asks.withColumn("own", F.col("query_id")).withColumn("query_id", F.col("query_id") * 10 + number), "parts")
    asked = parts.select("query_id", T.query_tokens(F.col("text")).alias("terms"))
    docs = B.tokenised(spark, sf_dir)
    got = retrieval.best(asked, materialize(retrieval.hits(asked, docs), "hits", rows=1024, mb=4), docs, B.K).join(parts, "query_id")
    options = got.select(F.col("own").alias("query_id"), F.col("purpose").alias("option"), F.col("doc").alias("item"), F.size(T.tokens(F.col("text"))).alias("requests"), (F.length("text") / 1000.0).alias("latency"))
    c = X.minimum_cover(options, B.gold(spark, sf_dir).select("query_id", F.col("doc").alias("item")), "query_id")
    return c.withColumn("latency", F.round("latency", 6)).withColumn("options", F.array_join("options", ","))


# components


def _customers(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("component"), F.col("c_acctbal").alias("a"), F.abs("c_acctbal").alias("b"))


@query()
def component_intervals(spark, sf_dir):
    """Differences of segments with nations as units; resampling has no SQL, a test holds the bounds against numpy."""
    return X.component_test(_customers(spark, sf_dir), "a", "b", "component", ["seg"])


@query()
def component_ratios(spark, sf_dir):
    """Discount over price of each return flag, whole orders resampled."""
    lines = B.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("off"), F.col("l_extendedprice").alias("price"))
    return X.ratio_interval(lines, "off", "price", "l_orderkey", ["l_returnflag"], rounds=2000)


def _labelled(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("key"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"), F.col("o_totalprice").alias("value"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS size, count(*) FILTER (o_orderpriority = '1-URGENT') AS labels FROM orders GROUP BY o_custkey)
SELECT CAST(round AS INTEGER) AS round, size, count(*) AS components, CAST(sum(labels) AS BIGINT) AS labels FROM c, range(0, 5) r(round) GROUP BY round, size""")
def permuted_components(spark, sf_dir):
    """Labels after five permutations: every size of component has as many as before."""
    d = _labelled(spark, sf_dir)
    p = X.permuted_labels(d, "component", "key", "label", 5).groupBy("round", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("label").alias("labels"))
    return p.groupBy("round", "size").agg(F.count(F.lit(1)).alias("components"), F.sum("labels").alias("labels"))


@query()
def component_permutation_test(spark, sf_dir):
    return X.component_permutation(_labelled(spark, sf_dir), "component", "key", "label", "value", rounds=200)


@query()
def logistic_diagnostic(spark, sf_dir):
    """How well length, words, digits and line breaks tell good documents, out of fold: the rank-sum AUC. Gradient steps have no SQL; a test holds them against numpy."""
    d = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    d = d.select("doc_id", "quality", F.log1p(F.length("text")).alias("length"), F.log1p(F.size(F.split("text", " "))).alias("words"), (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.lit(1), F.length("text"))).alias("digits"),
                 (F.size(F.split("text", "\n")) / F.greatest(F.lit(1), F.length("text"))).alias("breaks"))
    p, _ = X.logistic(d, "doc_id", "quality", ["length", "words", "digits", "breaks"])
    p = materialize(p, "predicted")
    return stats.auc(p.withColumn("fold", F.lit(-1)).unionByName(p), "p", "y", ["fold"])


# stages and parity

STAGES = {"retrieved": "rank IS NOT NULL", "retained": "category IN ('highly_relevant', 'partially_relevant', 'weakly_relevant')", "reranked_10": "rank <= 10", "reranked_5": "rank <= 5"}


@query(f"""WITH {A.JUDGE}, {A.FINAL}, {B.GOLD}, totals AS (SELECT query_id, count(*) AS gold_total FROM gold GROUP BY query_id),
g AS (SELECT query_id, doc, w.domain AS stratum, gold_total, unnest([{', '.join(f"{{'stage': '{k}', 'hit': CASE WHEN coalesce({v}, false) THEN 1 ELSE 0 END}}" for k, v in STAGES.items())}]) AS x FROM gold JOIN totals USING (query_id) JOIN wants w USING (query_id) LEFT JOIN (SELECT query_id, doc, rank, category FROM reranked) USING (query_id, doc))
SELECT x.stage AS stage, stratum, CAST(grouping(stratum) AS INTEGER) AS level, count(*) AS gold, CAST(sum(x.hit) AS BIGINT) AS found, round(sum(x.hit) / count(*)::DOUBLE + 1e-9, 6) AS micro, round(sum(x.hit / gold_total::DOUBLE) / sum(1 / gold_total::DOUBLE) + 1e-9, 6) AS macro FROM g GROUP BY GROUPING SETS ((x.stage, stratum), (x.stage))""")
def stage_recalls(spark, sf_dir):
    """How much gold each stage still has, by the domain of the query and in all."""
    r = judgement.rerank(judgement.breakdown(A.judged(spark, sf_dir), A.CONFIG)).select("query_id", "doc", "rank", "category")
    gold = B.gold(spark, sf_dir).select("query_id", "doc")
    total = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_total"))
    d = gold.join(total, "query_id").join(A.constrained(spark, sf_dir).select("query_id", F.col("domain").alias("stratum")), "query_id").join(r, ["query_id", "doc"], "left")
    return X.stage_recall(d.withColumns({k: F.expr(v) for k, v in STAGES.items()}), list(STAGES))


@query(f"""WITH {B.BASE}, {B.bm25_sql('ranked')}, {B.okapi_sql('okapi')}, {B.PAPERS}, l AS (SELECT query_id, title, year FROM ranked JOIN papers USING (doc)), r AS (SELECT query_id, title, year FROM okapi JOIN papers USING (doc)),
a AS (SELECT query_id, count(*) AS n_left FROM l GROUP BY ALL), b AS (SELECT query_id, count(*) AS n_right FROM r GROUP BY ALL), x AS (SELECT query_id, count(*) AS only_left FROM (FROM l EXCEPT ALL FROM r) GROUP BY ALL), y AS (SELECT query_id, count(*) AS only_right FROM (FROM r EXCEPT ALL FROM l) GROUP BY ALL)
SELECT query_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(only_left, 0) AS only_left, coalesce(only_right, 0) AS only_right, coalesce(only_left, 0) + coalesce(only_right, 0) = 0 AS same FROM a FULL JOIN b USING (query_id) LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id)""")
def candidate_parity(spark, sf_dir):
    """Which queries have the same candidates, by title and year, in two rankings."""
    hit, papers = B.hits(spark, sf_dir), B.papers(spark, sf_dir).select("doc", "title", "year")
    a, b = B.ranked(spark, sf_dir, hit=hit).join(papers, "doc"), B.ranked(spark, sf_dir, hit=hit, k1=1.5, b=0.75, epsilon=0.25).join(papers, "doc")
    return X.parity(a, b, "query_id", ["title", "year"])


# saved indexes, Unicode


@query("""WITH d AS (SELECT lang, ('0x' || substr(sha256('s' || length(doc_id::VARCHAR) || ':' || doc_id || coalesce('s' || length(text) || ':' || text, 'n')), 1, 15))::BIGINT AS h FROM documents)
SELECT lang, count(*) AS n, sum(h::HUGEINT)::VARCHAR AS digest FROM d GROUP BY lang""")
def corpus_fingerprint(spark, sf_dir):
    return index.fingerprint(B.table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("doc"), "text"), ["doc", "text"], ["lang"])


@query(f"WITH {B.BASE}, {B.bm25_sql('ranked')} SELECT query_id, doc, score, rank FROM ranked")
def indexed_topk(spark, sf_dir):
    """BM25 over an index that was saved, checked against its documents and opened again."""
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    path = scratch(spark, "index")
    index.save(docs, T.tokens(F.col("text")), path, "words-1")
    post, lengths, _ = index.load_or_save(docs, T.tokens(F.col("text")), path, scratch(spark, "index"), "words-1")
    asked = B.asked(spark, sf_dir)
    hit = materialize(retrieval.hits_of_index(asked, post, lengths), "hits")
    return retrieval.best(asked, hit, B.tokenised(spark, sf_dir), B.K).select("query_id", "doc", "score", "rank")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '[A-Za-z0-9]+(?:[-_+#.][A-Za-z0-9]+)*|[\x{4e00}-\x{9fff}]+') AS t FROM documents)
SELECT doc_id, len(t) AS tokens, sha256(coalesce(array_to_string(t, ' '), '')) AS digest FROM t""")
def academic_words(spark, sf_dir):
    """Tokens of the normalised text. The SQL has NFC only, which is the same where a text has no compatibility characters; a test holds NFKC."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", T.academic_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))
