"""Queries of run reports, shards, signals and source parsers, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import diagnostics as D
from lectern.operators import judgement
from lectern.sources import parsers

from . import binding as B

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f
    return add


def t(spark, sf_dir, name):
    return B.table(spark, sf_dir, name)


def x(sql):
    return F.expr(sql)


# costs and errors


@query("""WITH c AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, min(value) AS least FROM events GROUP BY user_id)
SELECT count(*) AS cases, round(avg(calls), 6) AS avg_calls, round(avg(errors), 6) AS avg_errors, CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(errors) AS BIGINT) AS total_errors FROM c""")
def efficiency_summary(spark, sf_dir):
    c = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return D.efficiency(c, ["calls", "errors"], ["calls", "errors"])


@query("""WITH s AS (SELECT doc_id % 7 AS query_id, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT query_id, raw, uniq AS "distinct", raw - uniq AS repeated, round((raw - uniq) / raw::DOUBLE, 6) AS repeated_share, per_source FROM (SELECT doc_id % 7 AS query_id, count(*) AS raw, count(DISTINCT md5(text)) AS uniq FROM documents GROUP BY ALL)
JOIN (SELECT query_id, string_agg(source || ':' || n, ',' ORDER BY source, n) AS per_source FROM s GROUP BY query_id) USING (query_id)""")
def candidate_count_report(spark, sf_dir):
    c = t(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("query_id"), "source", F.md5("text").alias("identity"))
    return D.candidate_counts(c, ["query_id"]).withColumn("per_source", F.array_join(F.transform("per_source", lambda s: F.concat_ws(":", s["source"], s["n"].cast("string"))), ","))


@query("""WITH e AS (SELECT hour(ts) AS hour, user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings, bool_or(event_type = 'error' AND user_id % 10 = 0) AS failed FROM events GROUP BY ALL),
d AS (SELECT hour, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, count(*) AS cases, count(*) FILTER (warnings > 0) AS warned, count(*) FILTER (failed) AS failed FROM e GROUP BY hour)
SELECT *, round(errors / calls::DOUBLE, 6) AS error_rate, round(warned / cases::DOUBLE, 6) AS warning_rate, round(failed / cases::DOUBLE, 6) AS failed_rate FROM d""")
def error_rate_report(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), F.col("user_id").alias("case"), F.when(F.col("event_type") == "error", "timeout").otherwise(" ").alias("error"), F.when(F.col("event_type") == "signup", "partial").alias("warning"),
                                          ((F.col("event_type") == "error") & (F.col("user_id") % 10 == 0)).alias("failed"))
    return D.error_rates(e, ["hour"])


@query("""WITH c AS (SELECT event_type AS source, CASE WHEN user_id % 9 = 0 THEN 'e' || user_id % 4 END AS error, user_id % 11 = 0 AS skipped, user_id % 5 AS returned, user_id % 13 / 4.0::DOUBLE AS latency FROM events),
m AS (SELECT source, error, count(*) AS n FROM c WHERE error IS NOT NULL AND NOT skipped GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, error) AS r FROM m)
SELECT source, calls, successes, errors, skips, returned, latency, coalesce(messages, '') AS messages FROM (SELECT source, count(*) AS calls, count(*) FILTER (error IS NULL AND NOT skipped) AS successes, count(*) FILTER (error IS NOT NULL AND NOT skipped) AS errors, count(*) FILTER (skipped) AS skips,
  CAST(sum(returned) AS BIGINT) AS returned, round(avg(latency), 6) AS latency FROM c GROUP BY source) LEFT JOIN (SELECT source, string_agg(error || ':' || n, ',' ORDER BY r) AS messages FROM r WHERE r <= 3 GROUP BY source) USING (source)""")
def source_reliability_report(spark, sf_dir):
    c = t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), x("CASE WHEN user_id % 9 = 0 THEN concat('e', user_id % 4) END").alias("error"), x("user_id % 11 = 0").alias("skipped"), x("user_id % 5").alias("returned"), x("user_id % 13 / 4.0D").alias("latency"))
    return D.source_reliability(c, 3).withColumn("messages", F.array_join("messages", ","))


@query("""SELECT event_type, CAST(sum(user_id) FILTER (user_id % 3 = 0) AS BIGINT) AS total, count(*) FILTER (user_id % 3 = 0) AS known, count(*) FILTER (user_id % 3 = 1) AS unavailable, count(*) FILTER (user_id % 3 = 2) AS not_applicable, count(*) FILTER (user_id % 3 = 1) = 0 AS complete FROM events GROUP BY event_type""")
def known_quantities(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("value"), x("element_at(array('known', 'unavailable', 'not_applicable'), CAST(user_id % 3 + 1 AS INT))").alias("state"))
    return D.quantities(e, ["event_type"])


# stages

STAGE = """st AS (SELECT o_orderpriority AS stratum, o_custkey % 3 <> 0 AS found, o_orderstatus <> 'P' AS returned, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 + 1 END AS rank FROM orders),
rr AS (SELECT stratum, count(*) AS eligible, count(*) FILTER (rank <= 5) AS top_5, count(*) FILTER (rank <= 10) AS top_10, count(*) FILTER (rank <= 20) AS top_20, count(*) FILTER (rank IS NULL OR rank > 20) AS outside,
  round(avg(rank), 6) AS mean_rank, quantile_cont(rank, 0.5) AS median_rank, round(count(*) FILTER (rank IS NULL OR rank > 20) / count(*)::DOUBLE, 6) AS outside_rate FROM st WHERE found AND returned GROUP BY stratum)"""


def _stage(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), x("o_custkey % 3 <> 0").alias("found"), x("o_orderstatus <> 'P'").alias("returned"), x("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 + 1 END").alias("rank"))


@query(f"WITH {STAGE} SELECT * FROM rr")
def reranking_report(spark, sf_dir):
    return D.reranking(_stage(spark, sf_dir), ["stratum"])


@query(f"""WITH {STAGE}, m AS (SELECT stratum, eligible % 50 AS cases, top_20 / eligible::DOUBLE AS recall, outside_rate, CASE WHEN eligible % 2 = 0 THEN 0.2 END AS error_rate FROM rr)
SELECT stratum, array_to_string(list_filter([CASE WHEN cases < 30 THEN 'insufficient_sample' END, CASE WHEN recall < 0.5 THEN 'retrieval_recall_bottleneck' END, CASE WHEN outside_rate >= 0.25 THEN 'reranking_bottleneck' END, CASE WHEN error_rate >= 0.2 THEN 'source_reliability_bottleneck' END], lambda l: l IS NOT NULL), ',') AS labels FROM m""")
def bottleneck_labels(spark, sf_dir):
    r = D.reranking(_stage(spark, sf_dir), ["stratum"])
    m = r.select("stratum", (F.col("eligible") % 50).alias("cases"), (F.col("top_20") / F.col("eligible")).alias("recall"), "outside_rate", F.when(F.col("eligible") % 2 == 0, 0.2).alias("error_rate"))
    return D.bottlenecks(m).select("stratum", F.array_join("labels", ",").alias("labels"))


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN 'source_error' WHEN doc_id % 7 = 0 THEN 'source_unavailable' WHEN doc_id % 5 = 0 THEN 'metadata_mismatch' WHEN n_chars % 120 BETWEEN 21 AND 50 THEN 'result_limit_truncation' WHEN n_chars % 120 BETWEEN 51 AND 100 THEN 'query_over_broad_ranked_below_limit'
  WHEN doc_id % 13 = 0 THEN 'adapter_term_loss' WHEN n_chars % 10 = 1 THEN 'lexical_mismatch' WHEN n_chars % 10 = 2 THEN 'query_over_restrictive' WHEN n_chars % 10 = 3 THEN 'identifier_available_but_query_not_matched' ELSE 'unknown' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def retrieval_failures(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    s = {"source_error": x("doc_id % 11 = 0"), "identifier_available": x("doc_id % 7 <> 0"), "metadata_mismatch": x("doc_id % 5 = 0"), "rank": x("n_chars % 120"), "term_loss": x("doc_id % 13 = 0"), "coverage": x("CASE WHEN n_chars % 10 <> 1 THEN 0.5D END"),
         "over_restrictive": x("n_chars % 10 = 2"), "title_hit": x("n_chars % 10 = 3")}
    return d.groupBy(D.retrieval_failure(s).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tok(c: str) -> str:
    return f"list_distinct({B.TOK.format(c)})"


@query(f"""WITH d AS (SELECT doc_id, {tok('substr(text, 1, 80)')} AS q, {tok('substr(text, 81, 400)')} AS g FROM documents)
SELECT doc_id, len(q) AS asked, len(list_intersect(q, g)) AS matched, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, g)) / len(q)::DOUBLE ELSE 0 END, 6) AS coverage,
  round(CASE WHEN len(q) + len(g) > 0 THEN len(list_intersect(q, g)) / len(list_distinct(list_concat(q, g)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM d""")
def lexical_overlaps(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", T.tokens(F.substring("text", 1, 80)).alias("q"), T.tokens(F.substring("text", 81, 400)).alias("g"))
    return d.select("doc_id", D.lexical_overlap(F.col("q"), F.col("g")).alias("o")).select("doc_id", "o.*")


@query(f"""WITH d AS (SELECT doc_id, {tok('substr(text, 1, 80)')} AS q, {tok('substr(text, 1, 40)')} AS a, {tok('substr(text, 41, 400)')} AS g FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(q, lambda w: list_contains(g, w) AND NOT list_contains(a, w))), ' ') AS lost FROM d""")
def adapter_term_losses(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    part = lambda a, n: T.tokens(F.substring("text", a, n))
    return d.select("doc_id", F.array_join(F.array_sort(D.term_loss(part(1, 80), part(1, 40), part(41, 400))), " ").alias("lost"))


@query("""SELECT 'lang' AS dimension, lang AS label, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(n_chars), 6) FROM documents GROUP BY source""")
def feature_slices(spark, sf_dir):
    return D.slices(t(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


# queries and candidates


@query(r"""WITH q AS (SELECT conv_id, turn, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations)
SELECT conv_id, turn, length(t) AS characters, len(regexp_extract_all(t, '\p{Nd}')) AS digits, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w)::DOUBLE ELSE 0 END, 6) AS mean_token, len(regexp_extract_all(t, '[^\x00-\x7F]')) AS non_ascii, round(turn / 9.0::DOUBLE, 6) AS position,
  len(regexp_extract_all(t, '\p{P}')) AS punctuation, len(regexp_extract_all(t, '["''“”‘’「」『』]')) AS quotes, len(w) AS tokens, len(list_distinct(w)) AS distinct_tokens, len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda y: regexp_full_match(y, '(19|20)[0-9]{2}'))) AS years,
  list_has_any(w, ['and', 'or', 'not']) OR contains(t, '&&') OR contains(t, '||') AS has_boolean, regexp_matches(t, '[()]') AS has_parentheses, regexp_matches(t, '[?？]') AS has_question, len(regexp_extract_all(t, '["''“”‘’「」『』]')) >= 2 AS has_quoted, regexp_matches(t, '[^\x00-\x7F]') AS has_unicode,
  len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda y: regexp_full_match(y, '(19|20)[0-9]{2}'))) > 0 AS has_year, CASE WHEN len(w) <= 8 THEN 'short' WHEN len(w) <= 20 THEN 'medium' ELSE 'long' END AS bucket FROM q""")
def query_feature_table(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in D.query_features(F.col("text"), F.col("turn"), F.lit(10)).items()])


SIGNALS = """pv AS (SELECT l_suppkey % 20 AS query_id, l_partkey AS doc, l_returnflag AS source, CASE WHEN l_quantity <> 3 THEN l_linestatus END AS query, CASE WHEN l_linenumber = 1 THEN 'original' ELSE 'derived' END AS purpose, CASE WHEN l_linenumber < 7 THEN l_linenumber ELSE 0 END AS rank FROM lineitem),
ls AS (SELECT query_id, doc, source, query, min(CASE WHEN rank > 0 THEN rank END) AS best FROM pv WHERE query IS NOT NULL GROUP BY ALL), pr AS (SELECT query_id, doc, min(best) AS best_rank, count(*) AS lists, count(DISTINCT source) AS sources, count(*) FILTER (best = 1) AS original_lists FROM ls GROUP BY ALL),
sg AS (SELECT query_id, doc, best_rank, round(coalesce(1 / best_rank::DOUBLE, 0), 6) AS reciprocal, coalesce(lists, 0) AS lists, coalesce(sources, 0) AS sources, coalesce(original_lists, 0) AS original_lists, coalesce(lists, 0) - coalesce(original_lists, 0) AS derived_lists, CASE WHEN incomplete THEN 'incomplete' ELSE 'complete' END AS provenance
  FROM (SELECT query_id, doc, bool_or(query IS NULL OR rank = 0) AS incomplete FROM pv GROUP BY ALL) LEFT JOIN pr USING (query_id, doc))"""


def _signals(spark, sf_dir):
    return D.candidate_signals(t(spark, sf_dir, "lineitem").select(x("l_suppkey % 20").alias("query_id"), F.col("l_partkey").alias("doc"), F.col("l_returnflag").alias("source"), x("CASE WHEN l_quantity <> 3 THEN l_linestatus END").alias("query"),
                                                                   x("CASE WHEN l_linenumber = 1 THEN 'original' ELSE 'derived' END").alias("purpose"), x("CASE WHEN l_linenumber < 7 THEN l_linenumber ELSE 0 END").alias("rank")))


@query(f"WITH {SIGNALS} SELECT * FROM sg")
def candidate_signal_rows(spark, sf_dir):
    return _signals(spark, sf_dir)


@query(f"WITH {SIGNALS} SELECT query_id, doc, rank FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY lists DESC, doc) AS rank FROM sg) WHERE rank <= 10")
def ranked_by_signal(spark, sf_dir):
    return D.rank_by(_signals(spark, sf_dir), "lists").where("rank <= 10").select("query_id", "doc", "rank")


@query("""SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round_even(score / 0.05::DOUBLE, 0) DESC, cites DESC, coalesce(year, -1) DESC, doc) AS INTEGER) AS rank FROM (
  SELECT doc_id % 20 AS query_id, doc_id AS doc, n_chars % 100 / 100.0::DOUBLE AS score, n_chars % 13 AS cites, CASE WHEN n_chars % 5 > 0 THEN 1990 + n_chars % 30 END AS year FROM documents)""")
def bucketed_ranking(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(x("doc_id % 20").alias("query_id"), F.col("doc_id").alias("doc"), x("n_chars % 100 / 100.0D").alias("score"), x("n_chars % 13").alias("cites"), x("CASE WHEN n_chars % 5 > 0 THEN 1990 + n_chars % 30 END").alias("year"))
    return D.bucketed_order(d, "score", "cites", "year").select("query_id", "doc", "rank")


@query("""WITH c AS (SELECT doc_id % 20 AS query_id, doc_id AS doc, n_chars AS rank, ['highly_relevant', 'partially_relevant', 'weakly_relevant', 'irrelevant'][n_chars % 4 + 1] AS category FROM documents)
SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY category, rank, doc) AS INTEGER) AS place FROM c WHERE category IN ('highly_relevant', 'partially_relevant')""")
def selected_results(spark, sf_dir):
    c = t(spark, sf_dir, "documents").select(x("doc_id % 20").alias("query_id"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("rank"), x("element_at(array('highly_relevant', 'partially_relevant', 'weakly_relevant', 'irrelevant'), CAST(n_chars % 4 + 1 AS INT))").alias("category"))
    return D.selected(c, partial=True).select("query_id", "doc", "place")


@query(f"""WITH d AS (SELECT doc_id, {tok('substr(text, 1, 120)')} AS w FROM documents) SELECT a.doc_id, CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END >= 0.8 AS copy FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def near_duplicate_titles(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 120).alias("a"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").select("doc_id", D.near_duplicate(F.col("a"), F.col("b")).alias("copy"))


@query("SELECT doc_id, round((CASE WHEN trim(split_part(text, chr(10), 1)) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN n_chars % 7 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 6 > 0 THEN 1 ELSE 0 END) / 5.0::DOUBLE, 4) AS completeness FROM documents")
def metadata_completeness(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", judgement.completeness(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), x("doc_id % 3"), x("CASE WHEN n_chars % 7 > 0 THEN n_chars END"), x("doc_id % 6")).alias("completeness"))


# shards, runs and resumption


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM documents")
def shard_assignment(spark, sf_dir):
    return D.shards(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8)


@query("""SELECT shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(CAST('0x' || substr(sha256(doc_id::VARCHAR), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM documents) GROUP BY shard""")
def shard_plan(spark, sf_dir):
    return D.shard_plan(D.shards(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8), "doc_id")


ATTEMPTS = "SELECT o_custkey AS shard, o_orderkey AS attempt, CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN first_value(o_orderkey) OVER w WHEN o_custkey % 10 = 2 THEN lag(o_orderkey, 1, -1) OVER w ELSE lag(o_orderkey) OVER w END AS supersedes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query(f"""WITH a AS ({ATTEMPTS}), p AS (SELECT a.*, EXISTS (SELECT 1 FROM a b WHERE b.shard = a.shard AND b.supersedes = a.attempt) AS later, a.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a b WHERE b.shard = a.shard AND b.attempt = a.supersedes) AS lost FROM a),
g AS (SELECT shard, count(*) AS attempts, count(*) FILTER (supersedes IS NULL) AS roots, count(*) FILTER (NOT later) AS tips, max(attempt) FILTER (NOT later) AS tip, bool_or(lost) AS gap, count(supersedes) > count(DISTINCT supersedes) AS branch FROM p GROUP BY shard),
v AS (SELECT *, CASE WHEN gap THEN 'gap' WHEN branch THEN 'branch' WHEN tips = 0 OR roots = 0 THEN 'cycle' WHEN tips > 1 OR roots > 1 THEN 'several_chains' END AS violation FROM g) SELECT shard, attempts, CASE WHEN violation IS NULL THEN tip END AS tip, violation FROM v""")
def shard_attempts(spark, sf_dir):
    return D.attempts(spark.sql(ATTEMPTS.replace("FROM orders", "FROM {orders}"), orders=t(spark, sf_dir, "orders")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def resume_plan(spark, sf_dir):
    return D.resume(t(spark, sf_dir, "orders").select("o_orderkey"), t(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 < 4) AS n, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 2) AS overlap")
def resumed_run(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    whole, both = D.resumed(o.where("o_orderkey % 5 < 3"), o.where("o_orderkey % 5 IN (2, 3)"), ["o_orderkey"])
    return whole.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(both.agg(F.count(F.lit(1)).alias("overlap"))))


@query("""WITH r AS (SELECT l_returnflag AS run, l_linestatus, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL)
SELECT a.run, a.l_linestatus, round(a.quantity - b.quantity, 6) AS delta_quantity, round(a.discount - b.discount, 6) AS delta_discount FROM r a JOIN r b ON b.run = 'N' AND a.l_linestatus = b.l_linestatus WHERE a.run <> 'N'""")
def run_comparison(spark, sf_dir):
    r = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run"), "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return D.run_deltas(r, "N", ["quantity", "discount"], ["l_linestatus"])


@query("""WITH r AS (SELECT user_id AS run, max(ts) AS seen FROM events GROUP BY user_id), o AS (SELECT run FROM r WHERE seen < (SELECT max(seen) FROM r) - INTERVAL 1 HOUR), k AS (SELECT run FROM r ORDER BY seen DESC, run DESC LIMIT 60)
SELECT run, 'age' AS reason FROM o UNION ALL SELECT run, 'count' FROM r WHERE run NOT IN (SELECT run FROM k) AND run NOT IN (SELECT run FROM o)""")
def expired_runs(spark, sf_dir):
    return D.expired(t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("at")), "1 HOUR", 60)


@query("""WITH k AS (SELECT doc_id, count(DISTINCT (quality, toxic)) AS n, min(quality) AS quality, min(toxic) AS toxic FROM (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality + 1, toxic FROM labels WHERE doc_id % 9 = 0) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n = 1 THEN quality END AS quality, CASE WHEN n = 1 THEN toxic END AS toxic, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM documents d LEFT JOIN k USING (doc_id)""")
def crosswalk_join(spark, sf_dir):
    k = t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return D.crosswalk(t(spark, sf_dir, "documents").select("doc_id"), k.unionByName(k.where("doc_id % 9 = 0").withColumn("quality", F.col("quality") + 1)), "doc_id", ["quality", "toxic"])


@query("SELECT doc_id, sha256(doc_id::VARCHAR) AS digest FROM documents ORDER BY digest, doc_id LIMIT 25")
def probe_selection(spark, sf_dir):
    return D.probes(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


@query("""WITH o AS (SELECT lang, doc_id % 1000 AS ordinal FROM documents), d AS (SELECT DISTINCT * FROM o), g AS (SELECT *, ordinal = row_number() OVER (PARTITION BY lang ORDER BY ordinal) - 1 AS fits FROM d)
SELECT lang, count(*) AS n, min(ordinal) AS least, max(ordinal) AS most, round(avg(ordinal), 6) AS mean, count(*) FILTER (ordinal < 250) AS q1, count(*) FILTER (ordinal >= 250 AND ordinal < 500) AS q2, count(*) FILTER (ordinal >= 500 AND ordinal < 750) AS q3, count(*) FILTER (ordinal >= 750) AS q4, count(*) FILTER (fits) AS prefix FROM g GROUP BY lang""")
def order_report(spark, sf_dir):
    return D.order_diagnostics(t(spark, sf_dir, "documents").select("lang", x("doc_id % 1000").alias("ordinal")), ["lang"], 1000)


# parsers: documents are written in a service's format and read back

WORDS = "trim(regexp_replace(substr(text, 1, 80), '[^A-Za-z]+', ' ', 'g'))"
SEEN = f"w AS (SELECT doc_id, {WORDS} AS words, lang, source AS src, n_chars FROM documents)"


def _words(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z]+", " ")).alias("words"), "lang", F.col("source").alias("src"), "n_chars")


OUT = ("doc_id", "title", "first_author", "year", "venue", "abstract", "doi", "other_id", "landing_page", "citation_count", "source")


def _out(p, other):
    return p.select("doc_id", "title", F.get("authors", F.lit(0)).alias("first_author"), F.col("year").cast("long").alias("year"), "venue", "abstract", "doi", F.col(other).alias("other_id"), "landing_page", F.col("citation_count").cast("long").alias("citation_count"), "source")


@query(f"""WITH {SEEN} SELECT doc_id, CASE WHEN words = '' THEN 'Untitled' ELSE words END AS title, 'A ' || src AS first_author, CASE WHEN n_chars % 5 > 0 THEN 1990 + n_chars % 30 END AS year, CASE WHEN n_chars % 3 > 0 THEN lang END AS venue, CASE WHEN words = '' THEN '' ELSE 'zero ' || split_part(words, ' ', 1) END AS abstract,
  '10.1/x' || doc_id AS doi, 'w' || doc_id AS other_id, CASE WHEN n_chars % 3 > 0 THEN 'https://example.org/' || doc_id ELSE 'https://openalex.org/W' || doc_id END AS landing_page, n_chars % 50 AS citation_count, 'openalex' AS source FROM w""")
def parsed_works(spark, sf_dir):
    w = _words(spark, sf_dir)
    first = F.split_part("words", F.lit(" "), F.lit(1))
    place = F.when(x("n_chars % 3 > 0"), F.struct(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("landing_page_url"), F.struct(F.col("lang").alias("display_name")).alias("source")))
    url = F.concat(F.lit("https://openalex.org/W"), F.col("doc_id").cast("string"))
    json = F.to_json(F.struct(F.concat(F.lit("  "), F.col("words")).alias("display_name"), x("CASE WHEN n_chars % 5 > 0 THEN 1990 + n_chars % 30 END").alias("publication_year"), x("n_chars % 50").alias("cited_by_count"), url.alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), F.col("doc_id").cast("string")).alias("doi"),
                              F.array(F.struct(F.struct(F.concat(F.lit("A  "), F.col("src")).alias("display_name")).alias("author"))).alias("authorships"), place.alias("primary_location"),
                              F.when(F.col("words") != "", F.map_from_arrays(F.array(first, F.lit("zero ")), F.array(F.array(F.lit(1)), F.array(F.lit(0))))).alias("abstract_inverted_index")))
    return _out(parsers.works(w.withColumn("json", json), "json", ["doc_id"]), "openalex_id")


@query(f"""WITH {SEEN} SELECT doc_id, CASE WHEN words = '' THEN 'Untitled' ELSE words END AS title, src AS first_author, 1990 + n_chars % 30 AS year, lang AS venue, CASE WHEN n_chars % 2 = 0 THEN words ELSE '' END AS abstract, CASE WHEN n_chars % 4 > 0 THEN '10.2/y' || doc_id END AS doi,
  's' || doc_id AS other_id, CASE WHEN n_chars % 3 > 0 THEN 'https://example.org/' || doc_id ELSE 's' || doc_id END AS landing_page, greatest(n_chars % 50 - 10, 0) AS citation_count, 'semantic_scholar' AS source FROM w""")
def parsed_papers(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    json = F.to_json(F.struct(F.col("words").alias("title"), x("CAST(1990 + n_chars % 30 AS STRING)").alias("year"), F.col("lang").alias("venue"), x("CASE WHEN n_chars % 2 = 0 THEN words END").alias("abstract"), F.concat(F.lit("s"), i).alias("paperId"), F.when(x("n_chars % 3 > 0"), F.concat(F.lit("https://example.org/"), i)).alias("url"),
                              x("n_chars % 50 - 10").alias("citationCount"), F.array(F.struct(F.lit(" ").alias("name")), F.struct(F.col("src").alias("name"))).alias("authors"), F.create_map(F.lit("DOI"), F.when(x("n_chars % 4 > 0"), F.concat(F.lit("10.2/Y"), i))).alias("externalIds")))
    return _out(parsers.papers(_words(spark, sf_dir).withColumn("json", json), "json", ["doc_id"]), "semantic_scholar_id")


@query(f"""WITH {SEEN} SELECT doc_id, CASE WHEN words = '' THEN 'Untitled' ELSE words END AS title, 'B ' || src AS first_author, 1990 + n_chars % 30 AS year, CASE WHEN n_chars % 3 > 0 THEN lang ELSE 'arXiv' END AS venue, words AS abstract, NULL::VARCHAR AS doi, '2001.' || (10000 + doc_id) AS other_id,
  'http://arxiv.org/abs/2001.' || (10000 + doc_id) || 'v2' AS landing_page, 0 AS citation_count, 'arxiv' AS source FROM w""")
def parsed_entries(spark, sf_dir):
    xml = x("""concat('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/2001.', 10000 + doc_id, 'v2</id><title>', words, '</title><summary> ', words, '</summary><published>', 1990 + n_chars % 30, '-01-02</published><author><name>B ', src, '</name></author>',
      CASE WHEN n_chars % 3 > 0 THEN concat('<arxiv:journal_ref>', lang, '</arxiv:journal_ref>') ELSE '' END, '</entry>')""")
    return _out(parsers.entries(_words(spark, sf_dir).withColumn("xml", xml), "xml", ["doc_id"]), "arxiv_id")


@query(f"""WITH {SEEN} SELECT doc_id, CASE WHEN words = '' THEN 'Untitled' ELSE words END AS title, ['Ann ', 'A ', ''][n_chars % 3 + 1] || src AS first_author, 1990 + n_chars % 30 AS year, CASE WHEN n_chars % 3 > 0 THEN lang ELSE 'PubMed' END AS venue, trim(words || ' n 2 end') AS abstract, '10.3/z' || doc_id AS doi, doc_id::VARCHAR AS other_id,
  'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS landing_page, 0 AS citation_count, 'pubmed' AS source FROM w""")
def parsed_articles(spark, sf_dir):
    xml = x("""concat('<PubmedArticle><MedlineCitation><PMID>', doc_id, '</PMID><Article><Journal>', CASE WHEN n_chars % 3 > 0 THEN concat('<Title>', lang, '</Title>') ELSE '' END, '<JournalIssue><PubDate>', CASE WHEN n_chars % 2 = 0 THEN concat('<Year>', 1990 + n_chars % 30, '</Year>') ELSE concat('<MedlineDate>', 1990 + n_chars % 30, ' Jan</MedlineDate>') END,
      '</PubDate></JournalIssue></Journal><ArticleTitle>', words, '</ArticleTitle><Abstract><AbstractText>', words, ' n <sup>2</sup></AbstractText><AbstractText>end</AbstractText></Abstract><AuthorList><Author><LastName>', src, '</LastName>', CASE n_chars % 3 WHEN 0 THEN '<ForeName>Ann</ForeName><Initials>X</Initials>' WHEN 1 THEN '<Initials>A</Initials>' ELSE '' END,
      '</Author><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.3/Z', doc_id, '</ArticleId></ArticleIdList></PubmedData></PubmedArticle>')""")
    return _out(parsers.articles(_words(spark, sf_dir).withColumn("xml", xml), "xml", ["doc_id"]), "pubmed_id")
