"""Queries of text functions, query analysis, planning, judgement and presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import ids
from lectern.functions import text as T
from lectern.operators import audit, judgement, planning
from lectern.shared import materialize
from lectern.sources import corpora

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


def tok_sql(x: str) -> str:
    return f"list_distinct({B.TOK.format(x)})"


def title_sql(x: str) -> str:
    latex = r"\\[a-z]+\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?"
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '{latex}', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def any_sql(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in values) + ")"


@query(rf"""SELECT doc_id, {title_sql('text')} AS title_key, len({B.TOK.format('text')}) AS tokens, len(list_distinct({B.TOK.format('text')})) AS distinct_tokens,
  CASE WHEN regexp_matches(text, '[A-Za-z]') THEN CASE WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'mixed' ELSE 'en' END WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' ELSE 'unknown' END AS script,
  rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160)) AS short, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS source_key, regexp_replace(lower(source), '[^\p{{L}}]', '', 'g') AS source_letters FROM documents""")
def text_normalise(spark, sf_dir):
    t = F.col("text")
    return B.table(spark, sf_dir, "documents").select("doc_id", T.title_key(t).alias("title_key"), F.size(T.tokens(t)).alias("tokens"), F.size(F.array_distinct(T.tokens(t))).alias("distinct_tokens"),
                                                      T.language(t).alias("script"), T.short_text(t).alias("short"), T.alnum_key(F.col("source")).alias("source_key"), T.letters_key(F.col("source")).alias("source_letters"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents)
SELECT token, CASE WHEN length(f) > 3 THEN f ELSE token END AS singular FROM (SELECT token, CASE WHEN length(token) <= 4 THEN token WHEN token LIKE '%ies' THEN substr(token, 1, length(token) - 3) || 'y'
  WHEN regexp_matches(token, '(ches|shes|xes|zes|sses)$') THEN substr(token, 1, length(token) - 2) WHEN token LIKE '%s' AND NOT regexp_matches(token, '(ss|us|is)$') THEN substr(token, 1, length(token) - 1) ELSE token END AS f FROM w)""")
def singular_tokens(spark, sf_dir):
    w = B.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token")).distinct()
    return w.select("token", T.singular(F.col("token")).alias("singular"))


@query(r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN host <> '' AND NOT contains(host, '@') AND NOT regexp_matches(url, '[\s<>"]') THEN url END AS url, host, host = 'example.org' OR host LIKE '%.example.org' AS allowed FROM h""")
def url_safety(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return B.table(spark, sf_dir, "pages").select("page_id", T.safe_url(F.col("url")).alias("url"), host.alias("host"), ((host == "example.org") | host.endswith(".example.org")).alias("allowed"))


HTML = r"""html AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'),
  '(?i)<(?:/?(?:p|div|section|article|h[1-6]|li|ul|ol|table|tr|blockquote|header|footer|main|pre)\b[^>]*|br\s*/?)>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS a FROM pages),
decoded AS (SELECT page_id, replace(replace(replace(replace(replace(replace(a, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS b FROM html),
visible AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM decoded)"""


@query(f"WITH {HTML} SELECT page_id, length(text) AS chars, sha256(text) AS digest FROM visible")
def page_text(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", T.visible_html(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(f"""WITH {HTML}, parts AS (SELECT page_id, unnest(string_split_regex(text, '\\n\\n+')) AS paragraph FROM visible)
SELECT page_id, count(*) AS paragraphs, CAST(sum(length(paragraph)) AS BIGINT) AS chars, min(sha256(paragraph)) AS least, max(sha256(paragraph)) AS most FROM parts GROUP BY page_id""")
def page_paragraphs(spark, sf_dir):
    p = corpora.paragraphs(B.table(spark, sf_dir, "pages").select("page_id", T.visible_html(F.col("html")).alias("t")), "page_id", "t")
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.min("sha256").alias("least"), F.max("sha256").alias("most"))


@query("SELECT conv_id, turn, sha256(text) AS digest, CASE WHEN regexp_full_match(text, '[A-Za-z0-9 _.:,-]{1,240}') THEN text ELSE 'untrusted_source_error:' || substr(sha256(text), 1, 16) END AS safe FROM conversations")
def safe_messages(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"), T.safe_message(F.col("text")).alias("safe"))


INTENT = "CASE " + " ".join(f"WHEN {any_sql('t', p)} THEN '{n}'" for n, p in C.INTENT_PATTERNS) + " ELSE 'general' END"
DOMAIN = f"CASE WHEN {any_sql('lower(text)', C.BIOMEDICAL_TERMS)} THEN 'biomedical' WHEN {any_sql('lower(text)', C.MACHINE_LEARNING_TERMS)} THEN 'machine_learning' WHEN {any_sql('lower(text)', C.COMPUTER_SCIENCE_TERMS)} THEN 'computer_science' ELSE 'general_science' END"


@query(f"SELECT doc_id, {INTENT} AS intent, {DOMAIN} AS domain FROM (SELECT doc_id, text, ' ' || lower(text) || ' ' AS t FROM documents)")
def intent_and_domain(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.intent(F.col("text")).alias("intent"), T.domain(F.col("text")).alias("domain"))


def analysed(spark, sf_dir):
    return materialize(judgement.analysed(B.queries(spark, sf_dir), B.AS_OF), "analysed")


KEYWORDS = rf"""kw AS (SELECT query_id, pos, CASE WHEN lower(w) IN ({B.sql_list(C.KEYWORD_UPPER_TERMS)}) THEN upper(w) ELSE w END AS w FROM (
  SELECT query_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.#-]*') AS ws FROM queries))
  WHERE rtrim(lower(w), '.') <> '' AND rtrim(lower(w), '.') NOT IN ({B.sql_list(C.ANALYSIS_STOPWORDS)}) AND (length(rtrim(lower(w), '.')) > 2 OR upper(w) IN ('AI', 'ML', 'CV'))),
keys AS (SELECT query_id, list(w ORDER BY pos) AS keywords FROM (SELECT query_id, w, pos, row_number() OVER (PARTITION BY query_id, lower(w) ORDER BY pos) AS n FROM kw) WHERE n = 1 GROUP BY query_id)"""


@query(f"WITH {B.QUERIES}, {KEYWORDS} SELECT query_id, coalesce(array_to_string(keywords, ' '), '') AS keywords, {DOMAIN} AS domain, ({INTENT.replace('(t, ', '(t, ')}) AS intent FROM (SELECT *, ' ' || lower(text) || ' ' AS t FROM queries) LEFT JOIN keys USING (query_id)")
def query_analysis(spark, sf_dir):
    return analysed(spark, sf_dir).select("query_id", F.array_join("keywords", " ").alias("keywords"), "domain", "intent")


@query(f"""WITH {B.BASE}, {B.bm25_sql('ranked', 5)}, {KEYWORDS}, seen AS (SELECT DISTINCT query_id, unnest({B.TOK.format('text')}) AS w FROM ranked JOIN documents ON doc = doc_id),
a AS (SELECT query_id, unnest(keywords) AS term FROM keys)
SELECT query_id, count(*) AS terms, count(s.w) AS covered, list_sort(coalesce(list(term) FILTER (s.w IS NULL), [])) AS missing FROM a LEFT JOIN seen s USING (query_id) WHERE false GROUP BY query_id""".replace("LEFT JOIN seen s USING (query_id) WHERE false", "LEFT JOIN seen s ON s.query_id = a.query_id AND s.w = lower(term)").replace("SELECT query_id, count(*) AS terms", "SELECT a.query_id, count(*) AS terms").replace("GROUP BY query_id\"", "GROUP BY a.query_id").rsplit("GROUP BY query_id", 1)[0] + "GROUP BY a.query_id")
def term_coverage(spark, sf_dir):
    found = B.ranked(spark, sf_dir, 5).join(B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc").select("query_id", "text")
    return planning.coverage(analysed(spark, sf_dir), found)


def constrained(spark, sf_dir):
    """The queries with explicit demands made of their own words, so that every rule has cases."""
    q = analysed(spark, sf_dir)
    j, i = T.judgement_terms(F.col("text")), F.col("query_id")
    some = lambda n, r, v: F.when(i % n == r, v)
    bare = q.withColumns({c: F.array().cast("array<string>") for c in ("methods", "datasets", "venues", "types")}).withColumn("years", F.lit(None).cast("struct<start_year:int,end_year:int,label:string>"))
    kind = F.floor(i / 7) % 3  # a range, an open one, one year
    wanted = F.struct(F.when(kind == 0, 2000).when(kind == 1, 2005).otherwise(2010).cast("int").alias("start_year"), F.when(kind == 0, 2015).when(kind == 2, 2010).cast("int").alias("end_year"), F.lit("explicit").alias("label"))
    explicit = q.select("query_id", some(3, 0, F.slice(j, 1, 2)).alias("must"), some(5, 0, F.slice(j, 4, 2)).alias("methods"), some(4, 0, F.slice(j, 3, 1)).alias("datasets"),
                        some(6, 0, F.array(F.lit("method"), F.lit("survey"))).alias("types"), some(3, 1, F.array(F.lit("EN"))).alias("venues"), some(7, 0, wanted).alias("years"), some(11, 0, F.slice(j, 6, 1)).alias("excludes"))
    return materialize(judgement.overlay(bare, explicit), "constrained")


def candidates(spark, sf_dir):
    return B.ranked(spark, sf_dir).select("query_id", "doc").join(constrained(spark, sf_dir), "query_id").join(B.papers(spark, sf_dir), "doc")


def padded(x: str) -> str:
    return f"' ' || regexp_replace({x}, '[^a-z0-9+.#-]+', ' ', 'g') || ' '"


def hit_sql(text: str, term: str) -> str:
    return f"CASE WHEN regexp_full_match({term}, '[a-z0-9+.#-]+') THEN contains({text}_p, ' ' || {term} || ' ') ELSE contains({text}, {term}) END"


def places_sql(terms: str) -> str:
    return f"list_transform({terms}, lambda w: CASE WHEN {hit_sql('t', 'w')} THEN 2 WHEN {hit_sql('a', 'w')} THEN 1 ELSE 0 END)"


def signal_sql(found: str, kind: str) -> str:
    a, b, cap = C.SIGNALS[kind]
    n = lambda p: f"len(list_filter({found}, lambda x: x = {p}))"
    return f"round(least({cap}::DOUBLE, {n(2)} * {a}::DOUBLE + {n(1)} * {b}::DOUBLE), 6)"


def share_sql(found: str) -> str:
    return f"len(list_filter({found}, lambda x: x > 0)) / len({found})::DOUBLE"


def category_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{name}'" for name, least in C.THRESHOLDS) + " ELSE 'irrelevant' END"


def worse_sql(a: str, b: str) -> str:
    order = f"[{B.sql_list(judgement.ORDER)}]"
    return f"CASE WHEN list_position({order}, {b}) > list_position({order}, {a}) THEN {b} ELSE {a} END"


CONFIG = judgement.Config(B.AS_OF)
OWN = rf"""own AS (SELECT query_id, coalesce(list(w ORDER BY pos), []) AS own FROM (SELECT query_id, w, pos, row_number() OVER (PARTITION BY query_id, w ORDER BY pos) AS n FROM (
  SELECT query_id, generate_subscripts(ws, 1) AS pos, lower(unnest(ws)) AS w FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.#-]*') AS ws FROM queries))
  WHERE rtrim(w, '.') <> '' AND rtrim(w, '.') NOT IN ({B.sql_list(C.JUDGEMENT_STOPWORDS)}) AND (length(rtrim(w, '.')) > 2 OR rtrim(w, '.') IN ('ai', 'ml', 'cv'))) WHERE n = 1 GROUP BY query_id)"""
ASKED = f"""wants AS (SELECT query_id, text, own, {DOMAIN} AS domain, ({INTENT}) AS intent, CASE WHEN query_id % 3 = 0 AND len(own) > 0 THEN own[1:2] ELSE list_distinct(list_transform(coalesce(keywords, []), lambda x: lower(x))) END AS must,
  query_id % 3 = 0 AND len(own) > 0 AS explicit_must, CASE WHEN query_id % 5 = 0 THEN own[4:5] ELSE [] END AS methods, CASE WHEN query_id % 4 = 0 THEN own[3:3] ELSE [] END AS datasets, query_id % 6 = 0 AS typed, query_id % 3 = 1 AS placed,
  CASE WHEN query_id % 7 = 0 THEN [2000, 2005, 2010][query_id // 7 % 3 + 1] END AS start_year, CASE WHEN query_id % 7 = 0 THEN [2015, NULL, 2010][query_id // 7 % 3 + 1] END AS end_year, CASE WHEN query_id % 11 = 0 THEN own[6:6] ELSE [] END AS excludes
  FROM (SELECT *, ' ' || lower(text) || ' ' AS t FROM queries) LEFT JOIN own USING (query_id) LEFT JOIN keys USING (query_id))"""
JUDGED = f"""cand AS (SELECT *, lower(title) AS t, lower(abstract) AS a, {padded('lower(title)')} AS t_p, {padded('lower(abstract)')} AS a_p FROM (SELECT query_id, doc FROM ranked) JOIN wants USING (query_id) JOIN papers USING (doc)),
hits AS MATERIALIZED (SELECT *, {places_sql('list_distinct(list_concat(own, must, methods, datasets))')} AS f_topic, {places_sql('own')} AS f_own, {places_sql('must')} AS f_must, {places_sql('methods')} AS f_methods, {places_sql('datasets')} AS f_datasets,
  {places_sql('excludes')} AS f_excludes, CASE domain {' '.join(f"WHEN '{k}' THEN " + places_sql('[' + B.sql_list(v) + ']') for k, v in C.DOMAIN_TERMS.items())} END AS f_domain,
  CASE WHEN typed THEN {' + '.join('CASE WHEN len(list_filter(' + places_sql('[' + B.sql_list(C.PAPER_TYPE_TERMS[k]) + ']') + ', lambda x: x > 0)) > 0 THEN 1 ELSE 0 END' for k in ('method', 'survey'))} ELSE 0 END AS n_types,
  contains(regexp_replace(lower(venue), '[\\s_-]+', '', 'g'), 'en') AS v, coalesce(year < start_year OR year > end_year, false) AS outside FROM cand),
part AS MATERIALIZED (SELECT *, {signal_sql('f_topic', 'topic')} AS s_topic, {signal_sql('f_must', 'must')} AS s_must, {signal_sql('f_methods', 'method')} AS s_method, {signal_sql('f_datasets', 'dataset')} AS s_dataset, {signal_sql('f_domain', 'domain')} AS s_domain_match,
  least({CONFIG.type_cap}::DOUBLE, n_types * {CONFIG.type_bonus}::DOUBLE) AS s_paper_type, CASE WHEN placed AND v THEN {CONFIG.venue_bonus}::DOUBLE ELSE 0 END AS s_venue, CASE WHEN placed AND NOT v THEN {CONFIG.venue_penalty}::DOUBLE ELSE 0 END AS s_venue_penalty,
  CASE WHEN typed AND n_types = 0 THEN {CONFIG.type_penalty}::DOUBLE ELSE 0 END AS s_type_penalty,
  CASE WHEN start_year IS NULL THEN 0::DOUBLE WHEN year <= start_year - 2 THEN {CONFIG.time_early_far} WHEN year < start_year THEN {CONFIG.time_early_near} WHEN year > end_year THEN {CONFIG.time_late} ELSE {CONFIG.time_bonus} END AS tm FROM hits),
summed AS MATERIALIZED (SELECT *, greatest(tm, 0) AS s_temporal, least(tm, 0) AS s_temporal_penalty, 0::DOUBLE + s_topic + s_must + s_method + s_dataset + s_paper_type + s_domain_match + s_venue + greatest(tm, 0) + s_venue_penalty + least(tm, 0) + s_type_penalty AS raw,
  list_filter([CASE WHEN len(own) > 0 THEN {share_sql('f_own')} END, CASE WHEN len(methods) > 0 THEN {share_sql('f_methods')} END, CASE WHEN len(datasets) > 0 THEN {share_sql('f_datasets')} END,
    CASE WHEN len(must) > 0 AND (explicit_must OR list_sort(must) <> list_sort(own)) THEN {share_sql('f_must')} END, CASE WHEN typed THEN n_types / 2::DOUBLE END, CASE WHEN placed THEN CASE WHEN v THEN 1::DOUBLE ELSE 0 END END,
    CASE WHEN start_year IS NOT NULL THEN CASE WHEN outside THEN 0::DOUBLE ELSE 1 END END], lambda x: x IS NOT NULL) AS cov FROM part),
means AS (SELECT *, len(cov) AS n_cov, len(list_filter(cov, lambda x: x >= 0.9)) AS strong, list_sum(cov) / len(cov) AS mean, len(own) >= 3 AND len(list_filter(f_own, lambda x: x > 0)) <= 1 AS broad FROM summed),
bonus AS MATERIALIZED (SELECT *, CASE WHEN n_cov >= 2 AND strong >= 2 AND mean >= 0.6 THEN raw + least({CONFIG.coverage_bonus_cap}::DOUBLE, strong * {CONFIG.coverage_bonus}::DOUBLE) WHEN n_cov >= 2 AND strong <= 1 THEN least(raw + {CONFIG.coverage_penalty}::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * mean) ELSE raw END AS adj FROM means),
capped AS (SELECT *, CASE WHEN n_cov = 0 THEN raw WHEN broad AND strong <= 1 THEN least(adj, {CONFIG.broad_topic_cap}::DOUBLE) ELSE adj END AS full_score FROM bonus),
first AS MATERIALIZED (SELECT *, trim(t) = '' AND trim(a) = '' AS blank, round(least(greatest(full_score, 0), 1), 4) AS clamped FROM capped),
c0 AS MATERIALIZED (SELECT *, CASE WHEN blank THEN 0::DOUBLE ELSE clamped END AS sc, CASE WHEN blank THEN 'insufficient_evidence' ELSE {category_sql('clamped')} END AS ca FROM first),
c1 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN m THEN least(sc, 0.7199::DOUBLE) ELSE sc END AS sc, CASE WHEN m THEN {worse_sql('ca', "'partially_relevant'")} ELSE ca END AS ca) FROM (SELECT *, explicit_must AND len(list_filter(f_must, lambda x: x > 0)) < len(must) AS m FROM c0)),
c2 AS MATERIALIZED (SELECT * REPLACE (nx AS sc, CASE WHEN d THEN {worse_sql('ca', '(' + category_sql('nx') + ')')} ELSE ca END AS ca) FROM (SELECT *, CASE WHEN d THEN greatest(sc + {CONFIG.dataset_penalty}::DOUBLE, 0) ELSE sc END AS nx FROM (SELECT *, len(datasets) > 0 AND len(list_filter(f_datasets, lambda x: x > 0)) = 0 AS d FROM c1))),
c3 AS MATERIALIZED (SELECT * EXCLUDE (nx) REPLACE (nx AS sc, CASE WHEN y THEN {worse_sql('ca', '(' + category_sql('nx') + ')')} ELSE ca END AS ca) FROM (SELECT * EXCLUDE (nx), CASE WHEN y THEN greatest(sc + {CONFIG.type_penalty}::DOUBLE, 0) ELSE sc END AS nx FROM (SELECT *, typed AND n_types = 0 AS y FROM c2))),
c4 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN outside THEN least(sc, 0.7199::DOUBLE) ELSE sc END AS sc, CASE WHEN outside THEN {worse_sql('ca', "'partially_relevant'")} ELSE ca END AS ca) FROM c3),
judged AS MATERIALIZED (SELECT *, len(list_filter(f_excludes, lambda x: x > 0)) > 0 AS ex, CASE WHEN len(list_filter(f_excludes, lambda x: x > 0)) > 0 THEN 0::DOUBLE ELSE round(least(greatest(sc, 0), 1), 4) END AS score, CASE WHEN len(list_filter(f_excludes, lambda x: x > 0)) > 0 THEN 'irrelevant' ELSE ca END AS category FROM c4)"""
WANTS = f"{B.QUERIES}, {KEYWORDS}, {OWN}, {ASKED}"
DEMANDS = f"""dem AS (SELECT query_id, wants.text, domain, coalesce(keywords, []) AS kw, methods, datasets, CASE WHEN placed THEN ['EN'] ELSE [] END AS venues, CASE WHEN typed THEN ['method', 'survey'] ELSE [] END AS types,
  CASE WHEN start_year IS NOT NULL THEN [concat_ws('-', start_year, end_year)] ELSE [] END AS years FROM wants LEFT JOIN keys USING (query_id)),
fac AS (SELECT query_id, f.facet, f.priority, f.terms FROM (SELECT query_id, unnest([{', '.join(f"{{'facet': '{k}', 'priority': {v}, 'terms': {c}}}" for (k, v), c in zip(planning.FACETS.items(), ('methods', 'datasets', 'types', 'venues', 'years')))}]) AS f FROM dem) WHERE len(f.terms) > 0)"""
TOPIC10 = "array_to_string(kw[1:10], ' ')"


@query(f"""WITH {WANTS}, {DEMANDS}, o AS (SELECT query_id, unnest(['original', 'keywords', 'method', 'dataset', 'venue']) AS purpose, generate_subscripts(['original', 'keywords', 'method', 'dataset', 'venue'], 1) AS ord,
  unnest([text, array_to_string(kw, ' '), {', '.join(f"CASE WHEN len({c}) > 0 THEN array_to_string(kw, ' ') || ' ' || array_to_string({c}, ' ') END" for c in ('methods', 'datasets', 'venues'))}]) AS q FROM dem),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(q) ORDER BY ord) AS n FROM o WHERE trim(coalesce(q, '')) <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM u WHERE n = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, purpose, lower(q) AS text FROM p WHERE place <= 5""")
def subqueries(spark, sf_dir):
    return planning.subqueries(constrained(spark, sf_dir), planning.profile("high_recall", 20)[1]).withColumn("text", F.lower("text"))


@query(f"WITH {WANTS}, {DEMANDS} SELECT query_id, facet, priority, lower(array_to_string(terms, ' ')) AS terms FROM fac")
def query_facets(spark, sf_dir):
    return planning.facets(constrained(spark, sf_dir)).withColumn("terms", F.lower(F.array_join("terms", " ")))


@query(rf"""WITH {WANTS}, {DEMANDS}, z AS (SELECT query_id, domain, trim(regexp_replace(regexp_replace(text, '[+\-&|!(){{}}\[\]^"~*?:\\/]+', ' ', 'g'), '\s+', ' ', 'g')) AS safe, array_to_string(kw[1:12], ' ') AS compact, {B.TOK.format('text')} AS tk FROM dem),
y AS (SELECT *, CASE WHEN len(list_filter(tk, lambda w: w NOT IN ({B.sql_list(C.QUERY_STOPWORDS)}))) > 0 THEN list_filter(tk, lambda w: w NOT IN ({B.sql_list(C.QUERY_STOPWORDS)})) ELSE tk END AS qt, regexp_extract(substr(safe, 1, 200), '^(.*)\s\S*$', 1) AS whole FROM z),
r AS (SELECT query_id, unnest(CASE WHEN domain = 'biomedical' THEN ['pubmed', 'openalex'] WHEN domain IN ('computer_science', 'machine_learning') THEN ['arxiv', 'openalex'] ELSE ['openalex', 'arxiv'] END) AS source, compact,
  CASE WHEN length(safe) <= 200 THEN safe WHEN whole <> '' THEN rtrim(whole) ELSE substr(safe, 1, 200) END AS safe, round(CASE WHEN len(qt) = 0 THEN 1 ELSE len(list_intersect(list_distinct(qt), list_distinct({B.TOK.format('compact')}))) / len(list_distinct(qt))::DOUBLE END, 6) AS kept FROM y)
SELECT query_id, source, 'safe_original' AS variant, safe AS text, 1.0::DOUBLE AS retention FROM r WHERE safe <> '' UNION ALL SELECT query_id, source, 'compact', compact, kept FROM r WHERE compact <> '' AND kept >= 0.5""".replace("\\\\", "\\"))
def adapted_queries(spark, sf_dir):
    return planning.adapted(constrained(spark, sf_dir))


@query(f"""WITH {WANTS}, {DEMANDS}, best AS (SELECT query_id, arg_min(terms, priority) AS best FROM fac GROUP BY query_id),
s AS (SELECT query_id, unnest([0, 1, 2]) AS step, unnest([text, {TOPIC10}, CASE WHEN best IS NOT NULL THEN {TOPIC10} || ' ' || array_to_string(best, ' ') END]) AS q FROM dem LEFT JOIN best USING (query_id)),
k AS (SELECT *, {tok_sql('q')} AS w FROM s WHERE trim(coalesce(q, '')) <> '')
SELECT query_id, step, lower(q) AS text FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.query_id = k.query_id AND o.step < k.step AND CASE WHEN len(o.w) + len(k.w) = 0 THEN 1 ELSE len(list_intersect(o.w, k.w)) / len(list_distinct(list_concat(o.w, k.w)))::DOUBLE END >= 0.8)""")
def relaxed_queries(spark, sf_dir):
    return planning.relaxed(constrained(spark, sf_dir)).withColumn("text", F.lower("text"))


JUDGE = f"{B.BASE}, {B.PAPERS}, {B.bm25_sql('ranked')}, {KEYWORDS}, {OWN}, {ASKED}, {JUDGED}"


@query(f"WITH {JUDGE} SELECT query_id, doc, s_topic, s_domain_match FROM judged")
def judgement_signals(spark, sf_dir):
    return judgement.judge(candidates(spark, sf_dir), CONFIG).select("query_id", "doc", "s_topic", "s_domain_match")


def judged(spark, sf_dir):
    return materialize(judgement.judge(candidates(spark, sf_dir), CONFIG), "judged")


@query(f"WITH {JUDGE} SELECT query_id, doc, s_must, s_method, s_dataset, s_paper_type, s_venue, s_temporal, s_venue_penalty, s_temporal_penalty, s_type_penalty, round(full_score - raw, 6) AS coverage_adjustment, score, category FROM judged")
def judgement_components(spark, sf_dir):
    j = judged(spark, sf_dir)
    return j.select("query_id", "doc", *[f"s_{x}" for x in judgement.PARTS if x not in ("topic", "domain_match", "abstract_penalty", "metadata_penalty")], "coverage_adjustment", "score", "category")


@query(f"WITH {JUDGE} SELECT category, count(*) AS n, round(avg(score), 6) AS mean FROM judged GROUP BY category")
def judged_categories(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def weights_sql(i: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {w[i]}::DOUBLE" for k, w in C.INTENT_WEIGHTS.items()) + f" ELSE {C.OTHER_WEIGHTS[i]}::DOUBLE END"


TIERS = f"[{B.sql_list(C.CATEGORY_MULTIPLIER)}]"
FINAL = f"""broken AS MATERIALIZED (SELECT *, round(0.65::DOUBLE * least(log10(citation_count + 1.0::DOUBLE) / log10(1001.0::DOUBLE), 1) + 0.15::DOUBLE * least(n_sources / 3.0::DOUBLE, 1) + 0.12::DOUBLE * least(n_ids / 5.0::DOUBLE, 1) + CASE WHEN placed THEN CASE WHEN s_venue > 0 THEN 0.12::DOUBLE ELSE 0 END WHEN venue <> '' THEN 0.08::DOUBLE ELSE 0 END, 6) AS authority,
  round(CASE WHEN start_year IS NOT NULL THEN CASE WHEN outside THEN 0 WHEN end_year > start_year THEN 0.7::DOUBLE + 0.3::DOUBLE * (year - start_year) / (end_year - start_year) ELSE 0.85::DOUBLE END ELSE 1 - least(greatest(0, {B.AS_OF} - year), 12) / 12.0::DOUBLE END, 6) AS timeliness,
  round(CASE WHEN title <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN abstract <> '' THEN 0.25::DOUBLE ELSE 0 END + 0.15::DOUBLE + CASE WHEN venue <> '' THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE + 0.15::DOUBLE * least(n_ids / 5.0::DOUBLE, 1), 6) AS metadata FROM judged),
final AS (SELECT *, round(({weights_sql(0)} * score + {weights_sql(1)} * authority + {weights_sql(2)} * timeliness + {weights_sql(3)} * metadata) * CASE category {' '.join(f"WHEN '{k}' THEN {m}::DOUBLE" for k, m in C.CATEGORY_MULTIPLIER.items())} END, 4) AS final FROM broken),
reranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_position({TIERS}, category), final DESC, score DESC, citation_count DESC, year DESC, lower(title), sha256(doc::VARCHAR)) AS rank FROM final)"""


@query(f"WITH {JUDGE}, {FINAL} SELECT query_id, doc, CAST(rank AS INTEGER) AS rank, category, score, authority, timeliness, metadata, final FROM reranked")
def reranked(spark, sf_dir):
    r = judgement.rerank(judgement.breakdown(judged(spark, sf_dir), CONFIG))
    return r.select("query_id", "doc", "rank", "category", "score", "authority", "timeliness", "metadata", "final")


@query(f"""WITH {JUDGE}, {FINAL}, q AS (SELECT query_id, doc, category, rank, final, ((CASE WHEN title <> '' THEN 1::DOUBLE ELSE 0 END + CASE WHEN abstract <> '' THEN 1::DOUBLE ELSE 0 END + 1 + CASE WHEN venue <> '' THEN 1::DOUBLE ELSE 0 END) / 4
  + least(n_sources / 2.0::DOUBLE, 1) + least(n_ids / 3.0::DOUBLE, 1) + 0) / 4 AS quality FROM reranked)
SELECT query_id, doc, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_position({TIERS}, category), round(final + 0.02::DOUBLE * quality, 6) DESC, rank) AS INTEGER) AS soft_rank, round(quality, 6) AS quality FROM q""")
def quality_soft_rank(spark, sf_dir):
    r = judgement.rerank(judgement.breakdown(judged(spark, sf_dir), CONFIG))
    q = judgement.quality(F.col("title"), F.col("abstract"), F.col("year"), F.col("venue"), F.col("n_sources"), F.col("n_ids"), F.lit(False))
    return judgement.soft_rank(r.withColumn("quality", q)).select("query_id", "doc", "rank", "soft_rank", F.round("quality", 6).alias("quality"))


@query(f"WITH {JUDGE}, x AS (SELECT category, round(least(greatest(score - s_topic, 0), 1), 4) AS ablated FROM judged) SELECT category, {category_sql('ablated')} AS ablated_category, count(*) AS n FROM x GROUP BY ALL")
def rule_ablation(spark, sf_dir):
    return judgement.ablation(judged(spark, sf_dir), "topic").groupBy("category", "ablated_category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {B.PAPERS}, c AS (SELECT doc, round(0.65::DOUBLE * least(log10(citation_count + 1.0::DOUBLE) / log10(1001.0::DOUBLE), 1) + 0.15::DOUBLE * least(n_sources / 3.0::DOUBLE, 1) + 0.12::DOUBLE * least(n_ids / 5.0::DOUBLE, 1) + 0.08::DOUBLE, 6) AS authority,
  round(CASE WHEN year IS NULL THEN 0.25 ELSE 1 - least(greatest(0, {B.AS_OF} - year), 12) / 12.0::DOUBLE END, 6) AS timeliness FROM papers) SELECT * FROM c""")
def authority_and_timeliness(spark, sf_dir):
    p = B.papers(spark, sf_dir)
    none = F.lit(None).cast("struct<start_year:int,end_year:int,label:string>")
    return p.select("doc", F.round(judgement.authority(F.col("citation_count"), F.col("n_sources"), F.col("n_ids"), F.lit(0.08)), 6).alias("authority"), F.round(judgement.timeliness(none, F.col("year"), B.AS_OF), 6).alias("timeliness"))


@query(f"WITH {B.PAPERS} SELECT CASE WHEN trim(title) <> '' THEN 'title_year:' || {title_sql('title')} || ':' || year END AS key, count(*) AS n, min(doc) AS first FROM papers WHERE {title_sql('title')} <> '' GROUP BY 1")
def title_year_keys(spark, sf_dir):
    k = B.papers(spark, sf_dir).select("doc", ids.title_year(F.col("title"), F.col("year")).alias("key")).where("key is not null")
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))


@query(f"WITH {B.BASE}, {B.PAPERS}, {B.bm25_sql('ranked')} SELECT query_id, year, list_sort(list(rank)) AS ranks FROM ranked JOIN papers USING (doc) GROUP BY query_id, year")
def timeline(spark, sf_dir):
    return B.ranked(spark, sf_dir).join(B.papers(spark, sf_dir).select("doc", "year"), "doc").groupBy("query_id", "year").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))


@query(f"""WITH {B.BASE}, {B.bm25_sql('ranked', 8)}, t AS (SELECT query_id, unnest({B.TOK.format('text')}) AS term FROM ranked JOIN documents ON doc = doc_id),
c AS (SELECT query_id, term, count(*) AS n FROM t WHERE length(term) > 3 GROUP BY ALL) SELECT query_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 4""")
def top_terms(spark, sf_dir):
    from pyspark.sql import Window

    t = B.ranked(spark, sf_dir, 8).join(B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc").select("query_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    c = t.where(F.length("term") > 3).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "term"))).where("rank <= 4")


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 80 THEN 'short' WHEN length(text) <= 160 THEN 'medium' WHEN length(text) <= 320 THEN 'long' ELSE 'very_long' END AS size, contains(text, '"') AS quoted,
  regexp_matches(text, '\b(AND|OR|NOT)\b') AS boolean, regexp_matches(text, '(19|20)\d{2}') AS has_year, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii FROM documents""")
def query_structure(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", audit.query_structure(F.col("text")).alias("s")).select("doc_id", "s.*")
