"""Queries of Boolean retrieval, adaptive retrieval and query evolution, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T
from lectern.operators import adaptive, boolean, evolution, planning, retrieval
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


# Boolean retrieval

WORDS = "[a-zA-Z][a-zA-Z0-9+.#-]*"


def distinct_sql(x: str) -> str:
    """Trimmed values, the first of each, as lower case."""
    return f"list_filter(list_transform({x}, lambda v: lower(trim(v))), lambda v, i: v <> '' AND list_position(list_transform({x}, lambda w: lower(trim(w))), v) = i)"


def reliable_sql(terms: str, given: str) -> str:
    plain = "regexp_full_match(lower(t), '[a-z0-9+.#-]+')"
    held = f"CASE WHEN {plain} THEN contains(pad, ' ' || lower(t) || ' ') ELSE contains(lower(text), lower(t)) END"
    return distinct_sql(f"list_filter({terms}, lambda t: length(t) <= 80 AND NOT (explicit_must AND list_contains(must, lower(t))) AND lower(t) NOT IN ({B.sql_list(C.GENERIC_PAPER_TERMS)}) AND len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_+.#-]+'), lambda w: w NOT IN ({B.sql_list(C.UNRELIABLE_FACET_TERMS)}))) > 0 AND ({given} OR {held}))".replace("{{", "{").replace("}}", "}"))


TASKS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in C.TASK_TERMS) + "], lambda x: x IS NOT NULL)"
DISJUNCTIVE = f"""facts AS (SELECT *, {A.padded('lower(text)')} AS pad, {TASKS} AS tasks, CASE WHEN typed THEN ['method', 'survey'] ELSE [] END AS types, CASE WHEN placed THEN ['en'] ELSE [] END AS venues FROM wants),
shaped AS (SELECT *, list_concat(methods, datasets, venues, types, tasks) AS structured FROM facts),
topics AS (SELECT *, list_filter(own, lambda t: NOT list_contains(structured, t) AND NOT list_contains(flatten(list_transform(structured, lambda s: regexp_extract_all(s, '[a-z][a-z0-9+.#-]*'))), t) AND t NOT IN ({B.sql_list(C.GENERIC_PAPER_TERMS)}))[1:12] AS topic FROM shaped),
turns AS (SELECT query_id, CASE WHEN explicit_must THEN must ELSE [] END AS musts, {reliable_sql('topic', 'false')} AS a, {reliable_sql('methods', 'len(methods) > 0')} AS b, {reliable_sql('datasets', 'len(datasets) > 0')} AS c, {reliable_sql('tasks', 'false')} AS d FROM topics),
dealt AS (SELECT query_id, musts, list_filter(flatten(list_transform(range(1, 41), lambda i: [a[i], b[i], c[i], d[i]])), lambda x: x IS NOT NULL) AS every FROM turns),
disjunctive AS (SELECT * FROM (SELECT query_id, musts, {distinct_sql('every')}[1:{C.DISJUNCTIVE_TERMS}] AS alternatives FROM dealt) WHERE len(alternatives) >= {C.DISJUNCTIVE_LEAST})"""
PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace({}, '[(){{}}\[\]:;!?*^~\\"''`,|&=<>/]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_+#.\-\s]+', ' ', 'g'), '\s+', ' ', 'g'))"""


def demands(spark, sf_dir):
    """Disjunctive plans of the queries with explicit demands."""
    return materialize(planning.disjunctive(A.constrained(spark, sf_dir)), "disjunctive")


@query(f"""WITH {A.WANTS}, {DISJUNCTIVE},
plain AS (SELECT query_id, list_filter(list_transform(musts, lambda x: {PLAIN.format('x')}), lambda x: x <> '') AS m, list_filter(list_transform(alternatives, lambda x: {PLAIN.format('x')}), lambda x: x <> '') AS a FROM disjunctive),
clause AS (SELECT query_id, list_transform(m, lambda x: CASE WHEN contains(x, ' ') THEN 'all:"' || x || '"' ELSE 'all:' || x END) AS m, list_transform(list_filter(a, lambda x: NOT list_contains(m, x)), lambda x: CASE WHEN contains(x, ' ') THEN 'all:"' || x || '"' ELSE 'all:' || x END) AS a FROM plain),
tried AS (SELECT query_id, n, array_to_string(list_concat(CASE WHEN n > 0 THEN ['(' || array_to_string(a[1:n], ' OR ') || ')'] ELSE [] END, m), ' AND ') AS e FROM clause, range(0, {C.DISJUNCTIVE_TERMS + 1}) r(n) WHERE n <= len(a))
SELECT query_id, arg_max(e, n) AS expression FROM tried WHERE n = 0 OR length(e) <= {C.DISJUNCTIVE_LENGTH} GROUP BY query_id""")
def disjunctive_queries(spark, sf_dir):
    return demands(spark, sf_dir).select("query_id", F.lower(boolean.expression(F.col("alternatives"), F.col("musts"))).alias("e")).select("query_id", F.regexp_replace(F.regexp_replace("e", " or all:", " OR all:"), " and all:", " AND all:").alias("expression"))


MATCHING = f"""said AS (SELECT doc_id AS doc, ' ' || array_to_string({B.TOK.format('text')}, ' ') || ' ' AS said FROM documents),
phrased AS (SELECT query_id, list_transform(musts, lambda x: array_to_string({B.TOK.format('x')}, ' ')) AS m, list_distinct(list_filter(list_transform(alternatives, lambda x: array_to_string({B.TOK.format('x')}, ' ')), lambda x: x <> '')) AS a FROM disjunctive),
held AS (SELECT query_id, doc, len(m) + len(list_filter(a, lambda x: contains(said, ' ' || x || ' '))) AS alternatives FROM phrased, said
  WHERE len(list_filter(m, lambda x: NOT contains(said, ' ' || x || ' '))) = 0 AND len(list_filter(a, lambda x: contains(said, ' ' || x || ' '))) > 0)"""


def _matches(spark, sf_dir):
    return boolean.matching(planning.clauses(demands(spark, sf_dir)), B.tokenised(spark, sf_dir))


@query(f"WITH {A.WANTS}, {DISJUNCTIVE}, {MATCHING} SELECT query_id, count(*) AS documents, CAST(sum(alternatives) AS BIGINT) AS alternatives, min(doc) AS first, max(doc) AS last FROM held GROUP BY query_id")
def boolean_matches(spark, sf_dir):
    """How many documents satisfy `(a OR b) AND must`, with a sum over what they hold and the ends of their ids."""
    return _matches(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("alternatives").alias("alternatives"), F.min("doc").alias("first"), F.max("doc").alias("last"))


@query(f"""WITH {B.BASE}, {A.KEYWORDS}, {A.OWN}, {A.ASKED}, {DISJUNCTIVE}, {MATCHING}, {B.bm25_sql('ranked', 20).split('ranked AS (')[0].rstrip().rstrip(',')},
best AS (SELECT query_id, doc, score, alternatives, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM ranked_s JOIN held USING (query_id, doc))
SELECT query_id, doc, score, alternatives, rank FROM best WHERE rank <= 20""")
def disjunctive_topk(spark, sf_dir):
    """BM25 of the query over documents that satisfy its Boolean form."""
    found = boolean.matching_by_doc(planning.clauses(demands(spark, sf_dir)), B.tokenised(spark, sf_dir))
    best = retrieval.best(B.asked(spark, sf_dir), B.hits(spark, sf_dir), B.tokenised(spark, sf_dir), B.K, only=found)
    return best.select("query_id", "doc", "score", F.col("mark").alias("alternatives"), "rank")


# adaptive retrieval

FIRST = 10
KEYED = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
ADAPTIVE = f"""first AS (SELECT query_id, doc, rank FROM ranked WHERE rank <= {FIRST}),
want AS (SELECT w.*, list_distinct(a.terms) AS core, CASE WHEN typed THEN ['method', 'survey'] ELSE [] END AS types, CASE WHEN placed THEN ['en'] ELSE [] END AS venues, coalesce(array_to_string(k.keywords[1:12], ' '), '') AS compact FROM wants w JOIN asked a USING (query_id) LEFT JOIN keys k USING (query_id)),
page AS (SELECT query_id, {KEYED.format("title || ' ' || abstract || ' ' || venue")} AS t, year, trim(title) <> '' AND trim(abstract) <> '' AS whole FROM first JOIN papers USING (doc)),
per AS (SELECT w.query_id, count(p.t) AS candidates, count(*) FILTER (p.whole) AS whole, coalesce(list(p.t) FILTER (p.t IS NOT NULL), []) AS ts, coalesce(bool_or(p.year >= w.start_year AND coalesce(p.year <= w.end_year, true)), false) AS inside FROM want w LEFT JOIN page p USING (query_id) GROUP BY w.query_id),
fact AS (SELECT w.*, candidates, whole, inside, len(core) AS core_terms, len(list_filter(core, lambda c: len(list_filter(ts, lambda t: contains(t, {KEYED.format('c')}))) > 0)) AS core_matched,
  {', '.join(f"len(list_filter({c}, lambda c: len(list_filter(ts, lambda t: {KEYED.format('c')} <> '' AND contains(t, {KEYED.format('c')}))) > 0)) = 0 AND len({c}) > 0 AS no_{c}" for c in ('must', 'methods', 'datasets', 'types', 'venues'))},
  {' + '.join(f"CASE WHEN len({c}) > 0 THEN 1 ELSE 0 END" for c in ('must', 'methods', 'datasets', 'types', 'venues'))} + CASE WHEN start_year IS NOT NULL THEN 1 ELSE 0 END AS dims FROM want w JOIN per USING (query_id)),
lack AS (SELECT *, {' + '.join(f"CASE WHEN no_{c} THEN 1 ELSE 0 END" for c in ('must', 'methods', 'datasets', 'types', 'venues'))} + CASE WHEN start_year IS NOT NULL AND NOT inside THEN 1 ELSE 0 END AS lacking, core_terms >= 5 OR dims >= 2 AS hard FROM fact),
why AS (SELECT *, list_filter([CASE WHEN candidates = 0 THEN 'empty' WHEN candidates < 5 THEN 'few_candidates' END, CASE WHEN no_must THEN 'missing_must_have_terms' END, CASE WHEN no_methods THEN 'missing_methods' END, CASE WHEN no_datasets THEN 'missing_datasets' END,
  CASE WHEN hard AND core_terms > 0 AND core_matched / core_terms::DOUBLE < 0.6 THEN 'low_core_coverage' END, CASE WHEN hard AND dims > 0 AND 1 - lacking / dims::DOUBLE < 0.5 THEN 'low_constraint_coverage' END,
  CASE WHEN candidates > 0 AND whole / candidates::DOUBLE < 0.5 THEN 'low_metadata_coverage' END], lambda x: x IS NOT NULL) AS reasons FROM lack),
kept AS (SELECT *, {B.TOK.format('compact')} AS ct FROM why),
plan AS (SELECT *, CASE WHEN compact = '' OR len(list_intersect(core, ct)) / len(core)::DOUBLE < 0.5 THEN 'low_information_retention' WHEN {KEYED.format('text')} = {KEYED.format('compact')} THEN 'equivalent_query' WHEN len(reasons) = 0 THEN 'sufficient_results' END AS skip FROM kept)"""
ADAPTED = f"{B.BASE}, {B.PAPERS}, {B.bm25_sql('ranked')}, {A.KEYWORDS}, {A.OWN}, {A.ASKED}, {ADAPTIVE}"


def _first(spark, sf_dir):
    return materialize(B.ranked(spark, sf_dir, FIRST).select("query_id", "doc", "rank"), "first")


def _decided(spark, sf_dir, first):
    q = A.constrained(spark, sf_dir)
    found = adaptive.facts(q, first.join(B.papers(spark, sf_dir), "doc"))
    compact = F.array_join(F.slice("keywords", 1, 12), " ")
    forms = q.select("query_id", F.col("text").alias("safe"), compact.alias("compact"), T.retention(T.query_tokens(F.col("text")), T.tokens(compact)).alias("retention"))
    return found, materialize(adaptive.decisions(adaptive.sufficiency(found, FIRST), forms), "decided")


@query(f"WITH {ADAPTED} SELECT array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS sufficient, count(*) AS n, CAST(sum(core_matched) AS BIGINT) AS core_matched, CAST(sum(lacking) AS BIGINT) AS missing FROM why GROUP BY ALL")
def retrieval_sufficiency(spark, sf_dir):
    """Whether the first results of the queries suffice, over real candidates."""
    found, _ = _decided(spark, sf_dir, _first(spark, sf_dir))
    d = adaptive.sufficiency(found, FIRST)
    return d.groupBy(F.array_join("reasons", ",").alias("reasons"), "sufficient").agg(F.count(F.lit(1)).alias("n"), F.sum("core_matched").alias("core_matched"), F.sum(F.size("missing")).alias("missing"))


AGAIN = f"""again AS (SELECT query_id, CASE WHEN len(f) > 0 THEN f ELSE ct END AS terms FROM (SELECT query_id, ct, list_filter(ct, lambda x: x NOT IN ({B.sql_list(C.QUERY_STOPWORDS)})) AS f FROM plan WHERE skip IS NULL)),
{B.bm25_sql('more', FIRST).replace('FROM asked', 'FROM again')}, fresh AS (SELECT m.query_id, m.doc, row_number() OVER (PARTITION BY m.query_id ORDER BY m.rank, m.doc) AS n FROM more m ANTI JOIN first f ON f.query_id = m.query_id AND f.doc = m.doc),
have AS (SELECT query_id, max(rank) AS have FROM first GROUP BY query_id)"""


@query(f"""WITH {ADAPTED}, {AGAIN} SELECT query_id, doc, CAST(rank AS INTEGER) AS rank, 'safe' AS step FROM first
UNION ALL SELECT query_id, doc, CAST(n + coalesce(have, 0) AS INTEGER), 'compact' FROM fresh LEFT JOIN have USING (query_id) WHERE n + coalesce(have, 0) <= 15""")
def adaptive_topk(spark, sf_dir):
    """Ten results of each query; where they do not suffice, up to five more that the compact form finds."""
    first = _first(spark, sf_dir)
    _, decided = _decided(spark, sf_dir, first)

    def search(q):
        asked = materialize(q.select("query_id", T.query_tokens(F.col("text")).alias("terms")), "asked")
        docs = B.tokenised(spark, sf_dir)
        return retrieval.best(asked, materialize(retrieval.hits(asked, docs), "hits", rows=1024, mb=4), docs, FIRST)

    return adaptive.second_pass(first, decided, search, 15)


# evolution

MATCHABLE = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_+.#-]+', ' ', 'g'))"


def present_sql(term: str, text: str) -> str:
    return f"({term} <> '' AND CASE WHEN regexp_full_match({term}, '[a-z0-9+.#-]+') THEN regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape({term}) || '([^a-z0-9]|$)') ELSE contains({text}, {term}) END)"


def plain_sql(text: str, ignored) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9+.#-]*'), lambda w: rtrim(w, '.')), lambda w: w <> '' AND lower(w) NOT IN ({B.sql_list(ignored)}) AND (length(w) > 2 OR lower(w) IN ('ai', 'ml', 'cv')))"


IGNORED = (*C.EVOLUTION_STOPWORDS, *C.REQUEST_WORDS)
TYPE_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN [{B.sql_list(v)}]" for k, v in C.PAPER_TYPE_TERMS.items()) + " ELSE [x] END"
GAPS = f"""asks AS (SELECT w.* REPLACE (CASE WHEN explicit_must THEN must ELSE coalesce(list_transform(k.keywords, lambda x: lower(x)), []) END AS must), CASE WHEN typed THEN ['method', 'survey'] ELSE [] END AS types, CASE WHEN placed THEN ['en'] ELSE [] END AS venues, CASE WHEN explicit_must THEN must ELSE [] END AS required FROM wants w LEFT JOIN keys k USING (query_id)),
named AS (SELECT *, {distinct_sql(f"list_concat(list_filter(must, lambda t: NOT list_contains(list_concat(methods, datasets, types, venues), lower(t)) AND lower(t) NOT IN ({B.sql_list(IGNORED)})), {plain_sql('text', IGNORED)})")} AS topics FROM asks),
expected AS (SELECT query_id, dimension, term, pos, CASE WHEN dimension = 'type' THEN list_transform([term], lambda x: {TYPE_SQL})[1] ELSE [term] END AS aliases FROM (
  SELECT query_id, e.dimension, unnest(e.terms) AS term, generate_subscripts(e.terms, 1) AS pos FROM (SELECT query_id, unnest([{', '.join(f"{{'dimension': '{k}', 'terms': {distinct_sql(c)}}}" for k, c in (('topic', 'topics'), ('method', 'methods'), ('dataset', 'datasets'), ('must', 'required'), ('type', 'types'), ('venue', 'venues')))}]) AS e FROM named))),
relevant AS (SELECT query_id, doc, {MATCHABLE.format("array_to_string(list_filter([title, abstract, venue], lambda x: x <> ''), ' ')")} AS m, regexp_replace(lower(venue), '[^a-z0-9]+', '', 'g') AS v, year FROM judged WHERE category IN ('highly_relevant', 'partially_relevant')),
met AS (SELECT e.query_id, e.dimension, e.term, bool_or(CASE WHEN e.dimension = 'venue' THEN v <> '' AND contains(v, regexp_replace(e.term, '[^a-z0-9]+', '', 'g')) ELSE len(list_filter(aliases, lambda a: {present_sql(MATCHABLE.format('a'), 'm')})) > 0 END) AS hit FROM expected e JOIN relevant USING (query_id) GROUP BY ALL),
state AS (SELECT e.query_id, dimension, count(*) AS n, count(*) FILTER (coalesce(hit, false)) AS got, coalesce(list(term ORDER BY pos) FILTER (NOT coalesce(hit, false)), []) AS lost FROM expected e LEFT JOIN met USING (query_id, dimension, term) GROUP BY ALL),
timed AS (SELECT query_id, count(*) AS relevant, avg(CASE WHEN year >= start_year AND coalesce(year <= end_year, true) THEN 1 ELSE 0 END) AS inside FROM relevant JOIN wants USING (query_id) GROUP BY query_id),
wide AS (SELECT query_id, {', '.join(f"coalesce(max(got / n::DOUBLE) FILTER (dimension = '{k}'), 1) AS {k}_coverage, coalesce(first(lost) FILTER (dimension = '{k}'), []) AS lost_{k}" for k in evolution.DIMENSIONS)} FROM state GROUP BY query_id),
gaps AS (SELECT n.*, coalesce(relevant, 0) AS relevant, {', '.join(f'coalesce({k}_coverage, 1) AS {k}_coverage' for k in evolution.DIMENSIONS)}, {', '.join(f'coalesce(lost_{k}, []) AS missing_{k}' for k in evolution.DIMENSIONS if k != 'topic')},
  list_filter(coalesce(lost_topic, []), lambda t: t NOT IN ({B.sql_list(C.BROAD_TERMS)})) AS missing_topic, CASE WHEN start_year IS NULL THEN 1 ELSE coalesce(inside, 0) END AS temporal_coverage FROM named n LEFT JOIN wide USING (query_id) LEFT JOIN timed USING (query_id)),
needing AS (SELECT *, len(missing_method) + len(missing_dataset) + len(missing_must) + len(missing_type) + len(missing_topic) > 0 AS needs FROM gaps),
reasoned AS (SELECT *, list_filter([CASE WHEN relevant = 0 THEN 'no_relevant_initial_results' END, CASE WHEN len(missing_method) > 0 THEN 'method_gap' END, CASE WHEN len(missing_dataset) > 0 THEN 'dataset_gap' END, CASE WHEN len(missing_must) > 0 THEN 'must_have_gap' END, CASE WHEN len(missing_type) > 0 THEN 'paper_type_gap' END,
  CASE WHEN len(missing_venue) > 0 THEN 'venue_gap' END, CASE WHEN start_year IS NOT NULL AND temporal_coverage = 0 THEN 'temporal_gap' END, CASE WHEN len(missing_topic) > 0 AND len(topics) >= 2 THEN 'topic_gap' END, CASE WHEN NOT needs THEN CASE WHEN relevant > 0 THEN 'coverage_sufficient' ELSE 'no_actionable_gap' END END], lambda x: x IS NOT NULL) AS reasons FROM needing)"""
GAPPED = f"{A.JUDGE}, {GAPS}"


def _gaps(spark, sf_dir):
    j = A.judged(spark, sf_dir)
    return j, materialize(evolution.coverage_gap(A.constrained(spark, sf_dir), j), "gaps")


@query(f"""WITH {GAPPED} SELECT query_id, {', '.join(f'round({k}_coverage, 6) AS {k}_coverage' for k in evolution.DIMENSIONS)}, round(temporal_coverage, 6) AS temporal_coverage, lower(array_to_string(list_concat(missing_method, missing_dataset, missing_must, missing_topic, missing_type, missing_venue), ',')) AS missing, needs AS needs_evolution, array_to_string(reasons, ',') AS reasons FROM reasoned""")
def coverage_gaps(spark, sf_dir):
    _, g = _gaps(spark, sf_dir)
    lost = F.concat(*[f"missing_{k}" for k in ("method", "dataset", "must", "topic", "type", "venue")])
    return g.select("query_id", *[f"{k}_coverage" for k in evolution.DIMENSIONS], "temporal_coverage", F.lower(F.array_join(lost, ",")).alias("missing"), "needs_evolution", F.array_join("reasons", ",").alias("reasons"))


SEEDS = f"""eligible AS (SELECT j.query_id, j.doc, j.category, j.score, trim(j.title) <> '' AND trim(j.abstract) <> '' AS whole, list_distinct({plain_sql('j.title', C.EVOLUTION_STOPWORDS)}) AS words,
  len(list_filter(list_concat(g.topics, g.methods, g.datasets, g.required), lambda t: {present_sql(MATCHABLE.format('t'), MATCHABLE.format("array_to_string(list_filter([j.title, j.abstract, j.venue], lambda x: x <> ''), ' ')"))})) > 0 AS hit
  FROM judged j JOIN reasoned g USING (query_id) WHERE g.needs AND (j.category = 'highly_relevant' OR (j.category = 'partially_relevant' AND j.score >= {C.SEED_SCORE})) AND NOT (trim(j.title) = '' AND trim(j.abstract) = '')),
lined AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE category WHEN 'highly_relevant' THEN 0 ELSE 1 END, CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN whole THEN 0 ELSE 1 END, score DESC, doc) AS spot FROM eligible WHERE category = 'highly_relevant' OR hit),
s1 AS (SELECT query_id, doc, spot, words FROM lined WHERE spot = 1),
s2 AS (SELECT l.query_id, min(l.spot) AS spot FROM lined l JOIN s1 USING (query_id) WHERE l.spot > s1.spot AND NOT near(l.words, s1.words) GROUP BY l.query_id),
t2 AS (SELECT l.query_id, l.doc, l.spot, l.words FROM lined l JOIN s2 USING (query_id, spot)),
s3 AS (SELECT l.query_id, min(l.spot) AS spot FROM lined l JOIN s1 USING (query_id) JOIN t2 ON t2.query_id = l.query_id WHERE l.spot > t2.spot AND NOT near(l.words, s1.words) AND NOT near(l.words, t2.words) GROUP BY l.query_id),
seeds AS (SELECT query_id, 1 AS place, doc FROM s1 UNION ALL SELECT query_id, 2, doc FROM t2 UNION ALL SELECT l.query_id, 3, l.doc FROM lined l JOIN s3 USING (query_id, spot))"""
for _a in ("s1", "t2"):
    SEEDS = SEEDS.replace(f"near(l.words, {_a}.words)", f"(len(l.words) > 0 AND len({_a}.words) > 0 AND len(list_intersect(l.words, {_a}.words)) / len(list_distinct(list_concat(l.words, {_a}.words)))::DOUBLE >= 0.8)")


@query(f"WITH {GAPPED}, {SEEDS} SELECT query_id, place, doc FROM seeds")
def gap_seeds(spark, sf_dir):
    j, g = _gaps(spark, sf_dir)
    return evolution.gap_seeds(g, j).select("query_id", "place", "doc")


EVOLVED = f"""based AS (SELECT *, list_filter(topics, lambda t: t NOT IN ({B.sql_list(C.BROAD_TERMS)}))[1:3] AS base, list_concat(required, venues[1:1], CASE WHEN start_year IS NULL THEN [] WHEN end_year IS NULL THEN ['since ' || start_year] ELSE [start_year || '-' || end_year] END) AS rest FROM reasoned WHERE needs AND query_id IN (SELECT query_id FROM seeds)),
made AS (SELECT query_id, base, rest, t.dimension AS dimension, t.term AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT query_id, base, rest, ts, unnest(ts) AS t FROM (
  SELECT *, list_concat({', '.join(f"list_transform(missing_{k}, lambda x: {{'dimension': '{n}', 'term': x}})" for k, n in (('method', 'method'), ('dataset', 'dataset'), ('must', 'must_have'), ('topic', 'topic'), ('type', 'paper_type')))}) AS ts FROM based WHERE len(base) > 0))),
written AS (SELECT query_id, dimension, pos, array_to_string({distinct_sql('list_concat(base, [term], rest)')}, ' ') AS text FROM made),
fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY pos) AS n FROM written w WHERE NOT EXISTS (SELECT 1 FROM queries q WHERE q.query_id = w.query_id AND lower(trim(regexp_replace(q.text, '\\s+', ' ', 'g'))) = w.text)),
evolved AS (SELECT * FROM (SELECT query_id, dimension, text, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM fresh WHERE n = 1) WHERE place <= {C.EVOLVED_QUERIES})""".replace("SELECT query_id, base, rest, t.dimension AS dimension, t.term AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT query_id, base, rest, ts, unnest(ts) AS t FROM (", "SELECT query_id, base, rest, t.dimension AS dimension, t.term AS term, pos FROM (SELECT query_id, base, rest, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (")


def _evolved(spark, sf_dir, j, g):
    return materialize(evolution.gap_queries(g, evolution.gap_seeds(g, j), B.queries(spark, sf_dir)), "evolved")


@query(f"WITH {GAPPED}, {SEEDS}, {EVOLVED} SELECT query_id, CAST(place AS INTEGER) AS place, dimension, text FROM evolved")
def evolved_queries(spark, sf_dir):
    j, g = _gaps(spark, sf_dir)
    return _evolved(spark, sf_dir, j, g).withColumn("text", F.lower("text"))


GATE = f"""terms2 AS (SELECT query_id * 10 + place AS query_id, CASE WHEN len(f) > 0 THEN f ELSE t END AS terms FROM (SELECT query_id, place, t, list_filter(t, lambda x: x NOT IN ({B.sql_list(C.QUERY_STOPWORDS)})) AS f FROM (SELECT query_id, place, {B.TOK.format('text')} AS t FROM evolved))),
{B.bm25_sql('newer', 10).replace('FROM asked', 'FROM terms2')}, offered AS (SELECT DISTINCT query_id // 10 AS query_id, doc FROM newer),
gated AS (SELECT o.query_id, o.doc, CASE WHEN EXISTS (SELECT 1 FROM ranked r WHERE r.query_id = o.query_id AND r.doc = o.doc) THEN 'duplicate_with_initial' WHEN trim(title) = '' AND trim(abstract) = '' THEN 'missing_metadata' WHEN {{e}} > 0 THEN 'excluded_term_match'
  WHEN len(topics) > 0 AND {{t}} = 0 THEN 'no_topic_match' WHEN len(methods) + len(datasets) + len(required) > 0 AND {{s}} = 0 THEN 'no_structured_dimension_match' ELSE 'accepted' END AS reason
  FROM offered o JOIN reasoned USING (query_id) JOIN (SELECT *, {MATCHABLE.format("array_to_string(list_filter([title, abstract, venue], lambda x: x <> ''), ' ')")} AS m FROM papers) p ON p.doc = o.doc)"""
for _k, _c in (("e", "excludes"), ("t", "topics"), ("s", "list_concat(methods, datasets, required)")):
    GATE = GATE.replace("{" + _k + "}", f"len(list_filter({_c}, lambda t: {present_sql(MATCHABLE.format('t'), 'm')}))")


@query(f"WITH {GAPPED}, {SEEDS}, {EVOLVED}, {GATE} SELECT query_id, doc, reason FROM gated")
def evolved_candidates(spark, sf_dir):
    """What the evolved queries find, and what the gate lets through."""
    j, g = _gaps(spark, sf_dir)
    e = _evolved(spark, sf_dir, j, g)
    asked = materialize(e.select((F.col("query_id") * 10 + F.col("place")).alias("query_id"), T.query_tokens(F.col("text")).alias("terms")), "asked")
    docs = B.tokenised(spark, sf_dir)
    found = retrieval.best(asked, materialize(retrieval.hits(asked, docs), "hits", rows=1024, mb=4), docs, 10)
    found = found.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), "doc").distinct().join(B.papers(spark, sf_dir), "doc")
    gated = evolution.quality_gate(g, j.select("query_id", "doc"), found)
    return gated.select("query_id", "doc", F.coalesce("reason", F.lit("accepted")).alias("reason"))
