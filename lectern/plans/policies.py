"""Queries of plan policies and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.operators import planning, policies

from . import analysis as A
from . import binding as B
from .planning import DISJUNCTIVE, TASKS, distinct_sql, reliable_sql

QUERIES: dict = {}
ORACLE: dict = {}
#: Subqueries of a run with the balanced profile.
MOST = planning.profile("balanced", 20)[1]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _current(spark, sf_dir):
    q = A.constrained(spark, sf_dir)
    return q, planning.subqueries(q, MOST)


def _shown(plan):
    return plan.select("query_id", F.col("place").cast("int").alias("place"), "purpose", F.lower("text").alias("text"))


def key_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


STRUCTURED = "list_concat(methods, datasets, venues, types, tasks)"
FACTS = rf"""pw AS (SELECT query_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT query_id, list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9+.#-]*'), lambda w: rtrim(w, '.')) AS ws FROM queries)),
pl AS (SELECT query_id, list(w ORDER BY pos) AS pl FROM (SELECT query_id, w, min(pos) AS pos FROM pw WHERE w <> '' AND w NOT IN ({B.sql_list(C.PLANNER_STOPWORDS)}) AND (length(w) > 2 OR w IN ('ai', 'ml', 'cv')) GROUP BY query_id, w) GROUP BY query_id),
pfact AS (SELECT wants.*, coalesce(pl, []) AS pl, {TASKS} AS tasks, {A.padded('lower(text)')} AS pad, CASE WHEN explicit_must THEN must ELSE [] END AS required, CASE WHEN typed THEN ['method', 'survey'] ELSE [] END AS types, CASE WHEN placed THEN ['en'] ELSE [] END AS venues,
  CASE WHEN start_year IS NOT NULL THEN [concat_ws('-', start_year, end_year)] ELSE [] END AS years FROM wants LEFT JOIN pl USING (query_id)),
ptopic AS (SELECT *, {distinct_sql(f"list_concat(required, list_filter(list_concat(pl, list_filter(tasks, lambda t: regexp_matches(t, '[一-鿿]'))), lambda t: NOT list_contains({STRUCTURED}, t) AND NOT list_contains(flatten(list_transform({STRUCTURED}, lambda s: regexp_extract_all(s, '[a-z][a-z0-9+.#-]*'))), t) AND t NOT IN ({B.sql_list(C.GENERIC_PAPER_TERMS)})))")}[1:12] AS topic FROM pfact)"""
CURRENT = f"now AS (SELECT * FROM ({A.ORACLE['subqueries']}) WHERE place <= {MOST})"


def option_sql(purpose: str, rank: str, terms: str, kept: str) -> str:
    return f"SELECT query_id, {rank} AS rank, '{purpose}' AS purpose, array_to_string({distinct_sql(f'list_concat(topic[1:10], {terms}, required)')}, ' ') AS q FROM ptopic WHERE len(topic) > 0 AND {kept}"


OPTIONS = " UNION ALL ".join([
    "SELECT query_id, -100 AS rank, 'original' AS purpose, lower(text) AS q FROM ptopic",
    option_sql("facet_topic_compact", "0", "[]", f"len({distinct_sql('list_concat(topic[1:10], required)')}) >= 2"),
    *[option_sql(f"facet_{n}", f"{r} - CASE WHEN {given} THEN 10 ELSE 0 END", c, f"len({c}) > 0") for n, r, c, given in (
        ("method", 1, "methods", "true"), ("dataset", 2, "datasets", "true"), ("task", 3, "tasks", "false"), ("paper_type", 4, "types", "true"), ("venue", 5, "venues", "true"), ("temporal", 6, "years", "true"))]])


@query(f"""WITH {A.WANTS}, {FACTS}, opts AS ({OPTIONS}),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, {key_sql('q')} ORDER BY rank, purpose) AS n FROM opts),
put AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, purpose) AS place FROM once WHERE n = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, purpose, q AS text FROM put WHERE place <= 5""")
def facet_balanced_plan(spark, sf_dir):
    """The query, its topic and its topic with each facet, five at most."""
    return _shown(policies.balanced(A.constrained(spark, sf_dir), planning.profile("high_recall", 20)[1]))


def appended_sql(extra: str) -> str:
    return f"""SELECT query_id, place, purpose, text FROM now UNION ALL
SELECT query_id, CAST(last + 1 AS INTEGER) AS place, purpose, text FROM ({extra}) JOIN (SELECT query_id, count(*) AS n, max(place) AS last, list({key_sql('text')}) AS keys FROM now GROUP BY query_id) USING (query_id)
WHERE n < {min(C.PLANNED_QUERIES, MOST + 1)} AND NOT list_contains(keys, {key_sql('text')})"""


def rendered_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda t: CASE WHEN contains(t, ' ') THEN '\"' || t || '\"' ELSE t END), ' ')"


@query(f"WITH {A.WANTS}, {DISJUNCTIVE}, {CURRENT} {appended_sql(f'''SELECT query_id, 'current_plus_disjunctive_any' AS purpose, {rendered_sql('alternatives')} AS text FROM disjunctive''')}")
def disjunctive_union_plan(spark, sf_dir):
    """The current subqueries and one that asks for any reliable term."""
    return _shown(policies.with_disjunction(*_current(spark, sf_dir), MOST))


LETTERS = f"coalesce(list_sum(list_transform(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[a-z][a-z0-9+.#-]*'), lambda w: rtrim(w, '.')), lambda w: w <> '' AND w NOT IN ({B.sql_list(C.PLANNER_STOPWORDS)}) AND (length(w) > 2 OR w IN ('ai', 'ml', 'cv')))), lambda w: length(w))), 0)"


@query(f"""WITH {A.WANTS}, {FACTS}, {CURRENT},
rel AS (SELECT query_id, required, CASE WHEN len(datasets) > 0 THEN {reliable_sql('datasets', 'true')}[1:3] ELSE [] END AS a, {reliable_sql('methods', 'len(methods) > 0')}[1:3] AS b, {reliable_sql('tasks', 'false')}[1:3] AS c, {reliable_sql('topic', 'explicit_must')} AS t FROM ptopic),
letters AS (SELECT query_id, pos, t, {LETTERS} AS n FROM (SELECT query_id, generate_subscripts(t, 1) AS pos, unnest(t) AS t FROM rel)),
top AS (SELECT query_id, list(t ORDER BY pos) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos) AS r FROM letters WHERE n >= {C.FACET_LETTERS}) WHERE r <= {C.FACET_TERMS} GROUP BY query_id),
pick AS (SELECT rel.query_id, required, CASE WHEN len(a) > 0 THEN 'dataset' WHEN len(b) > 0 THEN 'method' WHEN len(c) > 0 THEN 'task' WHEN len(top.t) >= 2 THEN 'topic' END AS facet, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c ELSE top.t END AS terms FROM rel LEFT JOIN top USING (query_id)),
joint AS (SELECT query_id, facet, {distinct_sql('list_concat(required, terms)')} AS terms FROM pick WHERE facet IS NOT NULL)
{appended_sql(f'''SELECT query_id, 'facet_union_' || facet AS purpose, {rendered_sql('terms')} AS text FROM joint''')}""")
def facet_union_plan(spark, sf_dir):
    """The current subqueries and one of a facet with all demanded terms."""
    return _shown(policies.with_facet(*_current(spark, sf_dir), MOST))


BARE = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"
PLACE = r"length(regexp_extract(lower(text), '^([\s\S]*?' || CASE WHEN regexp_matches(t, '^[\p{L}\p{N}]') THEN '(?:^|[^\p{L}\p{N}_])' ELSE '' END || ')' || regexp_escape(t) || CASE WHEN regexp_matches(t, '[\p{L}\p{N}]$') THEN '(?:$|[^\p{L}\p{N}_])' ELSE '' END, 1))"
FOUND = PLACE.replace("length(regexp_extract(", "regexp_matches(").removesuffix(", 1))") + ")"


@query(rf"""WITH {A.WANTS}, {FACTS}, {CURRENT},
raw AS (SELECT query_id, text, excludes, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT query_id, text, excludes, {distinct_sql('list_concat(CASE WHEN explicit_must THEN must ELSE coalesce(keywords, []) END, topic)')} AS ts FROM ptopic LEFT JOIN keys USING (query_id))),
spot AS (SELECT query_id, i, t, {BARE.format('t')} AS k, {PLACE} AS pos, excludes FROM raw WHERE {FOUND}),
fit AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY pos, i) AS n FROM spot WHERE k <> '' AND k NOT IN ({B.sql_list(C.PLANNER_STOPWORDS)}, {B.sql_list(C.NO_CONCEPTS)}) AND NOT regexp_full_match(k, '\d+(st|nd|rd|th)?')
  AND len(list_filter(excludes, lambda e: k = e OR contains({A.padded('k')}, ' ' || e || ' ') OR contains({A.padded('e')}, ' ' || k || ' '))) = 0),
proj AS (SELECT query_id, string_agg(t, ' ' ORDER BY pos, i) AS said FROM fit WHERE n = 1 GROUP BY query_id),
can AS (SELECT query_id, last, said FROM proj JOIN (SELECT query_id, max(place) FILTER (purpose <> 'original') AS last, list({key_sql('text')}) AS keys FROM now GROUP BY query_id) USING (query_id) JOIN queries USING (query_id)
  WHERE {key_sql('said')} <> {key_sql('queries.text')} AND NOT list_contains(keys, {key_sql('said')}))
SELECT query_id, place, CASE WHEN place = last THEN 'concept_projection' ELSE purpose END AS purpose, CASE WHEN place = last THEN said ELSE text END AS text FROM now LEFT JOIN can USING (query_id)""")
def concept_plan(spark, sf_dir):
    """The current subqueries, the last derived one replaced by the query's concepts in their own order."""
    return _shown(policies.projected(*_current(spark, sf_dir), MOST))
