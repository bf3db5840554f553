"""Plan policies: what is searched for a query besides the query itself, by facets, by a disjunction or by its concepts.

Each gives (query_id, place, purpose, text) from analysed queries and, where it builds on them, their current subqueries of
the same columns. All are projections of a query's own row and joins by its id; nothing depends on other queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T

from . import planning
from .evolution import plain_terms


def key(text: Column) -> Column:
    """Lower case, single blanks: two texts of one key are one search."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def facts(analysed: DataFrame) -> DataFrame:
    """Adds tasks, required (terms that the user demands) and topic: required terms and those of the text's that name no other facet, twelve at most. A null
    text is an empty one."""
    none = F.array().cast("array<string>")
    tasks = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t)), F.lit(t)) for t in C.TASK_TERMS]))
    d = analysed.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"tasks": tasks, "required": F.when(F.array_contains("explicit", "must"), F.col("must")).otherwise(none)})
    named = F.transform(F.flatten(F.array("methods", "datasets", "venues", "types", "tasks")), lambda t: F.lower(t))
    single = F.flatten(F.transform(named, lambda t: F.regexp_extract_all(t, F.lit(r"[a-z][a-z0-9+.#-]*"), F.lit(0))))
    d = d.withColumn("named", F.concat(named, single))
    own = F.concat(plain_terms(F.col("text"), C.PLANNER_STOPWORDS), F.filter("tasks", lambda t: t.rlike(r"[一-鿿]")))
    free = F.filter(own, lambda t: ~F.array_contains("named", F.lower(t)) & ~F.lower(t).isin(*C.GENERIC_PAPER_TERMS))
    return d.withColumn("topic", F.slice(T.ordered_distinct(F.concat("required", free)), 1, 12)).drop("named")


def balanced(analysed: DataFrame, most: int) -> DataFrame:
    """The query, its topic, and its topic with each facet: demanded facets first, then by priority. A text that stands already is passed over
    and takes no place; `most` of a query, which the query itself always leads."""
    given = lambda c: F.array_contains("explicit", c)
    years = F.when(F.col("years").isNotNull(), F.array(F.concat_ws("-", F.col("years.start_year").cast("string"), F.col("years.end_year").cast("string")))).otherwise(F.array().cast("array<string>"))
    of = {"method": (1, F.col("methods"), given("methods")), "dataset": (2, F.col("datasets"), given("datasets")), "task": (3, F.col("tasks"), F.lit(False)),
          "paper_type": (4, F.col("types"), given("types")), "venue": (5, F.col("venues"), given("venues")), "temporal": (6, years, given("years"))}

    def option(rank, purpose, text, kept):
        return F.when(kept, F.struct(F.lit(rank).cast("int").alias("rank") if isinstance(rank, int) else rank.cast("int").alias("rank"), F.lit(purpose).alias("purpose"), key(text).alias("key"), text.alias("text")))

    base = F.slice("topic", 1, 10)
    compact = T.ordered_distinct(F.concat(base, "required"))
    some = F.size(base) > 0
    rows = [option(-100, "original", F.col("text"), F.lit(True)), option(0, "facet_topic_compact", F.array_join(compact, " "), some & (F.size(compact) >= 2))]
    for name, (rank, terms, asked) in of.items():
        text = F.array_join(T.ordered_distinct(F.concat(base, terms, "required")), " ")
        rows.append(option(F.lit(rank) - F.when(asked, 10).otherwise(0), f"facet_{name}", text, some & (F.size(terms) > 0)))
    d = facts(analysed).select("query_id", F.array_sort(F.array_compact(F.array(*rows))).alias("x"))
    d = d.withColumn("seen", F.transform("x", lambda r: r["key"]))
    kept = F.slice(F.filter("x", lambda r, i: F.array_position("seen", r["key"]) == i + 1), 1, most)
    return d.select("query_id", F.posexplode(kept).alias("place", "r")).select("query_id", (F.col("place") + 1).alias("place"), "r.purpose", "r.text")


def rendered(terms: Column) -> Column:
    """Terms in a row, those of several words in quotation marks."""
    plain = F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, '"', " "), r"\s+", " "))), lambda t: t != "")
    return F.array_join(F.transform(plain, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " ")


def appended(current: DataFrame, extra: DataFrame, most: int) -> DataFrame:
    """The current subqueries, all as they are, and the extra one of a query (query_id, purpose, text) behind them, if a place is left of
    `most` and one more, five at most, and no current text has its key."""
    have = current.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.collect_list(key(F.col("text"))).alias("keys"))  # of one query
    limit = min(C.PLANNED_QUERIES, max(1, most) + 1)
    more = extra.join(have, "query_id").where((F.col("n") < limit) & ~F.array_contains("keys", key(F.col("text"))))
    return current.select("query_id", "place", "purpose", "text").unionByName(more.select("query_id", (F.col("last") + 1).cast("int").alias("place"), "purpose", "text"))


def with_disjunction(analysed: DataFrame, current: DataFrame, most: int) -> DataFrame:
    """The current subqueries and a search for any of the query's reliable terms, where there are enough of them."""
    any_ = planning.disjunctive(analysed).select("query_id", F.lit("current_plus_disjunctive_any").alias("purpose"), rendered(F.col("alternatives")).alias("text"))
    return appended(current, any_, most)


def with_facet(analysed: DataFrame, current: DataFrame, most: int) -> DataFrame:
    """The current subqueries and a search for one facet with all demanded terms: demanded data sets, else methods, else tasks, else the two or three topic
    terms of most letters."""
    explicit = lambda c: F.array_contains("explicit", c)
    d = facts(analysed)
    short = lambda c: F.slice(c, 1, C.FACET_TERMS)
    d = d.withColumns({"a": F.when(explicit("datasets"), short(planning._reliable(F.col("datasets"), explicit("datasets")))), "b": short(planning._reliable(F.col("methods"), explicit("methods"))),
                       "c": short(planning._reliable(F.col("tasks"), F.lit(False))), "t": planning._reliable(F.col("topic"), explicit("must"))})
    weighed = F.transform("t", lambda t, i: F.struct((-F.aggregate(plain_terms(t, C.PLANNER_STOPWORDS), F.lit(0), lambda n, w: n + F.length(w))).alias("n"), i.alias("i"), t.alias("term")))
    first = F.slice(F.array_sort(F.filter(weighed, lambda w: w["n"] <= -C.FACET_LETTERS)), 1, C.FACET_TERMS)
    d = d.withColumn("t", F.transform(F.array_sort(F.transform(first, lambda w: F.struct(w["i"].alias("i"), w["term"].alias("term")))), lambda w: w["term"]))
    facet = F.when(F.size("a") > 0, "dataset").when(F.size("b") > 0, "method").when(F.size("c") > 0, "task").when(F.size("t") >= 2, "topic")
    terms = F.when(F.size("a") > 0, F.col("a")).when(F.size("b") > 0, F.col("b")).when(F.size("c") > 0, F.col("c")).otherwise(F.col("t"))
    one = d.withColumn("facet", facet).where("facet IS NOT NULL").select("query_id", F.concat(F.lit("facet_union_"), "facet").alias("purpose"), rendered(T.ordered_distinct(F.concat("required", terms))).alias("text"))
    return appended(current, one, most)


def _verbatim(term: Column) -> Column:
    """A pattern of the term in any case, blanks of any width, and no letter, digit or `_` beside one that it begins or ends with."""
    quoted = F.replace(F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E\\s+\\Q"))
    before = F.when(term.rlike(r"^[\p{L}\p{N}]"), F.lit(r"(?<!\w)")).otherwise(F.lit(""))
    after = F.when(term.rlike(r"[\p{L}\p{N}]$"), F.lit(r"(?!\w)")).otherwise(F.lit(""))
    return F.concat(F.lit("(?iuU)"), before, F.lit("\\Q"), quoted, F.lit("\\E"), after)


def concepts(analysed: DataFrame) -> DataFrame:
    """(query_id, concepts): demanded and topic terms as the query spells them, in the order in which it names them: without words that name no
    concept, ordinals, and what the query excludes."""
    bare = lambda c: F.regexp_replace(key(c), r"(?U)^\W+|\W+$", "")
    d = facts(analysed)
    raw = T.ordered_distinct(F.transform(F.concat("must", "topic"), lambda t: F.regexp_replace(t, r"\s+", " ")))
    at = F.transform(raw, lambda t, i: F.struct(F.regexp_instr(F.col("text"), _verbatim(t)).alias("pos"), i.alias("i"), bare(t).alias("key"), F.regexp_substr(F.col("text"), _verbatim(t)).alias("said")))
    d = d.withColumn("out", F.transform("excludes", lambda e: F.lower(e))).select("query_id", "out", F.array_sort(F.filter(at, lambda x: x["pos"] > 0)).alias("x"))
    against = lambda k: F.exists("out", lambda e: (k == e) | T.contains_term(k, e) | T.contains_term(e, k))
    kept = F.filter("x", lambda x: (x["key"] != "") & ~x["key"].isin(*C.PLANNER_STOPWORDS, *C.NO_CONCEPTS) & ~x["key"].rlike(r"^\d+(st|nd|rd|th)?$") & ~against(x["key"]))
    d = d.select("query_id", kept.alias("x")).withColumn("keys", F.transform("x", lambda x: bare(x["said"])))
    return d.select("query_id", F.transform(F.filter("x", lambda x, i: F.array_position("keys", bare(x["said"])) == i + 1), lambda x: x["said"]).alias("concepts"))


def projected(analysed: DataFrame, current: DataFrame, most: int) -> DataFrame:
    """The first `most` current subqueries, the last derived one replaced by the query's concepts, unless a text has their key or there are none."""
    c = current.where(F.col("place") <= most)
    have = c.groupBy("query_id").agg(F.max(F.when(F.col("purpose") != "original", F.col("place"))).alias("last"), F.collect_list(key(F.col("text"))).alias("keys"))  # of one query
    p = concepts(analysed).join(analysed.select("query_id", key(F.col("text")).alias("asked")), "query_id").withColumn("said", F.array_join("concepts", " "))
    p = p.join(have, "query_id").where((F.col("said") != "") & (key(F.col("said")) != F.col("asked")) & ~F.array_contains("keys", key(F.col("said")))).select("query_id", "last", "said")
    d = c.join(p, "query_id", "left")
    here = F.coalesce(F.col("place") == F.col("last"), F.lit(False))
    return d.select("query_id", "place", F.when(here, F.lit("concept_projection")).otherwise(F.col("purpose")).alias("purpose"), F.when(here, F.col("said")).otherwise(F.col("text")).alias("text"))
