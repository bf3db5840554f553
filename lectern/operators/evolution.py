"""Query evolution: what the relevant results of a query do not cover, seeds among them, queries for the gaps, and a gate for
what these find. Rules only; nothing here knows the gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T

RELEVANT = ("highly_relevant", "partially_relevant")
DIMENSIONS = ("topic", "method", "dataset", "must", "type", "venue")


def matchable(text: Column) -> Column:
    """Lower case, letters, digits and `_+.#-`, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_+.#-]+", " "))


def present(term: Column, text: Column) -> Column:
    """A plain term stands in the text without letters or digits beside it; another is a part of it. Both are matchable."""
    whole = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), term, F.lit(r"\E([^a-z0-9]|$)"))
    return (term != "") & F.when(term.rlike(r"^[a-z0-9+.#-]+$"), F.rlike(text, whole)).otherwise(F.contains(text, term))


def plain_terms(text: Column, ignored=C.EVOLUTION_STOPWORDS) -> Column:
    """Latin words of three letters or more (and AI, ML, CV) that are not ignored, each spelling's first."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9+.#-]*"), F.lit(0)), lambda w: F.rtrim(w, F.lit(".")))
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*ignored) & ((F.length(w) > 2) | F.lower(w).isin("ai", "ml", "cv")))
    return T.ordered_distinct(F.transform(kept, lambda w: F.when(F.lower(w).isin(*C.UPPER_TERMS), F.upper(w)).otherwise(w)))


def demands(analysed: DataFrame) -> DataFrame:
    """Adds expected: an array of (dimension, term, aliases) of what relevant results should cover, and topics: the topic terms."""
    ignored = (*C.EVOLUTION_STOPWORDS, *C.REQUEST_WORDS)
    structural = F.transform(F.flatten(F.array("methods", "datasets", "types", "venues")), lambda t: F.lower(t))
    named = F.filter(F.col("must"), lambda t: ~F.array_contains(structural, F.lower(t)) & ~F.lower(t).isin(*ignored))
    d = analysed.withColumn("topics", T.ordered_distinct(F.concat(named, plain_terms(F.col("text"), ignored))))
    required = F.when(F.array_contains("explicit", "must"), F.col("must")).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("required", required)
    alias = F.create_map(*[x for k, v in C.PAPER_TYPE_TERMS.items() for x in (F.lit(k), T.words_of(v))])
    of = {"topic": F.col("topics"), "method": F.col("methods"), "dataset": F.col("datasets"), "must": F.col("required"), "type": F.col("types"), "venue": F.col("venues")}
    def named_as(k):
        return lambda t: F.struct(F.lit(k).alias("dimension"), t.alias("term"), (F.coalesce(F.try_element_at(alias, t), F.array(t)) if k == "type" else F.array(t)).alias("aliases"))

    return d.withColumn("expected", F.concat(*[F.transform(T.ordered_distinct(c), named_as(k)) for k, c in of.items()]))


def _paper_text(title, abstract, venue) -> Column:
    return matchable(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in (title, abstract, venue)]))


def coverage_gap(analysed: DataFrame, judged: DataFrame) -> DataFrame:
    """For every analysed query: the share of its terms of each dimension that a relevant result has (1 where none is asked), the share of
    relevant results within its years, what is missing, whether that calls for more queries, and why.

    judged: (query_id, title, abstract, venue, year, category). Broad words are no gap; a missing venue or time is named, but no query is made for it.
    """
    q = demands(analysed)
    rel = judged.where(F.col("category").isin(*RELEVANT)).select("query_id", _paper_text("title", "abstract", "venue").alias("_t"), F.regexp_replace(F.lower(F.coalesce("venue", F.lit(""))), "[^a-z0-9]+", "").alias("_v"), "year")
    key = lambda x: F.regexp_replace(F.lower(x["term"]), "[^a-z0-9]+", "")
    has = lambda x: F.when(x["dimension"] == "venue", (F.col("_v") != "") & F.contains(F.col("_v"), key(x))).otherwise(F.exists(x["aliases"], lambda a: present(matchable(a), F.col("_t"))))
    name = lambda x: F.concat(x["dimension"], F.lit(":"), F.lower(x["term"]))
    inside = (F.coalesce(F.col("year") >= F.col("years.start_year"), F.col("years.start_year").isNull()) & F.coalesce(F.col("year") <= F.col("years.end_year"), F.col("years.end_year").isNull()) & F.col("year").isNotNull())
    seen = rel.join(q.select("query_id", "expected", "years"), "query_id").select("query_id", F.transform(F.filter("expected", has), name).alias("_found"), inside.alias("_inside"))
    seen = seen.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"), F.count(F.lit(1)).alias("relevant"), F.avg(F.col("_inside").cast("int")).alias("_time"))  # of one query
    d = q.join(seen, "query_id", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>"))).withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    missing = F.filter("expected", lambda x: ~F.array_contains(F.col("_found"), name(x)))
    d = d.withColumn("_missing", missing)
    of = lambda k, c: F.transform(F.filter(c, lambda x: x["dimension"] == k), lambda x: x["term"])
    size = lambda k, c: F.size(F.filter(c, lambda x: x["dimension"] == k))
    cover = {f"{k}_coverage": F.round(F.when(size(k, "expected") > 0, 1 - size(k, "_missing") / size(k, "expected")).otherwise(1.0), 6) for k in DIMENSIONS}
    gaps = {f"missing_{k}": of(k, "_missing") for k in DIMENSIONS}
    gaps["missing_topic"] = F.filter(gaps["missing_topic"], lambda t: ~F.lower(t).isin(*C.BROAD_TERMS))
    d = d.withColumns({**cover, "temporal_coverage": F.round(F.when(F.col("years").isNull(), 1.0).otherwise(F.coalesce("_time", F.lit(0.0))), 6), **gaps})
    some = lambda k: F.size(f"missing_{k}") > 0
    needs = some("method") | some("dataset") | some("must") | some("type") | some("topic")
    reasons = F.array_compact(F.array(
        F.when(F.col("relevant") == 0, "no_relevant_initial_results"), *[F.when(some(k), f"{n}_gap") for k, n in (("method", "method"), ("dataset", "dataset"), ("must", "must_have"), ("type", "paper_type"), ("venue", "venue"))],
        F.when(F.col("years").isNotNull() & (F.col("temporal_coverage") == 0), "temporal_gap"), F.when(some("topic") & (F.size("topics") >= 2), "topic_gap"),
        F.when(~needs, F.when(F.col("relevant") > 0, "coverage_sufficient").otherwise("no_actionable_gap"))))
    return d.withColumns({"needs_evolution": needs, "reasons": reasons}).drop("_found", "_missing", "_time", "expected")


def gap_seeds(gaps: DataFrame, judged: DataFrame, most: int = C.GAP_SEEDS, least: float = C.SEED_SCORE) -> DataFrame:
    """(query_id, place, doc, title): up to `most` seeds of each query that needs evolution. Highly relevant results first, then those with a core
    term, with title and abstract, by score and doc; a partially relevant one needs a core term. One whose title nearly repeats that of a
    seed already taken (Jaccard of 0.8) is passed over, so who is taken depends on who came before: a fold in that order.

    Titles of the same words are one candidate before rows are gathered, so that a row holds no copies."""
    core = F.flatten(F.array("topics", "methods", "datasets", "required"))
    q = gaps.where("needs_evolution").select("query_id", F.transform(core, matchable).alias("_core"))
    d = judged.where((F.col("category") == "highly_relevant") | ((F.col("category") == "partially_relevant") & (F.col("score") >= least))).select("query_id", "doc", "title", "abstract", "venue", "category", "score").join(q, "query_id")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    d = d.where(~(blank("title") & blank("abstract"))).withColumn("_t", _paper_text("title", "abstract", "venue"))
    d = d.withColumn("_hit", F.exists("_core", lambda t: present(t, F.col("_t")))).where((F.col("category") == "highly_relevant") | F.col("_hit"))
    order = [F.when(F.col("category") == "highly_relevant", 0).otherwise(1), F.when(F.col("_hit"), 0).otherwise(1), F.when(~blank("title") & ~blank("abstract"), 0).otherwise(1), F.desc("score"), F.col("doc")]
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("_words", F.array_sort(F.array_distinct(plain_terms(F.col("title")))))
    first = F.row_number().over(Window.partitionBy("query_id", "_words").orderBy("_place"))
    d = d.withColumn("_n", first).where((F.col("_n") == 1) | (F.size("_words") == 0))
    rows = d.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_place", "doc", "title", "_words"))).alias("_rows"))  # distinct titles of one query's candidates
    near = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.8)
    take = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: near(y["_words"], x["_words"])), acc).otherwise(F.concat(acc, F.array(x)))
    kind = "array<struct<_place:int,doc:bigint,title:string,_words:array<string>>>"
    taken = F.aggregate("_rows", F.array().cast(kind), lambda acc, x: take(acc, x))
    return rows.select("query_id", F.posexplode(taken).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.doc", "x.title")


def gap_queries(gaps: DataFrame, seeds: DataFrame, used: DataFrame, most: int = C.EVOLVED_QUERIES) -> DataFrame:
    """(query_id, place, dimension, text): for queries with a gap and a seed, three topic terms with one missing term each, what the
    user requires, the first venue and the years; methods first, then data sets, musts, topics, types. Queries used before
    (query_id, text), or made twice, are left out."""
    base = F.slice(F.filter("topics", lambda t: ~F.lower(t).isin(*C.BROAD_TERMS)), 1, 3)
    y = F.col("years")
    when = F.when(y["start_year"].isNotNull() & y["end_year"].isNotNull(), F.concat_ws("-", y["start_year"].cast("string"), y["end_year"].cast("string"))).when(
        y["start_year"].isNotNull(), F.concat(F.lit("since "), y["start_year"].cast("string"))).when(y["end_year"].isNotNull(), F.concat(F.lit("before "), y["end_year"].cast("string")))
    rest = F.concat("required", F.slice("venues", 1, 1), F.array_compact(F.array(when)))

    def of(name):
        return lambda t: F.struct(F.lit(name).alias("dimension"), t.alias("term"))

    terms = F.concat(*[F.transform(f"missing_{k}", of(n)) for k, n in (("method", "method"), ("dataset", "dataset"), ("must", "must_have"), ("topic", "topic"), ("type", "paper_type"))])
    d = gaps.where("needs_evolution").join(seeds.select("query_id").distinct(), "query_id", "left_semi").withColumn("_base", base).where(F.size("_base") > 0)
    d = d.withColumn("_rest", rest).select("query_id", "_base", "_rest", F.posexplode(terms).alias("_at", "x"))
    d = d.select("query_id", "_at", "x.dimension", F.array_join(T.ordered_distinct(F.concat("_base", F.array("x.term"), "_rest")), " ").alias("text"))
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    d = d.withColumn("_key", key).join(used.select("query_id", key.alias("_key")).distinct(), ["query_id", "_key"], "left_anti")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("_at"))).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_at"))
    return d.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "dimension", "text")


def quality_gate(gaps: DataFrame, initial: DataFrame, evolved: DataFrame) -> DataFrame:
    """evolved (query_id, doc, title, abstract, venue), each once, with reason: null if it is accepted, else the first of: found before, no text, an
    excluded term, no topic term, none of the methods, data sets and musts that the query asks for."""
    q = gaps.select("query_id", F.transform("topics", matchable).alias("_topics"), F.transform(F.flatten(F.array("methods", "datasets", "required")), matchable).alias("_asked"), F.transform("excludes", matchable).alias("_excludes"))
    d = evolved.dropDuplicates(["query_id", "doc"]).join(initial.select("query_id", "doc", F.lit(True).alias("_before")).distinct(), ["query_id", "doc"], "left").join(q, "query_id")
    d = d.withColumn("_t", _paper_text("title", "abstract", "venue"))
    any_ = lambda c: F.exists(c, lambda t: present(t, F.col("_t")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (F.when(F.col("_before"), "duplicate_with_initial").when(blank("title") & blank("abstract"), "missing_metadata").when(any_("_excludes"), "excluded_term_match")
              .when((F.size("_topics") > 0) & ~any_("_topics"), "no_topic_match").when((F.size("_asked") > 0) & ~any_("_asked"), "no_structured_dimension_match"))
    return d.select("query_id", "doc", reason.alias("reason"))
