"""Adaptive retrieval: a second, compact query for those queries whose first results do not suffice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Least candidates, their least share of the limit, least shares of core terms, constraints and metadata, and what makes a query complex.
LEAST, SHARE, CORE, CONSTRAINTS, METADATA, CORE_TERMS, DIMENSIONS = 8, 0.5, 0.6, 0.5, 0.5, 5, 2
#: The least share of a query's terms that a compact form keeps.
RETENTION = 0.5


def _key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def facts(analysed: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, candidates, core_terms, core_matched, dimensions, missing, with_metadata, succeeded) of every analysed query, over its candidates
    found (query_id, doc, title, abstract, year). A term counts if it is a part of some candidate's text, a dimension if any of its
    terms does; years if some candidate lies in them."""
    dims = {"must_have_terms": "must", "methods": "methods", "datasets": "datasets", "paper_types": "types", "venues": "venues"}
    q = analysed.select("query_id", "years", F.array_distinct(T.query_tokens(F.col("text"))).alias("_core"), *[F.transform(c, _key).alias(f"_{c}") for c in dims.values()])
    text = _key(F.concat_ws(" ", "title", "abstract", "venue"))
    c = found.dropDuplicates(["query_id", "doc"]).select("query_id", text.alias("_t"), "year", ((F.trim("title") != "") & (F.trim("abstract") != "")).alias("_whole")).join(q, "query_id")
    held = lambda terms: F.filter(terms, lambda t: (t != "") & F.contains(F.col("_t"), t))
    inside = F.coalesce(F.col("year") >= F.col("years.start_year"), F.col("years.start_year").isNull()) & F.coalesce(F.col("year") <= F.col("years.end_year"), F.col("years.end_year").isNull()) & F.col("year").isNotNull()
    s = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("_whole"), 1)).alias("with_metadata"), F.size(F.array_distinct(F.flatten(F.collect_list(held("_core"))))).alias("core_matched"),  # of one query's candidates
                                  F.max(inside).alias("_inside"), *[F.max(F.size(held(f"_{v}")) > 0).alias(f"_has_{v}") for v in dims.values()])
    d = q.join(s, "query_id", "left").fillna(0, ["candidates", "with_metadata", "core_matched"])
    lost = [F.when((F.size(f"_{v}") > 0) & ~F.coalesce(f"_has_{v}", F.lit(False)), F.lit(k)) for k, v in dims.items()] + [F.when(F.col("years").isNotNull() & ~F.coalesce("_inside", F.lit(False)), "time_range")]
    count = sum((F.when(F.size(f"_{v}") > 0, 1).otherwise(0) for v in dims.values()), F.when(F.col("years").isNotNull(), 1).otherwise(0))
    return d.select("query_id", "candidates", F.size("_core").alias("core_terms"), "core_matched", count.alias("dimensions"), F.array_compact(F.array(*lost)).alias("missing"), "with_metadata", F.lit(True).alias("succeeded"))


def sufficiency(found: DataFrame, limit: int) -> DataFrame:
    """facts with reasons, in order, why a first search does not suffice, and sufficient where there are none. Coverage counts only for queries of
    five core terms or two dimensions."""
    need = min(LEAST, max(1, round(limit * SHARE)))
    n = F.col("candidates")
    hard = (F.col("core_terms") >= CORE_TERMS) | (F.col("dimensions") >= DIMENSIONS)
    core = F.when(F.col("core_terms") > 0, F.col("core_matched") / F.col("core_terms")).otherwise(1.0)
    kept = F.when(F.col("dimensions") > 0, 1 - F.size("missing") / F.col("dimensions")).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(~F.col("succeeded"), "failed"), F.when(n == 0, "empty").when(n < need, "few_candidates"), *[F.when(F.array_contains("missing", m), f"missing_{m}") for m in ("must_have_terms", "methods", "datasets")],
        F.when(hard & (core < CORE), "low_core_coverage"), F.when(hard & (kept < CONSTRAINTS), "low_constraint_coverage"), F.when((n > 0) & (F.col("with_metadata") / n < METADATA), "low_metadata_coverage")))
    return found.withColumn("reasons", reasons).withColumn("sufficient", F.size("reasons") == 0)


def decisions(judged: DataFrame, queries: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """(query_id, compact, skip, reasons): why the compact query (query_id, safe, compact, retention) is not run, null where it is: it keeps too little,
    says the same, the source failed, the budget (spent: query_id) is used up, or the first results suffice."""
    d = queries.join(judged.select("query_id", "sufficient", "reasons", "succeeded"), "query_id")
    over = F.lit(False)
    if spent is not None:
        d = d.join(spent.select("query_id", F.lit(True).alias("_over")).distinct(), "query_id", "left")
        over = F.coalesce("_over", F.lit(False))
    skip = (F.when((F.trim("compact") == "") | (F.col("retention") < RETENTION), "low_information_retention").when(_key(F.col("safe")) == _key(F.col("compact")), "equivalent_query")
            .when(~F.col("succeeded"), "source_failed").when(over, "budget_exhausted").when(F.col("sufficient"), "sufficient_results"))
    return d.select("query_id", "compact", skip.alias("skip"), "reasons")


def second_pass(first: DataFrame, decided: DataFrame, search: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """(query_id, doc, rank, step): first results (query_id, doc, rank) and, for queries that run their compact form, what only that finds, after them and up
    to `most` results. search gets (query_id, text) of just these queries, so nothing else is looked up again."""
    again = decided.where("skip is null").select("query_id", F.col("compact").alias("text"))
    fresh = search(again).select("query_id", "doc", F.col("rank").alias("_rank")).join(first.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    have = first.groupBy("query_id").agg(F.max("rank").alias("_have"))
    fresh = fresh.join(have, "query_id", "left").withColumn("rank", F.coalesce("_have", F.lit(0)) + F.row_number().over(Window.partitionBy("query_id").orderBy("_rank", "doc")))
    return first.select("query_id", "doc", F.col("rank").cast("int").alias("rank"), F.lit("safe").alias("step")).unionByName(fresh.where(F.col("rank") <= most).select("query_id", "doc", F.col("rank").cast("int").alias("rank"), F.lit("compact").alias("step")))
