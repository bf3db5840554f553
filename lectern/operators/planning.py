"""Query planning: facets, subqueries, source adaptation, relaxation, all as projections and explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T

#: Priority of facets; those that a query requires come 10 earlier.
FACETS = {"method": 1, "dataset": 2, "type": 4, "venue": 5, "temporal": 6}
#: Fixed values: (limit for a source, subqueries) of run profiles, by top_k.
PROFILES = {"fast": (5, 10, 1, 2), "balanced": (10, 20, 1, 3), "high_recall": (30, 50, 2, 5), "evaluation": (10, 20, 1, 3)}


def profile(name: str, top_k: int) -> tuple[int, int]:
    least, most, factor, subqueries = PROFILES.get(name, PROFILES["balanced"])
    return max(least, min(most, factor * top_k)), subqueries


def sources(domain: Column) -> Column:
    a = lambda *v: F.array(*map(F.lit, v))
    return F.when(domain == "biomedical", a("pubmed", "openalex")).when(domain.isin("computer_science", "machine_learning"), a("arxiv", "openalex")).otherwise(a("openalex", "arxiv"))


def subqueries(analysed: DataFrame, most: int) -> DataFrame:
    """(query_id, place, purpose, text): the query, its keywords, keywords with methods, with data sets, with venues; each
    text once, `most` of a query."""
    words = F.array_join("keywords", " ")
    options = F.array(
        F.struct(F.lit("original").alias("purpose"), F.col("text").alias("q")), F.struct(F.lit("keywords").alias("purpose"), words.alias("q")),
        *[F.struct(F.lit(f).alias("purpose"), F.when(F.size(f + "s") > 0, F.concat_ws(" ", words, F.array_join(f + "s", " "))).alias("q")) for f in ("method", "dataset", "venue")])
    d = analysed.select("query_id", F.posexplode(options).alias("place", "x")).select("query_id", "place", "x.*").where(F.trim("q") != "")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.lower("q")).orderBy("place"))).where("n = 1")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return d.where(F.col("n") <= most).select("query_id", F.col("n").alias("place"), "purpose", F.col("q").alias("text"))


def facets(analysed: DataFrame) -> DataFrame:
    """(query_id, facet, priority, terms): what a query asks for, most reliable first."""
    types = F.col("types")
    years = F.when(F.col("years").isNotNull(), F.array(F.concat_ws("-", F.col("years.start_year").cast("string"), F.col("years.end_year").cast("string")))).otherwise(F.array().cast("array<string>"))
    terms = {"method": F.col("methods"), "dataset": F.col("datasets"), "type": types, "venue": F.col("venues"), "temporal": years}
    d = analysed.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.lit(FACETS[k]).alias("priority"), v.alias("terms")) for k, v in terms.items()])).alias("x"))
    return d.select("query_id", "x.*").where(F.size("terms") > 0)


def adapted(analysed: DataFrame, limit: int = 200) -> DataFrame:
    """(query_id, source, variant, text, retention): for each source a safe original, cut at a word, and a compact
    form of keywords; the compact one only if it keeps half of the query's terms."""
    safe = T.cut_at_word(F.trim(F.regexp_replace(F.regexp_replace("text", r'[+\-&|!(){}\[\]^"~*?:\\/]+', " "), r"\s+", " ")), limit)
    compact = F.array_join(F.slice("keywords", 1, 12), " ")
    kept = T.retention(T.query_tokens(F.col("text")), T.tokens(compact))
    d = analysed.select("query_id", "domain", safe.alias("safe"), compact.alias("compact"), F.round(kept, 6).alias("kept"))
    d = d.select("query_id", F.explode(sources(F.col("domain"))).alias("source"), F.array(
        F.struct(F.lit("safe_original").alias("variant"), F.col("safe").alias("text"), F.lit(1.0).alias("retention")),
        F.struct(F.lit("compact").alias("variant"), F.col("compact").alias("text"), F.col("kept").alias("retention"))).alias("v"))
    d = d.select("query_id", "source", F.explode("v").alias("v")).select("query_id", "source", "v.*")
    return d.where((F.col("text") != "") & ((F.col("variant") == "safe_original") | (F.col("retention") >= 0.5)))


def relaxed(analysed: DataFrame) -> DataFrame:
    """(query_id, step, text): the query, its topic, and the topic with its most reliable facet, near repeats (Jaccard of
    0.8) of an earlier step left out."""
    topic = F.slice("keywords", 1, 10)
    best = F.min_by("terms", "priority").alias("best")
    f = facets(analysed).groupBy("query_id").agg(best)
    d = analysed.join(f, "query_id", "left").withColumn("topic", topic)
    rows = F.array(F.struct(F.lit(0).alias("step"), F.col("text").alias("q")), F.struct(F.lit(1).alias("step"), F.array_join("topic", " ").alias("q")),
                   F.struct(F.lit(2).alias("step"), F.when(F.col("best").isNotNull(), F.concat_ws(" ", F.array_join("topic", " "), F.array_join("best", " "))).alias("q")))
    d = d.select("query_id", F.filter(rows, lambda r: F.coalesce(F.trim(r["q"]), F.lit("")) != "").alias("rows"))
    far = lambda r: ~F.exists("rows", lambda o: (o["step"] < r["step"]) & (T.jaccard(T.tokens(o["q"]), T.tokens(r["q"]), 1.0) >= 0.8))
    return d.select("query_id", F.explode(F.filter("rows", far)).alias("r")).select("query_id", "r.step", F.col("r.q").alias("text"))


def new_queries(evolved: DataFrame, used: DataFrame) -> DataFrame:
    """Evolved queries (query_id, text) whose normalised text has not been used for the query."""
    key = F.array_join(T.tokens(F.col("text")), " ")
    return evolved.withColumn("key", key).join(used.select("query_id", key.alias("key")).distinct(), ["query_id", "key"], "left_anti").dropDuplicates(["query_id", "key"]).drop("key")


def coverage(analysed: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, terms, covered, missing): which keywords stand in any found text (query_id, text)."""
    seen = found.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).distinct()
    asked = analysed.select("query_id", F.explode("keywords").alias("term")).withColumn("w", F.lower("term"))
    j = asked.join(seen.withColumn("hit", F.lit(1)), ["query_id", "w"], "left")
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"), F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("term")))).alias("missing"))  # of one query


def _reliable(terms: Column, given: Column) -> Column:
    """Terms that a query may be built of: not required ones, not names of paper types, and, if inferred, in the text itself."""
    weak = T.words_of(C.UNRELIABLE_FACET_TERMS)
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_+.#-]+"), F.lit(0))
    low, text = F.transform("must", lambda m: F.lower(m)), F.lower("text")
    return T.ordered_distinct(F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: (F.length(t) <= 80) & ~(F.array_contains("explicit", "must") & F.array_contains(low, F.lower(t)))
                                       & ~F.lower(t).isin(*C.GENERIC_PAPER_TERMS) & (F.size(F.array_except(words(t), weak)) > 0) & (given | T.contains_term(text, F.lower(t)))))


def disjunctive(analysed: DataFrame) -> DataFrame:
    """(query_id, alternatives, musts): for queries with enough reliable terms, eight alternatives at most, dealt out by topic, method,
    data set and task in turn, and the musts that the user has set, which stay required."""
    tasks = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t)), F.lit(t)) for t in C.TASK_TERMS]))
    explicit = lambda x: F.array_contains("explicit", x)
    structured = F.transform(F.flatten(F.array("methods", "datasets", "venues", "types", tasks)), lambda t: F.lower(t))
    single = F.flatten(F.transform(structured, lambda t: F.regexp_extract_all(t, F.lit(r"[a-z][a-z0-9+.#-]*"), F.lit(0))))
    topic = F.filter(F.col("own_terms"), lambda t: ~F.array_contains(structured, F.lower(t)) & ~F.array_contains(single, F.lower(t)) & ~F.lower(t).isin(*C.GENERIC_PAPER_TERMS))
    no = F.lit(False)
    d = analysed.select("query_id", F.when(explicit("must"), F.col("must")).otherwise(F.array().cast("array<string>")).alias("musts"), _reliable(F.slice(topic, 1, 12), no).alias("a"),
                        _reliable(F.col("methods"), explicit("methods")).alias("b"), _reliable(F.col("datasets"), explicit("datasets")).alias("c"), _reliable(tasks, no).alias("d"))
    turns = F.flatten(F.transform(F.arrays_zip("a", "b", "c", "d"), lambda x: F.array(x["a"], x["b"], x["c"], x["d"])))
    d = d.select("query_id", "musts", F.slice(T.ordered_distinct(F.array_compact(turns)), 1, C.DISJUNCTIVE_TERMS).alias("alternatives"))
    return d.where(F.size("alternatives") >= C.DISJUNCTIVE_LEAST)


def clauses(disjunctive: DataFrame) -> DataFrame:
    """(query_id, clause, alternative): the alternatives as one clause, and a clause for each must."""
    every = F.concat(F.transform("alternatives", lambda a: F.struct(F.lit(0).alias("clause"), a.alias("alternative"))),
                     F.transform("musts", lambda m, i: F.struct((i + 1).alias("clause"), m.alias("alternative"))))
    return disjunctive.select("query_id", F.explode(every).alias("x")).select("query_id", "x.*")
