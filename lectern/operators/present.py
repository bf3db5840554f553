"""What an answer shows of a ranking: evidence and the rows that cite it, findings, coverage, themes and groups of methods.

A ranking holds the rows of its queries, so all that is gathered here is bounded by its depth; evidence is made in the row of a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T

from .judgement import lowered

NO_TEXT = "array<string>"


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(text), r"([.!?。！？])\s+", "$1\x01"), "\x01")


def evidence(candidates: DataFrame) -> DataFrame:
    """candidates (an analysed query and a paper, as for a judgement) plus matched_terms and evidence, an array of (source, text).

    Terms in the order of the query's own words, musts, methods, data sets, words of demanded paper types (which count as the type), then of the domain. A term
    in the title shows the title, one that only the abstract has shows its first sentence there. A venue and a year that the query asks for follow.
    What repeats is shown once; nulls are empty texts and show nothing.
    """
    none = F.array().cast(NO_TEXT)
    d = candidates.withColumns({x: none for x in ("must", "methods", "datasets", "types", "venues") if x not in candidates.columns})
    d = d.withColumns({"_title": F.coalesce("title", F.lit("")), "_abstract": F.coalesce("abstract", F.lit(""))})
    domain = none
    for name, words in C.DOMAIN_TERMS.items():
        domain = F.when(F.col("domain") == name, T.words_of(words)).otherwise(domain)
    own = F.col("own_terms") if "own_terms" in d.columns else T.judgement_terms(F.col("text"))
    topic = F.array_distinct(F.concat(*[lowered(c) for c in (own, F.col("must"), F.col("methods"), F.col("datasets"))]))
    pair = lambda label, term: F.struct(label.alias("label"), term.alias("term"))
    typed = [F.when(F.array_contains("types", k), F.array(*[pair(F.lit(k), F.lit(w)) for w in words])).otherwise(F.array().cast("array<struct<label:string,term:string>>")) for k, words in C.PAPER_TYPE_TERMS.items()]
    d = d.withColumn("_asked", F.concat(F.transform(topic, lambda w: pair(w, w)), *typed, F.transform(domain, lambda w: pair(w, w))))
    d = d.withColumn("_terms", F.array_distinct(F.transform("_asked", lambda x: x["term"])))
    d = d.withColumn("_in_title", T.contained(F.col("_terms"), F.lower("_title")))
    d = d.withColumn("_in_abstract", T.contained(F.array_except("_terms", "_in_title"), F.lower("_abstract")))
    d = d.withColumn("_found", F.filter("_asked", lambda x: F.array_contains("_in_title", x["term"]) | F.array_contains("_in_abstract", x["term"])))
    item = lambda source, text: F.struct(F.lit(source).alias("source"), text.alias("text"))
    shown = T.let(_sentences(F.col("_abstract")), lambda s: F.transform("_found", lambda x: F.when(F.array_contains("_in_title", x["term"]), item("title", T.short_text(F.col("_title")))).otherwise(
        item("abstract", T.short_text(F.coalesce(F.get(F.filter(s, lambda p: F.contains(F.lower(p), x["term"])), F.lit(0)), F.col("_abstract")))))))
    venue = T.venue_key(F.coalesce("venue", F.lit("")))
    rest = F.array_compact(F.array(F.when((venue != "") & F.exists("venues", lambda v: F.contains(venue, T.venue_key(v))), item("venue", F.col("venue"))),
                                   F.when(F.col("years").isNotNull() & F.col("year").isNotNull(), item("metadata", F.concat(F.lit("year="), F.col("year").cast("string"))))))
    d = d.withColumns({"matched_terms": F.array_distinct(F.transform("_found", lambda x: x["label"])), "evidence": F.array_distinct(F.concat(shown, rest))})
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def valid(items: Column) -> Column:
    """Evidence from a known source with a text."""
    return F.filter(items, lambda e: e["source"].isin(*C.EVIDENCE_SOURCES) & (F.trim(F.coalesce(e["text"], F.lit(""))) != ""))


def evidence_rows(ranked: DataFrame, papers: int = C.CITED_PAPERS, rows: int = C.EVIDENCE_ROWS, chars: int = C.EVIDENCE_LENGTH) -> DataFrame:
    """(query_id, rank, doc, title, venue, final, terms, row, row_id, citation_key, source, text, claim): the first `rows` pieces of valid evidence of the first
    `papers` papers of a query that have any; these limits are the feature. ranked has rank, category, title, venue, final, matched_terms, evidence;
    a rank stands once in a query. Papers of categories that are never cited take no place."""
    d = ranked.where(~F.coalesce(F.col("category"), F.lit("")).isin(*C.NOT_CITED)).withColumn("_valid", valid(F.coalesce("evidence", F.array().cast("array<struct<source:string,text:string>>")))).where(F.size("_valid") > 0)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= papers)
    key = F.concat(F.lit("R"), F.col("rank").cast("string"))
    d = d.withColumn("terms", F.coalesce("matched_terms", F.array().cast(NO_TEXT))).select("*", F.posexplode(F.slice("_valid", 1, rows)).alias("_i", "_e"))
    text = T.clip(F.trim(F.regexp_replace("_e.text", r"\s+", " ")), chars)
    about = F.when(F.size("terms") > 0, F.concat(F.lit("related to "), F.array_join(F.slice("terms", 1, 3), ", "))).otherwise("relevant to the query")
    row = (F.col("_i") + 1).cast("int")
    return d.select("query_id", "rank", "doc", "title", "venue", "final", "terms", row.alias("row"), F.concat(key, F.lit("-E"), row.cast("string")).alias("row_id"), key.alias("citation_key"), F.col("_e.source").alias("source"), text.alias("text"),
                    F.concat(F.coalesce("title", F.lit("")), F.lit(" has "), F.col("_e.source"), F.lit(" evidence "), about, F.lit(".")).alias("claim"))


def findings(rows: DataFrame, most: int = C.FINDINGS) -> DataFrame:
    """(query_id, place, citation_key, row_id, confidence, text): the first row of each citation, `most` of a query."""
    first = rows.where(F.col("row") == 1).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most)
    known = F.coalesce("venue", F.lit("")) != ""
    topic = F.when(F.size("terms") > 0, F.array_join(F.slice("terms", 1, 3), ", ")).when(known, F.concat(F.lit("evidence from "), F.col("venue"))).otherwise("the search query")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" provides "), F.col("source"), F.lit(" evidence for "), topic, F.lit(" ["), F.col("citation_key"), F.lit("]."))
    return first.select("query_id", "place", "citation_key", "row_id", F.col("final").alias("confidence"), text.alias("text"))


def coverage(queries: DataFrame, ranked: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, ranked, cited, evidence_rows, cited_rows, unsupported, ratio) of every query: papers with evidence rows out of those ranked, rows of papers
    that a finding cites, and pieces of evidence left out as not valid."""
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("ranked"), F.sum(F.when(F.col("category").isin(*C.NOT_CITED) | F.col("evidence").isNull(), 0).otherwise(F.size("evidence") - F.size(valid(F.col("evidence"))))).alias("unsupported"))
    cited = rows.join(found.select("query_id", "citation_key", F.lit(True).alias("in_finding")), ["query_id", "citation_key"], "left")
    c = cited.groupBy("query_id").agg(F.count(F.when(F.col("row") == 1, 1)).alias("cited"), F.count(F.lit(1)).alias("evidence_rows"), F.count("in_finding").alias("cited_rows"))
    d = queries.select("query_id").distinct().join(n, "query_id", "left").join(c, "query_id", "left").na.fill(0)
    return d.withColumn("ratio", F.round(F.when(F.col("ranked") > 0, F.least(F.lit(1.0), F.col("cited") / F.col("ranked"))).otherwise(0.0), 4))


def themes(rows: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, place, term, n): the terms of most evidence rows, ties to the lesser in lower case."""
    t = rows.select("query_id", F.explode("terms").alias("term")).withColumn("term", F.trim("term")).where("term <> ''").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), F.lower("term"), "term"))
    return t.withColumn("place", place).where(F.col("place") <= most)


def method_clusters(ranked: DataFrame) -> DataFrame:
    """(query_id, place, name, ranks): ranks of the papers whose title, abstract or evidence holds a name of each method group: the fixed groups in order, then
    the methods that the query asks for, names apart from case once. A query none of whose papers falls in a group has one group, general."""
    known = [name.lower() for name, _ in C.METHOD_CLUSTERS]
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.array_join(F.transform("evidence", lambda e: e["text"]), " ")))
    group = "array<struct<place:int,key:string,name:string>>"
    asked = F.filter(F.transform(F.coalesce("methods", F.array().cast(NO_TEXT)), lambda m: F.trim(m)), lambda m: (m != "") & ~F.lower(m).isin(*known))
    of = lambda place, name: F.struct(place.cast("int").alias("place"), F.lower(name).alias("key"), name.alias("name"))
    fixed = T.let(text, lambda t: F.concat(
        F.array_compact(F.array(*[F.when(T.contains_any(t, words), of(F.lit(i), F.lit(name))) for i, (name, words) in enumerate(C.METHOD_CLUSTERS)])),
        F.filter(F.transform(asked, lambda m, i: F.when(F.contains(t, F.lower(m)), of(i + len(known), m))), lambda x: x.isNotNull()).cast(group)))
    d = ranked.select("query_id", "rank", F.explode_outer(fixed).alias("g")).select("query_id", "rank", "g.*")
    grouped = d.where("key IS NOT NULL").groupBy("query_id", "key").agg(F.min("place").alias("place"), F.min_by("name", F.struct("place", "name")).alias("name"), F.sort_array(F.collect_set("rank")).alias("ranks"))  # of one ranking
    general = d.groupBy("query_id").agg(F.count("key").alias("n"), F.sort_array(F.collect_set("rank")).alias("ranks")).where("n = 0").select("query_id", F.lit(0).alias("place"), F.lit("general").alias("name"), "ranks")
    placed = grouped.select("query_id", "place", "name", "ranks").unionByName(general)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "name")))
