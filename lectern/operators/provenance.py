"""Where records and ranks come from: stable keys for ties, verified evidence, status of gold, lists that gave a candidate, resolved seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

from . import identity
from .judgement import TIERS

SAME = ("shared_stable_identifier", "exact_title_author_year")


def _digest(value: Column) -> Column:
    """SHA-256 of a struct as JSON without blanks; its fields stand in the order of their names."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def _plain(text: Column) -> Column:
    """Compatibility form, lower case, single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.lower(T.nfkc(F.coalesce(text, F.lit("")))), r"\s+", " "))


def tie_keys(profiled: DataFrame, details: DataFrame) -> DataFrame:
    """(paper_id, tie_key) of profiles: 0:digest of all identifiers, else 1:digest of title, authors and year where all are known, else 2:digest of sources,
    record references and the normal form of all fields; null where none of these can be had.

    details: paper_id, sources and refs (arrays of strings; a reference reads record:...), and any of venue, abstract, landing_page, pdf, citation_count. Nothing
    of the position or the run enters a key.
    """
    have = lambda c, kind="string": F.col(c) if c in details.columns else F.lit(None).cast(kind)
    d = profiled.join(details.select("paper_id", have("sources", "array<string>").alias("_sources"), have("refs", "array<string>").alias("_refs"), *[have(c).alias(f"_{c}") for c in ("venue", "abstract", "landing_page", "pdf")],
                                     F.coalesce(have("citation_count", "long").cast("long"), F.lit(0)).alias("_cited")), "paper_id", "left")
    full = (F.col("title_key") != "") & (F.size("author_keys") > 0) & F.col("year").isNotNull()
    by_id = _digest(F.struct(F.array_sort("keys").alias("identifiers"), F.lit("stable_identifiers").alias("kind")))
    by_title = _digest(F.struct(F.col("author_keys").alias("authors"), F.lit("exact_title_author_year").alias("kind"), F.col("title_key").alias("title"), F.col("year").alias("year")))
    done = d.where((F.size("keys") > 0) | full).select("paper_id", F.when(F.size("keys") > 0, F.concat(F.lit("0:"), by_id)).otherwise(F.concat(F.lit("1:"), by_title)).alias("tie_key"))
    tidy = lambda c, f: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), lambda x: x != "")))
    rest = d.where(~((F.size("keys") > 0) | full)).withColumns({"_refs": tidy("_refs", lambda x: x), "_sources": tidy("_sources", lambda x: F.lower(F.trim(x)))})
    fields = F.struct(_plain(F.col("_abstract")).alias("abstract"), F.col("author_keys").alias("authors"), F.col("_cited").alias("citation_count"), _plain(F.col("_landing_page")).alias("landing_page"), _plain(F.col("_pdf")).alias("pdf"),
                      F.col("title_key").alias("title"), T.title_key(F.coalesce("_venue", F.lit(""))).alias("venue"), F.col("year").alias("year"))
    whole = _digest(F.struct(_digest(fields).alias("field_summary_sha256"), F.lit("source_record_and_normalized_fields").alias("kind"), F.col("_refs").alias("source_record_refs"), F.col("_sources").alias("sources")))
    sound = (F.size("_refs") > 0) & F.forall("_refs", lambda x: x.startswith("record:"))
    return done.unionByName(rest.select("paper_id", F.when(sound, F.concat(F.lit("2:"), whole)).alias("tie_key")))


def stable_order(scored: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """scored (query_id, doc, category, final, score, citation_count, year, title) plus tie_key, rank and tie: by category, final score, relevance, citations, year
    and title, then the key of tie_keys; no position decides.

    tie: unavailable (no key), collision (another row of the query agrees in all of these and the key), or null. Such rows are ordered by a digest of their id. With
    `strict` they raise when they are read.
    """
    tier = F.array_position(T.words_of(TIERS), F.col("category"))
    d = scored.join(keys.select(F.col("paper_id").alias("doc"), "tie_key"), "doc", "left")
    d = d.withColumns({"_tier": tier, "_cited": F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)), "_year": F.coalesce("year", F.lit(0)), "_title": F.lower(F.coalesce("title", F.lit("")))})
    order = ["_tier", F.desc("final"), F.desc("score"), F.desc("_cited"), F.desc("_year"), "_title", F.col("tie_key").asc_nulls_last(), F.sha2(F.col("doc").cast("string"), 256), "doc"]
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    equal = F.count(F.lit(1)).over(Window.partitionBy("query_id", "_tier", "final", "score", "_cited", "_year", "_title", "tie_key"))  # within the query's partition
    d = d.withColumn("tie", F.when(F.col("tie_key").isNull(), "unavailable").when(equal > 1, "collision"))
    if strict:
        d = d.withColumn("rank", F.when(F.col("tie").isNotNull(), F.raise_error(F.concat(F.lit("tie_"), "tie", F.lit(":"), F.col("doc").cast("string")))).otherwise(F.col("rank")))
    return d.drop("_tier", "_cited", "_year", "_title")


def verified(profiled: DataFrame, ledger: DataFrame) -> DataFrame:
    """(paper_id, signal_name, state, records): what a ledger (paper_identifier, signal_name, state, source_record_id) says of a paper by any of its identifiers; state
    conflict where its lines disagree. Papers that no line names have no row."""
    hit = profiled.select("paper_id", F.explode("keys").alias("paper_identifier")).join(ledger, "paper_identifier")
    state = F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("conflict")
    return hit.groupBy("paper_id", "signal_name").agg(state.alias("state"), F.count(F.lit(1)).alias("records"))


def gold_relations(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, identified, conflicts) of gold relations, each made of the records that stand for it: members has `by` and the columns of a profile.

    status: identifier_conflict (two values of one field), stable_identifier_evaluable, conservative_title_evidence_evaluable (some record has title, authors and year),
    identity_ambiguous (some of these), insufficient_information. identified and conflicts name the fields with a value, and with several.
    """
    full = (F.col("title_key") != "") & (F.size("author_keys") > 0) & F.col("year").isNotNull()
    some = (F.col("title_key") != "") | (F.size("author_keys") > 0) | F.col("year").isNotNull()
    spans = [F.struct(F.min(f"n_{f}").alias("least"), F.max(f"n_{f}").alias("most")).alias(f"_{f}") for f in identity.FIELDS]
    d = members.groupBy(*by).agg(F.max(F.size("keys") > 0).alias("_keyed"), F.max(full).alias("_full"), F.max(some).alias("_some"), *spans)
    named = lambda when: F.array_compact(F.array(*[F.when(when(F.col(f"_{f}")), F.lit(f)) for f in sorted(identity.FIELDS)]))
    d = d.withColumns({"identified": named(lambda s: s["least"].isNotNull()), "conflicts": named(lambda s: F.coalesce(s["least"] != s["most"], F.lit(False)))})
    status = F.when(F.size("conflicts") > 0, "identifier_conflict").when(F.col("_keyed"), "stable_identifier_evaluable").when(F.col("_full"), "conservative_title_evidence_evaluable").when(F.col("_some"), "identity_ambiguous").otherwise("insufficient_information")
    return d.select(*by, status.alias("status"), "identified", "conflicts")


def _blocks(profiled: DataFrame) -> DataFrame:
    """(paper_id, block): papers that may be the same share one."""
    titled = F.when((F.col("title_key") != "") & F.col("year").isNotNull(), F.array(F.concat_ws(":", F.lit("t"), "title_key", F.col("year").cast("string")))).otherwise(F.array().cast("array<string>"))
    return profiled.select("paper_id", F.explode(F.concat("keys", titled)).alias("block"))


def rank_provenance(candidates: DataFrame, entries: DataFrame, profiled: DataFrame, k: int = 60) -> tuple[DataFrame, DataFrame]:
    """(status, contributions) of candidates (query_id, doc) among the entries of lists (query_id, source, subquery, rank, doc).

    An entry belongs to the candidate of its query with the same identity. status: query_id, doc, lists, rrf_score, status: missing (no entry), ambiguous (an entry of it
    belongs to other candidates as well) or traced. contributions: query_id, doc, source, subquery, rank (the best), reciprocal. Entries of rank 0 or less are none.
    """
    e = entries.where("rank > 0")
    blocks = _blocks(profiled)
    c = candidates.select("query_id", "doc").distinct()
    mine = c.join(blocks.withColumnRenamed("paper_id", "doc"), "doc")
    theirs = e.select("query_id", F.col("doc").alias("entry")).distinct().join(blocks.withColumnRenamed("paper_id", "entry"), "entry")
    met = mine.join(theirs, ["query_id", "block"]).select("query_id", "doc", "entry").distinct()
    judged = met.join(profiled.alias("a"), F.col("doc") == F.col("a.paper_id")).join(profiled.alias("b"), F.col("entry") == F.col("b.paper_id")).where(identity.evidence("a", "b").isin(*SAME)).select("query_id", "doc", "entry")
    of = judged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "entry")))
    best = of.join(e.withColumnRenamed("doc", "entry"), ["query_id", "entry"]).groupBy("query_id", "doc", "source", "subquery").agg(F.min("rank").alias("rank"), F.max(F.col("_n") > 1).alias("_shared"))
    best = best.withColumn("reciprocal", 1.0 / (k + F.col("rank")))
    summed = best.groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("lists"), F.round(F.sum("reciprocal"), 9).alias("rrf_score"), F.max("_shared").alias("_shared"))
    s = c.join(summed, ["query_id", "doc"], "left")
    status = F.when(F.col("lists").isNull(), "missing").when(F.col("_shared"), "ambiguous").otherwise("traced")
    return s.select("query_id", "doc", F.coalesce("lists", F.lit(0)).alias("lists"), F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"), status.alias("status")), best.drop("_shared")


#: Fields by which a seed is looked up, in order, and how many of a query are.
RESOLVED_BY, RESOLUTIONS = ("doi", "arxiv_id", "pubmed_id", "s2orc_corpus_id"), 100


def resolutions(ranked: DataFrame, profiled: DataFrame, found: DataFrame, most: int = RESOLUTIONS) -> DataFrame:
    """(query_id, rank, doc, requested, status, rule, semantic_scholar_id): ranked papers (query_id, rank, doc) without an S2 id looked up among the profiles `found` by their first identifier of RESOLVED_BY.

    Each identifier is asked once in a query, for its best rank, `most` of a query; this limit is the feature. The first paper found is taken. status: missing, conflict (it
    has no S2 id, or disagrees in an identifier) or resolved.
    """
    asked = F.coalesce(*[F.concat(F.lit(identity.ids.PREFIX[f] + ":"), F.col(f"n_{f}")) for f in RESOLVED_BY])
    r = ranked.select("query_id", "rank", "doc").join(profiled.where("n_semantic_scholar_id IS NULL").select(F.col("paper_id").alias("doc"), asked.alias("requested")), "doc").where("requested IS NOT NULL")
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "requested").orderBy("rank", "doc"))).where("_n = 1")
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc"))).where(F.col("_n") <= most).drop("_n")
    first = found.select("paper_id", F.explode("keys").alias("requested")).groupBy("requested").agg(F.min("paper_id").alias("mapped"))  # one row of a key, whatever shares it
    j = r.join(first, "requested", "left")
    pairs = j.where("mapped IS NOT NULL").select("doc", "mapped").distinct()
    ruled = pairs.join(profiled.alias("a"), F.col("doc") == F.col("a.paper_id")).join(found.alias("b"), F.col("mapped") == F.col("b.paper_id")).select("doc", "mapped", identity.evidence("a", "b").alias("rule"), F.col("b.n_semantic_scholar_id").alias("semantic_scholar_id"))
    d = j.join(ruled, ["doc", "mapped"], "left")
    sound = (F.col("rule") == SAME[0]) & F.col("semantic_scholar_id").isNotNull()
    return d.select("query_id", "rank", "doc", "requested", F.when(F.col("mapped").isNull(), "missing").when(sound, "resolved").otherwise("conflict").alias("status"), "rule", "semantic_scholar_id")


def expansion_seeds(ranked: DataFrame, profiled: DataFrame, resolved: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, place, rank, semantic_scholar_id, source): the first `most` distinct S2 ids of a query, a paper's own (direct) or the resolved one; the limit is the feature."""
    own = profiled.select(F.col("paper_id").alias("doc"), F.col("n_semantic_scholar_id").alias("_own"))
    d = ranked.select("query_id", "rank", "doc").join(own, "doc", "left").join(resolved.where("status = 'resolved'").select("query_id", "doc", F.col("semantic_scholar_id").alias("_found")), ["query_id", "doc"], "left")
    d = d.select("query_id", "rank", F.coalesce("_own", "_found").alias("semantic_scholar_id"), F.when(F.col("_own").isNotNull(), "direct").otherwise("resolved").alias("source")).where("semantic_scholar_id IS NOT NULL")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", F.lower("semantic_scholar_id")).orderBy("rank"))).where("_n = 1")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most).select("query_id", "place", "rank", "semantic_scholar_id", "source")
