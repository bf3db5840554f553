"""Rule judgement of candidates against analysed queries, and the final order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.functions import text as T


@dataclass(frozen=True)
class Config:
    """Weights and thresholds; `as_of_year` stands for today in timeliness."""

    as_of_year: int = 2025
    type_bonus: float = 0.08
    type_cap: float = 0.16
    type_penalty: float = -0.08
    venue_bonus: float = 0.10
    venue_penalty: float = -0.03
    time_bonus: float = 0.08
    time_early_far: float = -0.15
    time_early_near: float = -0.08
    time_late: float = -0.06
    missing_abstract: float = 0.0
    missing_metadata: float = 0.0
    coverage_bonus: float = 0.02
    coverage_bonus_cap: float = 0.08
    coverage_penalty: float = -0.06
    broad_topic_cap: float = 0.68
    dataset_penalty: float = -0.08


#: What a query may ask for; each has a column of an analysed query.
CONSTRAINTS = ("must", "methods", "datasets", "types", "venues", "years", "excludes")


def analysed(queries: DataFrame, as_of_year: int) -> DataFrame:
    """queries (query_id, text) plus language, intent, domain, keywords and what is asked for, as far as the text tells;
    required terms are the keywords then. `explicit` names what a user has set, which is nothing yet; own_terms are the words
    of the text that a judgement compares."""
    t = F.col("text")
    low = F.lower(t)
    none = F.array().cast("array<string>")
    types = none
    for name, words in C.PAPER_TYPE_TERMS.items():
        types = F.when(T.contains_any(low, words), F.concat(types, F.array(F.lit(name)))).otherwise(types)
    return queries.select("*", T.language(t).alias("language"), T.intent(t).alias("intent"), T.domain(t).alias("domain"), T.keyword_terms(t).alias("keywords"), T.keyword_terms(t).alias("must"),
                          T.method_terms(t).alias("methods"), T.dataset_terms(t).alias("datasets"), T.venues(t).alias("venues"), T.time_range(t, as_of_year).alias("years"), types.alias("types"),
                          none.alias("excludes"), none.alias("explicit"), T.judgement_terms(t).alias("own_terms"))


def overlay(queries: DataFrame, explicit: DataFrame) -> DataFrame:
    """Analysed queries with what `explicit` (query_id and some of CONSTRAINTS) sets instead of what was inferred.

    Only values that are neither null nor empty count; their names are added to `explicit`. One row per query.
    """
    e = explicit.select("query_id", *[F.col(c).alias(f"_{c}") for c in CONSTRAINTS if c in explicit.columns])
    d = queries.join(e, "query_id", "left")
    given = {c: F.col(f"_{c}").isNotNull() & (F.lit(True) if c == "years" else F.size(F.coalesce(F.col(f"_{c}"), F.array())) > 0) for c in CONSTRAINTS if f"_{c}" in e.columns}
    names = F.array_compact(F.array(*[F.when(g, F.lit(c)) for c, g in given.items()])) if given else F.array().cast("array<string>")
    return d.withColumns({**{c: F.when(g, F.col(f"_{c}")).otherwise(F.col(c)) for c, g in given.items()}, "explicit": F.array_union("explicit", names)}).drop(*[f"_{c}" for c in given])


def lowered(terms: Column) -> Column:
    """Distinct terms in lower case, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(t)), lambda t: F.trim(t) != ""))


def matched(terms: Column) -> Column:
    """How many of the terms the paper has, over the column _in of all that it has."""
    return F.size(F.array_intersect(terms, F.col("_in")))


def signal(terms: Column, kind: str) -> Column:
    """The title's or else the abstract's weight for each distinct term, capped after summing, over the columns _in_title and
    _in_abstract of the terms that either has."""
    in_title, in_abstract, cap = C.SIGNALS[kind]
    n = lambda found: F.size(F.array_intersect(terms, F.col(found)))
    return F.least(F.lit(cap), n("_in_title") * F.lit(in_title) + n("_in_abstract") * F.lit(in_abstract))


def time_signal(years: Column, year: Column, c: Config) -> Column:
    """A missing year or range gives 0."""
    start, end = years["start_year"], years["end_year"]
    return (F.when(years.isNull() | year.isNull(), 0.0).when(start.isNotNull() & (year <= start - 2), c.time_early_far).when(start.isNotNull() & (year < start), c.time_early_near)
            .when(end.isNotNull() & (year > end), c.time_late).otherwise(c.time_bonus))


def category(score: Column) -> Column:
    out = F.lit("irrelevant")
    for name, least in reversed(C.THRESHOLDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


ORDER = (*[name for name, _ in C.THRESHOLDS], "irrelevant", "insufficient_evidence")


def worse(a: Column, b: Column) -> Column:
    place = lambda c: F.array_position(T.words_of(ORDER), c)
    return F.when(place(b) > place(a), b).otherwise(a)


def completeness(title: Column, abstract: Column, authors: Column, year: Column, identifiers: Column) -> Column:
    """The share of five fields that a record has: title, abstract, authors, year, an identifier."""
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.round((has(F.trim(title) != "") + has(F.trim(abstract) != "") + has(authors > 0) + has(year.isNotNull()) + has(identifiers > 0)) / 5.0, 4)


def coverage_adjustment(score: Column, coverages: Column, topic_terms: Column, topic_matched: Column, c: Config) -> Column:
    """The score after a bonus for two or more well covered demands, or a penalty and a cap if there are several demands and
    at most one is covered. coverages: the covered share of each demand (0.9 is well covered)."""
    n, strong = F.size(coverages), F.size(F.filter(coverages, lambda x: x >= 0.9))
    mean = F.aggregate(coverages, F.lit(0.0), lambda s, x: s + x) / n
    out = (F.when((n >= 2) & (strong >= 2) & (mean >= 0.6), score + F.least(F.lit(c.coverage_bonus_cap), strong * c.coverage_bonus))
           .when((n >= 2) & (strong <= 1), F.least(score + c.coverage_penalty, 0.5 + 0.25 * mean)).otherwise(score))
    broad = (topic_terms >= 3) & (topic_matched <= 1) & (strong <= 1)
    return F.when(n == 0, score).when(broad, F.least(out, F.lit(c.broad_topic_cap))).otherwise(out)


#: The components of a score, in the order in which they are added.
PARTS = ("topic", "must", "method", "dataset", "paper_type", "domain_match", "venue", "temporal", "venue_penalty", "temporal_penalty", "type_penalty", "abstract_penalty", "metadata_penalty")
#: Sums of a match and its penalty, which ablation takes away together.
PAIRED = {"type": ("paper_type", "type_penalty"), "venue_match": ("venue", "venue_penalty"), "time": ("temporal", "temporal_penalty")}


def judge(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """candidates hold an analysed query and a paper (title, abstract, venue, year; n_authors and n_ids if known): adds each of
    PARTS (and PAIRED) as s_<part>, the coverage adjustment, score and category.

    The sum is adjusted by how well the demands are covered, clamped and rounded. Then hard constraints: an excluded term
    gives score 0 and irrelevant; a missing explicit required term or a year out of range keeps the score under the first
    threshold; missing explicit data sets or paper types cost a penalty. Nulls are empty; a paper without title and
    abstract has insufficient evidence.
    """
    c = config
    none = F.array().cast("array<string>")
    d = candidates.withColumns({x: none for x in ("must", "methods", "datasets", "types", "venues", "excludes", "explicit") if x not in candidates.columns})
    d = d.withColumns({"_t": F.lower(F.coalesce("title", F.lit(""))), "_a": F.lower(F.coalesce("abstract", F.lit("")))})
    domain_terms = none
    for name, words in C.DOMAIN_TERMS.items():
        domain_terms = F.when(F.col("domain") == name, T.words_of(words)).otherwise(domain_terms)
    own = F.col("own_terms") if "own_terms" in d.columns else T.judgement_terms(F.col("text"))
    d = d.withColumns({"_own": lowered(own), "_must": lowered(F.col("must")), "_methods": lowered(F.col("methods")), "_datasets": lowered(F.col("datasets"))})
    d = d.withColumns({"_topic": F.array_union(F.array_union("_own", "_must"), F.array_union("_methods", "_datasets")), "_domain": domain_terms, "_excludes": lowered(F.col("excludes"))})
    every = F.array_union(F.array_union("_topic", "_domain"), F.array_union("_excludes", T.words_of(sorted({w for words in C.PAPER_TYPE_TERMS.values() for w in words}))))
    d = d.withColumn("_in_title", T.contained(every, F.col("_t")))
    d = d.withColumn("_in_abstract", T.contained(F.array_except(every, "_in_title"), F.col("_a"))).withColumn("_in", F.concat("_in_title", "_in_abstract"))
    found_types = F.lit(0)
    for name, words in C.PAPER_TYPE_TERMS.items():
        found_types = found_types + F.when(F.array_contains("types", name) & F.arrays_overlap("_in", T.words_of(words)), 1).otherwise(0)
    vkey = T.venue_key(F.coalesce("venue", F.lit("")))
    d = d.withColumns({"_types": found_types, "_venue": F.exists("venues", lambda v: F.contains(vkey, T.venue_key(v))) & (vkey != ""),
                       "_time": time_signal(F.col("years"), F.col("year"), c), "_out": F.coalesce((F.col("year") < F.col("years.start_year")) | (F.col("year") > F.col("years.end_year")), F.lit(False))})
    asked = lambda x: F.size(x) > 0
    zero = F.lit(0.0)
    have = lambda x: F.col(x) if x in d.columns else F.lit(1)
    whole = completeness(F.col("_t"), F.col("_a"), have("n_authors"), F.col("year"), have("n_ids"))
    parts = dict(zip(PARTS, (
        signal(F.col("_topic"), "topic"), signal(F.col("_must"), "must"), signal(F.col("_methods"), "method"), signal(F.col("_datasets"), "dataset"),
        F.least(F.lit(c.type_cap), F.col("_types") * c.type_bonus), signal(F.col("_domain"), "domain"),
        F.when(asked("venues") & F.col("_venue"), c.venue_bonus).otherwise(zero), F.greatest(F.col("_time"), zero),
        F.when(asked("venues") & ~F.col("_venue"), c.venue_penalty).otherwise(zero), F.least(F.col("_time"), zero),
        F.when(asked("types") & (F.col("_types") == 0), c.type_penalty).otherwise(zero),
        F.when(F.trim("_a") == "", -c.missing_abstract).otherwise(zero), -c.missing_metadata * (1 - whole))))
    d = d.withColumns({f"s_{k}": F.round(v, 6) for k, v in parts.items()})
    d = d.withColumns({f"s_{k}": F.round(F.col(f"s_{a}") + F.col(f"s_{b}"), 6) for k, (a, b) in PAIRED.items()})
    share = lambda f: matched(F.col(f)) / F.size(f)
    explicit = lambda x: F.array_contains("explicit", x)
    same = (F.size(F.array_except("_must", "_own")) == 0) & (F.size(F.array_except("_own", "_must")) == 0)
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    coverages = F.array_compact(F.array(
        F.when(asked("_own"), share("_own")), F.when(asked("_methods"), share("_methods")), F.when(asked("_datasets"), share("_datasets")),
        F.when(asked("_must") & (explicit("must") | ~same), share("_must")), F.when(asked("types"), F.col("_types") / F.size("types")),
        F.when(asked("venues"), yes(F.col("_venue"))), F.when(F.col("years").isNotNull(), yes(F.col("year").isNotNull() & ~F.col("_out")))))
    total = sum((F.col(f"s_{k}") for k in PARTS), zero)
    d = d.withColumn("_sum", total).withColumn("_score", coverage_adjustment(F.col("_sum"), coverages, F.size("_own"), matched(F.col("_own")), c)).withColumn("coverage_adjustment", F.round(F.col("_score") - F.col("_sum"), 6))
    blank = (F.trim("_t") == "") & (F.trim("_a") == "")
    first = C.THRESHOLDS[0][1]
    below = F.lit(round(first - 0.0001, 4))
    d = d.withColumn("_score", F.when(blank, 0.0).otherwise(F.round(T.clamp(F.col("_score")), 4))).withColumn("_category", F.when(blank, "insufficient_evidence").otherwise(category(F.col("_score"))))
    partial = F.lit(C.THRESHOLDS[1][0])
    steps = [  # condition, score then, category then
        (explicit("must") & (matched(F.col("_must")) < F.size("_must")), lambda s: F.least(s, below), lambda s: partial),
        (asked("_datasets") & explicit("datasets") & (matched(F.col("_datasets")) == 0), lambda s: F.greatest(s + c.dataset_penalty, zero), category),
        (asked("types") & (F.col("_types") == 0), lambda s: F.greatest(s + c.type_penalty, zero), category),
        (F.col("_out"), lambda s: F.least(s, below), lambda s: partial)]
    for when, then, least in steps:
        d = d.withColumn("_next", F.when(when, then(F.col("_score"))).otherwise(F.col("_score")))
        d = d.withColumn("_category", F.when(when, worse(F.col("_category"), least(F.col("_next")))).otherwise(F.col("_category"))).withColumn("_score", F.col("_next"))
    excluded = matched(F.col("_excludes")) > 0
    d = d.withColumns({"score": F.when(excluded, 0.0).otherwise(F.round(T.clamp(F.col("_score")), 4)), "category": F.when(excluded, "irrelevant").otherwise(F.col("_category"))})
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def authority(citations: Column, sources: Column, identifiers: Column, venue: Column) -> Column:
    c = F.least(F.log10(F.coalesce(citations, F.lit(0)) + 1.0) / F.log10(F.lit(1001.0)), F.lit(1.0))
    return 0.65 * c + 0.15 * F.least(sources / 3.0, F.lit(1.0)) + 0.12 * F.least(identifiers / 5.0, F.lit(1.0)) + venue


def timeliness(years: Column, year: Column, as_of_year: int) -> Column:
    """Within a range of several years from 0.7 to 1 by place in it, 0.85 where the range has one end or one year, outside 0;
    without a range by age; a missing year is 0 with and .25 without."""
    start, end = years["start_year"], years["end_year"]
    inside = F.when(end > start, 0.7 + 0.3 * (year - start) / (end - start)).otherwise(0.85)
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year)
    return (F.when(years.isNotNull() & year.isNull(), 0.0).when(years.isNotNull() & ((year < start) | (year > end)), 0.0).when(years.isNotNull(), inside)
            .when(year.isNull(), 0.25).otherwise(1 - F.least(age, F.lit(12)) / 12.0))


def metadata(title: Column, abstract: Column, year: Column, venue: Column, sources: Column, identifiers: Column) -> Column:
    has = lambda c: F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0)
    return 0.2 * has(title) + 0.25 * has(abstract) + 0.15 * has(year) + 0.15 * has(venue) + 0.1 * F.when(sources > 0, 1.0).otherwise(0.0) + 0.15 * F.least(identifiers / 5.0, F.lit(1.0))


def _weight(i: int) -> Column:
    out = F.lit(C.OTHER_WEIGHTS[i])
    for name, w in C.INTENT_WEIGHTS.items():
        out = F.when(F.col("intent") == name, w[i]).otherwise(out)
    return out


def breakdown(judged: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds authority, timeliness, metadata and final: weighted by intent, multiplied by category."""
    venue = F.when(F.size("venues") == 0, F.when(F.coalesce("venue", F.lit("")) != "", 0.08).otherwise(0.0)).otherwise(F.when(F.col("s_venue_match") > 0, 0.12).otherwise(0.0))
    d = judged.withColumns({
        "authority": F.round(authority(F.col("citation_count"), F.col("n_sources"), F.col("n_ids"), venue), 6),
        "timeliness": F.round(timeliness(F.col("years"), F.col("year"), config.as_of_year), 6),
        "metadata": F.round(metadata(F.col("title"), F.col("abstract"), F.col("year"), F.col("venue"), F.col("n_sources"), F.col("n_ids")), 6)})
    multiplier = F.lit(0.0)
    for name, m in C.CATEGORY_MULTIPLIER.items():
        multiplier = F.when(F.col("category") == name, m).otherwise(multiplier)
    total = _weight(0) * F.col("score") + _weight(1) * F.col("authority") + _weight(2) * F.col("timeliness") + _weight(3) * F.col("metadata")
    return d.withColumn("final", F.round(total * multiplier, 4))


TIERS = tuple(C.CATEGORY_MULTIPLIER)


def rerank(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Adds rank: by category, final score, relevance, citations, year, title, then a digest of the id."""
    tier = F.array_position(T.words_of(TIERS), F.col("category"))
    order = [tier, F.desc("final"), F.desc("score"), F.desc(F.coalesce("citation_count", F.lit(0))), F.coalesce("year", F.lit(-1)).desc(), F.lower("title"), F.sha2(F.col("doc").cast("string"), 256)]
    d = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return d.where(F.col("rank") <= top) if top else d


def quality(title: Column, abstract: Column, year: Column, venue: Column, sources: Column, identifiers: Column, full_text: Column) -> Column:
    """The mean of completeness, sources out of 2, identifiers out of 3 and full text."""
    has = lambda c: F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0)
    return ((has(title) + has(abstract) + has(year) + has(venue)) / 4 + F.least(sources / 2.0, F.lit(1.0)) + F.least(identifiers / 3.0, F.lit(1.0)) + full_text.cast("double")) / 4


def soft_rank(ranked: DataFrame, weight: float = 0.02) -> DataFrame:
    """Re-ranks by final + weight * quality within a category."""
    tier = F.array_position(T.words_of(TIERS), F.col("category"))
    order = Window.partitionBy("query_id").orderBy(tier, F.desc(F.round(F.col("final") + weight * F.col("quality"), 6)), "rank")
    return ranked.withColumn("soft_rank", F.row_number().over(order))


def ablation(judged: DataFrame, rule: str) -> DataFrame:
    """Score and category without one component (of PARTS), by thresholds alone."""
    score = F.round(T.clamp(F.col("score") - F.col(f"s_{rule}")), 4)
    return judged.withColumn("ablated", score).withColumn("ablated_category", category(score))
