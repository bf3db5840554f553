"""Reports over runs: costs, errors, candidates, stages, signals, strata, shards and resumption. All are set-at-a-time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import materialize

from lectern.functions import text as T


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


# costs and errors


def efficiency(cases: DataFrame, averages: list[str], totals: list[str], by: list[str] | None = None) -> DataFrame:
    """cases, and the mean of some columns and the sum of some over all cases; nulls count as 0."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    return cases.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(value(c)), 6).alias(f"avg_{c}") for c in averages], *[F.sum(value(c)).alias(f"total_{c}") for c in totals])


def candidate_counts(candidates: DataFrame, by: list[str]) -> DataFrame:
    """candidates (query, source, identity): raw, distinct and repeated candidates of each query, and how many each source gave."""
    per = candidates.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))
    sources = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("per_source"))  # a row for each source
    d = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("identity").alias("distinct"))
    d = d.withColumn("repeated", F.col("raw") - F.col("distinct")).withColumn("repeated_share", F.round(_share(F.col("repeated"), F.col("raw")), 6))
    return d.join(sources, by)


def error_rates(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls (case, failed, error, warning): source calls and errors, the share of cases with a warning and of failed cases.
    A blank message is none."""
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    cases = calls.groupBy(*by, "case").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(said("error"), 1)).alias("errors"), F.count(F.when(said("warning"), 1)).alias("warnings"), F.max(F.coalesce("failed", F.lit(False))).alias("failed"))
    d = cases.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.count(F.lit(1)).alias("cases"),
                               F.count(F.when(F.col("warnings") > 0, 1)).alias("warned"), F.count(F.when(F.col("failed"), 1)).alias("failed"))
    return d.withColumns({"error_rate": F.round(_share(F.col("errors"), F.col("calls")), 6), "warning_rate": F.round(_share(F.col("warned"), F.col("cases")), 6), "failed_rate": F.round(_share(F.col("failed"), F.col("cases")), 6)})


def source_reliability(calls: DataFrame, top: int = 5) -> DataFrame:
    """calls (source, error, skipped, returned, latency): calls, successes, errors, skips, results, mean latency and the most
    frequent error messages of each source, ties by message. A skipped call is neither a success nor an error."""
    failed = F.trim(F.coalesce("error", F.lit(""))) != ""
    skipped = F.coalesce("skipped", F.lit(False))
    d = calls.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~failed & ~skipped, 1)).alias("successes"), F.count(F.when(failed & ~skipped, 1)).alias("errors"),
                                    F.count(F.when(skipped, 1)).alias("skips"), F.sum(F.coalesce("returned", F.lit(0))).alias("returned"), F.round(F.avg(F.coalesce("latency", F.lit(0.0))), 6).alias("latency"))
    said = calls.where(failed & ~skipped).groupBy("source", "error").agg(F.count(F.lit(1)).alias("n"))
    said = said.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "error"))).where(F.col("r") <= top)
    said = said.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "error", "n"))), lambda x: F.concat_ws(":", x["error"], x["n"].cast("string"))).alias("messages"))  # `top` at most
    return d.join(said, "source", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def quantities(rows: DataFrame, by: list[str], value: str = "value", state: str = "state") -> DataFrame:
    """Sums of quantities that are known, unavailable or not_applicable: what is missing is never 0. The total is null where
    nothing is known; complete tells whether nothing that applies is unavailable."""
    is_ = lambda s: F.col(state) == s
    d = rows.groupBy(*by).agg(F.sum(F.when(is_("known"), F.col(value))).alias("total"), *[F.count(F.when(is_(s), 1)).alias(s) for s in ("known", "unavailable", "not_applicable")])
    return d.withColumn("complete", F.col("unavailable") == 0)


# stages


def reranking(gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """gold (found, returned, rank): of gold that was found and is in a returned category, how many are in the top 5, 10 and 20
    or outside, and the mean and median rank. A null rank is outside."""
    rank = F.col("rank")
    d = gold.where("found and returned").groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("eligible"), *[F.count(F.when(rank <= k, 1)).alias(f"top_{k}") for k in (5, 10, 20)], F.count(F.when(rank.isNull() | (rank > 20), 1)).alias("outside"),
        F.round(F.avg("rank"), 6).alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    return d.withColumn("outside_rate", F.round(_share(F.col("outside"), F.col("eligible")), 6))


#: Thresholds of bottlenecks: metric, whether it must be below or at least this, label.
BOTTLENECKS = (("cases", "below", 30, "insufficient_sample"), ("recall", "below", 0.5, "retrieval_recall_bottleneck"), ("false_negative_rate", "from", 0.25, "judgement_false_negative_bottleneck"),
               ("outside_rate", "from", 0.25, "reranking_bottleneck"), ("error_rate", "from", 0.2, "source_reliability_bottleneck"), ("budget_stop_rate", "from", 0.2, "budget_bottleneck"))


def bottlenecks(metrics: DataFrame) -> DataFrame:
    """metrics with labels: every threshold that is missed, in order. An unknown metric, or a column that is not there, gives no label."""
    test = lambda c, kind, v: F.col(c) < v if kind == "below" else F.col(c) >= v
    return metrics.withColumn("labels", F.array_compact(F.array(*[F.when(test(c, kind, v), label) for c, kind, v, label in BOTTLENECKS if c in metrics.columns])))


def retrieval_failure(s: Mapping[str, Column]) -> Column:
    """The first reason for which a gold document was not retrieved, of the signals source_error, identifier_available,
    metadata_mismatch, rank, term_loss, coverage, over_restrictive and title_hit; a null signal is false."""
    yes = lambda c: F.coalesce(s[c], F.lit(False))
    return (F.when(yes("source_error"), "source_error").when(~yes("identifier_available"), "source_unavailable").when(yes("metadata_mismatch"), "metadata_mismatch")
            .when(s["rank"].between(21, 50), "result_limit_truncation").when(s["rank"].between(51, 100), "query_over_broad_ranked_below_limit").when(yes("term_loss"), "adapter_term_loss")
            .when(F.coalesce(s["coverage"], F.lit(0.0)) < 0.15, "lexical_mismatch").when(yes("over_restrictive"), "query_over_restrictive")
            .when(yes("title_hit"), "identifier_available_but_query_not_matched").otherwise("unknown"))


def lexical_overlap(query: Column, document: Column) -> Column:
    """struct(asked, matched, coverage, jaccard) of the distinct tokens of a query and of a document."""
    one = F.array_intersect(query, document)
    n, both = F.size(F.array_distinct(query)), F.size(F.array_union(query, document))
    return F.struct(n.alias("asked"), F.size(one).alias("matched"), F.round(_share(F.size(one), n), 6).alias("coverage"), F.round(_share(F.size(one), both), 6).alias("jaccard"))


def term_loss(original: Column, adapted: Column, gold: Column) -> Column:
    """The tokens of a query that stand in a gold document but in no adapted query."""
    return F.array_except(F.array_intersect(original, gold), adapted)


def slices(rows: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """(dimension, label, n, mean) of a value by each of several labellings at once."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions])).alias("x"), F.col(value).alias("v"))
    return long.groupBy("x.dimension", "x.label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


# queries and candidates


def query_features(text: Column, place: Column, count: Column) -> dict[str, Column]:
    """What can be told of a query without an answer: counts, flags, a length bucket, and its place among `count` queries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = F.size(words)
    hits = lambda p: F.regexp_count(low, F.lit(p))
    quotes, years = hits("[\"'“”‘’「」『』]"), hits(r"(?<!\d)(?:19|20)\d{2}(?!\d)")
    chars = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda s, x: s + x)
    return {"characters": F.length(low), "digits": hits(r"\p{Nd}"), "mean_token": F.round(_share(chars, n), 6), "non_ascii": hits(r"[^\x00-\x7F]"),
            "position": F.round(F.when(count > 1, place / (count - 1)).otherwise(0.0), 6), "punctuation": hits(r"\p{P}"), "quotes": quotes, "tokens": n, "distinct_tokens": F.size(F.array_distinct(words)), "years": years,
            "has_boolean": F.regexp_like(low, F.lit(r"(?<![\p{L}\p{N}])(?:and|or|not)(?![\p{L}\p{N}])|&&|\|\|")), "has_parentheses": low.rlike("[()]"), "has_question": low.rlike("[?？]"), "has_quoted": quotes >= 2,
            "has_unicode": low.rlike(r"[^\x00-\x7F]"), "has_year": years > 0, "bucket": F.when(n <= 8, "short").when(n <= 20, "medium").otherwise("long")}


def candidate_signals(provenance: DataFrame) -> DataFrame:
    """provenance (query_id, doc, source, query, purpose, rank): for each candidate its best rank, the lists, sources and original
    or derived lists that support it, and whether provenance is complete. A list is a source and a query; rows without
    these count as incomplete only, and a rank below 1 as none."""
    rank = F.when(F.col("rank") > 0, F.col("rank"))
    named = (F.trim(F.coalesce("source", F.lit(""))) != "") & (F.trim(F.coalesce("query", F.lit(""))) != "")
    d = provenance.withColumns({"_rank": rank, "_named": named})
    lists = d.where("_named").groupBy("query_id", "doc", "source", "query").agg(F.min("_rank").alias("best"), F.min_by("purpose", F.coalesce("_rank", F.lit(1 << 30))).alias("purpose"))
    per = lists.groupBy("query_id", "doc").agg(F.min("best").alias("best_rank"), F.count(F.lit(1)).alias("lists"), F.count_distinct("source").alias("sources"), F.count(F.when(F.col("purpose") == "original", 1)).alias("original_lists"))
    whole = d.groupBy("query_id", "doc").agg(F.count(F.when(~F.col("_named") | F.col("_rank").isNull(), 1)).alias("incomplete"))
    j = whole.join(per, ["query_id", "doc"], "left").fillna(0, ["lists", "sources", "original_lists"])
    return j.select("query_id", "doc", "best_rank", F.round(F.coalesce(1 / F.col("best_rank"), F.lit(0.0)), 6).alias("reciprocal"), "lists", "sources", "original_lists", (F.col("lists") - F.col("original_lists")).alias("derived_lists"),
                    F.when(F.col("incomplete") > 0, "incomplete").otherwise("complete").alias("provenance"))


def rank_by(signals: DataFrame, signal: str) -> DataFrame:
    """signals with a rank within the query by one of them, the largest first, ties to the smaller doc."""
    return signals.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(signal), "doc")))


def bucketed_order(docs: DataFrame, score: str, citations: str, year: str, width: float = 0.05) -> DataFrame:
    """docs with a rank within the query: by score to the nearest `width`, then citations, then year (none: -1), then doc."""
    bucket = F.bround(F.col(score) / width)
    order = [bucket.desc(), F.coalesce(citations, F.lit(0)).desc(), F.coalesce(year, F.lit(-1)).desc(), F.col("doc")]
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def selected(ranked: DataFrame, partial: bool = False) -> DataFrame:
    """What is returned: highly relevant results, with `partial` the partially relevant too, numbered by category and rank."""
    names = ["highly_relevant", *(["partially_relevant"] if partial else [])]
    tier = F.array_position(T.words_of(names), F.col("category"))
    return ranked.where(F.col("category").isin(names)).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(tier, "rank", "doc")))


def near_duplicate(a: Column, b: Column, at_least: float = 0.8) -> Column:
    """Titles whose tokens have a Jaccard similarity of at least 0.8; an empty one is no copy of anything."""
    return T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))) >= at_least


# runs, shards and resumption


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with their ordinal in the order of `key`, from 0: sorted parts are counted, and the counts before a part are added, so
    that no task orders all rows. Parts are written before they are counted: planned twice, a range exchange may
    sample other bounds the second time."""
    d = rows.withColumn("_k", F.col(key)).repartitionByRange(F.col("_k")).withColumn("_p", F.spark_partition_id())
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    d = materialize(d, "numbered")
    part = d.groupBy("_p").agg(F.max("_n").alias("_c"))  # a row for each partition
    part = part.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return d.join(F.broadcast(part), "_p").withColumn("ordinal", F.col("_n") - 1 + F.col("_before")).drop("_k", "_p", "_n", "_before")


def shards(rows: DataFrame, key: str, count: int) -> DataFrame:
    """rows with ordinal and shard: the ordinal modulo the number of shards, the same in every run."""
    return numbered(rows, key).withColumn("shard", F.pmod("ordinal", F.lit(count)))


def shard_plan(assigned: DataFrame, key: str) -> DataFrame:
    """(shard, n, first, last, digest): a disjoint cover of all rows, with a digest that is the sum of the keys' hashes and so
    does not depend on their order."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"), F.sum(h).alias("digest"))


def attempts(rows: DataFrame) -> DataFrame:
    """rows (shard, attempt, supersedes): the attempt of each shard that nothing supersedes, and a violation if there is not just
    one root and one such tip, or an attempt supersedes one of another shard or none that exists."""
    later = rows.select("shard", F.col("supersedes").alias("attempt")).where("attempt is not null")
    tips = rows.join(later.distinct(), ["shard", "attempt"], "left_anti").groupBy("shard").agg(F.max("attempt").alias("tip"), F.count(F.lit(1)).alias("tips"))
    lost = later.join(rows.select("shard", "attempt"), ["shard", "attempt"], "left_anti").groupBy("shard").agg(F.count(F.lit(1)).alias("lost"))
    twice = later.groupBy("shard", "attempt").count().where("count > 1").groupBy("shard").agg(F.count(F.lit(1)).alias("branches"))
    roots = rows.groupBy("shard").agg(F.count(F.when(F.col("supersedes").isNull(), 1)).alias("roots"), F.count(F.lit(1)).alias("attempts"))
    d = roots.join(tips, "shard", "left").join(lost, "shard", "left").join(twice, "shard", "left").fillna(0, ["tips", "lost", "branches"])
    why = F.when(F.col("lost") > 0, "gap").when(F.col("branches") > 0, "branch").when((F.col("tips") == 0) | (F.col("roots") == 0), "cycle").when((F.col("tips") > 1) | (F.col("roots") > 1), "several_chains")
    return d.select("shard", "attempts", F.when(why.isNull(), F.col("tip")).alias("tip"), why.alias("violation"))


def resume(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """The required rows that are not there yet."""
    return required.join(present.select(*key).distinct(), key, "left_anti")


def resumed(checkpoint: DataFrame, again: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(checkpoint with the rows that only the second run has, keys that both have, which a resumption must not)."""
    fresh = again.join(checkpoint.select(*key).distinct(), key, "left_anti")
    return checkpoint.unionByName(fresh), again.select(*key).distinct().join(checkpoint.select(*key).distinct(), key, "left_semi")


def run_deltas(runs: DataFrame, baseline: str, metrics: list[str], by: list[str]) -> DataFrame:
    """runs (run, by.., metrics): each run beside the baseline of its group, as differences; groups without one are left out."""
    b = runs.where(F.col("run") == baseline).select(*by, *[F.col(m).alias(f"_{m}") for m in metrics])
    return runs.where(F.col("run") != baseline).join(b, by).select("run", *by, *[F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"delta_{m}") for m in metrics])


def expired(runs: DataFrame, age: str, keep: int) -> DataFrame:
    """runs (run, at) that go: older than `age` (an interval) before the latest, or beyond the `keep` most recent."""
    last = runs.agg(F.max("at").alias("_last"))
    old = runs.join(F.broadcast(last)).where(F.col("at") < F.col("_last") - F.expr(f"INTERVAL {age}")).select("run", F.lit("age").alias("reason"))
    kept = runs.orderBy(F.desc("at"), F.desc("run")).limit(keep).select("run")
    return old.unionByName(runs.join(kept, "run", "left_anti").join(old.select("run"), "run", "left_anti").select("run", F.lit("count").alias("reason")))


def crosswalk(records: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """records with what a crosswalk (key, fields, status) knows of them; a record that it lacks is missing, one with several
    differing rows ambiguous, and neither gets identifiers."""
    k = known.groupBy(key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])).alias("_n"), *[F.min(f).alias(f) for f in fields])
    j = records.join(k, key, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return j.withColumns({f: F.when(F.col("_n") == 1, F.col(f)) for f in fields}).withColumn("status", status).drop("_n")


def probes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least SHA-256 of their key: a sample that does not depend on the order of rows."""
    return rows.withColumn("digest", F.sha2(F.col(key).cast("string"), 256)).orderBy("digest", key).limit(n)


def order_diagnostics(positions: DataFrame, by: list[str], total: int) -> DataFrame:
    """positions (ordinal): count, least, largest and mean ordinal, how many stand in each quarter of `total`, and the length of
    the prefix 0, 1, 2.. without a gap."""
    quarter = F.floor(F.col("ordinal") * 4 / total)
    d = positions.select(*by, "ordinal").distinct()
    gap = d.withColumn("_gap", F.col("ordinal") != F.row_number().over(Window.partitionBy(*by).orderBy("ordinal")) - 1)
    return gap.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most"), F.round(F.avg("ordinal"), 6).alias("mean"),
                                *[F.count(F.when(quarter == q, 1)).alias(f"q{q + 1}") for q in range(4)], F.count(F.when(~F.col("_gap"), 1)).alias("prefix"))
