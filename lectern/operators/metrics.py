"""Retrieval metrics over ranked lists (query_id, doc, rank) and gold (query_id, doc, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import dcg_gain


def matched(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked plus grade (null: no gold). A repeated prediction keeps its place but only the first one can match;
    gold with a grade of 0 or less is none, and a gold document counts once, with its best grade."""
    first = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank"))
    g = gold.where("grade > 0").groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))
    j = ranked.withColumn("nth", first).join(g, ["query_id", "doc"], "left")
    return j.withColumn("grade", F.when(F.col("nth") == 1, F.col("grade"))).drop("nth")


def per_query(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """One row per query: gold, mrr, and recall, precision, f1, ndcg at each k. The denominator of precision is
    k, never what was returned; without gold all are zero."""
    m = matched(ranked, gold)
    hit = F.col("grade").isNotNull()
    gain = dcg_gain(F.col("grade").cast("double"), F.col("rank"))
    aggs = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        aggs += [F.count(F.when(hit & (F.col("rank") <= k), 1)).alias(f"hits_{k}"), F.sum(F.when(hit & (F.col("rank") <= k), gain)).alias(f"dcg_{k}")]
    found = m.groupBy("query_id").agg(*aggs)
    g = gold.where("grade > 0").groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc")))
    ideal = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"ideal_{k}") for k in ks])
    j = queries.select("query_id").distinct().join(found, "query_id", "left").join(ideal, "query_id", "left")
    out = [F.col("query_id"), F.coalesce("gold", F.lit(0)).alias("gold"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr")]
    for k in ks:
        h = F.coalesce(f"hits_{k}", F.lit(0))
        recall, precision = F.coalesce(h / F.col("gold"), F.lit(0.0)), h / F.lit(float(k))
        f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
        out += [F.round(recall, 6).alias(f"recall_{k}"), F.round(precision, 6).alias(f"precision_{k}"), F.round(f1, 6).alias(f"f1_{k}"),
                F.round(F.coalesce(F.col(f"dcg_{k}") / F.col(f"ideal_{k}"), F.lit(0.0)), 6).alias(f"ndcg_{k}")]
    return j.select(*out)


def macro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric column, each query of one weight, and the sums of counts."""
    skip = {"query_id", "gold", *(by or [])}
    cols = [c for c in rows.columns if c not in skip]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), F.sum("gold").alias("gold"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def success_and_end_to_end(rows: DataFrame, failed: DataFrame, metric: str) -> DataFrame:
    """Failed queries are left out of the one mean and zero in the other."""
    j = rows.join(failed.select("query_id", F.lit(True).alias("failed")), "query_id", "left")
    bad = F.coalesce("failed", F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(bad, 1)).alias("failed"), F.round(F.avg(F.when(~bad, F.col(metric))), 6).alias("success_only"),
                 F.round(F.avg(F.when(bad, 0.0).otherwise(F.col(metric))), 6).alias("end_to_end"))


def depth_curve(ranked: DataFrame, gold: DataFrame, depths=(20, 50, 100, 200)) -> DataFrame:
    """(depth, matched, recall): matched gold down to each depth over all queries, and macro recall."""
    m = matched(ranked, gold).where("grade is not null").select("query_id", "rank")
    n = gold.where("grade > 0").groupBy("query_id").agg(F.count_distinct("doc").alias("gold"))
    d = n.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    hit = d.join(m, (d.query_id == m.query_id) & (m["rank"] <= d.depth), "left").groupBy(d.query_id, "depth", "gold").agg(F.count("rank").alias("hits"))
    return hit.groupBy("depth").agg(F.sum("hits").alias("matched"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall"))


def oracle_order(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """The same candidates with gold first: what a perfect ranker of them would reach."""
    m = matched(ranked, gold)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc_nulls_last(), "rank"))
    return m.select("query_id", "doc", place.alias("rank"))


def drop_reasons(gold: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each gold document the first of the ordered stages (name, (query_id, doc)) that lacks it: (reason, n)."""
    g, reason = gold.where("grade > 0").select("query_id", "doc").distinct(), F.lit("kept")
    for name, kept in stages:
        g = g.join(kept.select("query_id", "doc").distinct().withColumn(name, F.lit(True)), ["query_id", "doc"], "left")
    for name, _ in reversed(stages):
        reason = F.when(F.col(name).isNull(), "lost_at_" + name).otherwise(reason)
    return g.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def gold_duplicates(gold: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, cluster, doc, grade, members): gold of one identity is one, with its best grade and smallest doc; documents
    that no cluster (paper_id, cluster) names are their own."""
    g = gold.where("grade > 0").join(clusters.withColumnRenamed("paper_id", "doc"), "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc"))
    return g.groupBy("query_id", "cluster").agg(F.min("doc").alias("doc"), F.max("grade").alias("grade"), F.count_distinct("doc").alias("members"))


def matched_by_identity(ranked: DataFrame, gold: DataFrame, clusters: DataFrame) -> DataFrame:
    """ranked plus grade (null: no gold), one to one by identity: the first prediction of an identity takes its gold, with the
    best grade of it; later predictions of the same identity keep their places and match nothing."""
    r = ranked.join(clusters.withColumnRenamed("paper_id", "doc"), "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc"))
    first = F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy("rank"))
    j = r.withColumn("nth", first).join(gold_duplicates(gold, clusters).select("query_id", "cluster", "grade"), ["query_id", "cluster"], "left")
    return j.withColumn("grade", F.when(F.col("nth") == 1, F.col("grade"))).drop("nth", "cluster")
