"""Connected components and citation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import materialize


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; every step is a grouped minimum (combined before
    the shuffle) and a join, and its result is written to the shared folder. Only a count and a
    checksum reach the driver. Null ends and loops are ignored; a node in no edge has no row.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v"))
        if large:
            both = both.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(rounds):
        e = materialize(star(star(e, True), False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def references(seeds: DataFrame, edges: DataFrame, per_seed: int = 15, total: int = 50) -> DataFrame:
    """One hop from the seeds (query_id, doc, rank) over edges (doc, ref): (query_id, doc, ref), at most `per_seed`
    of a seed and `total` of a query, in the order of seed rank and ref. These limits are the feature."""
    j = seeds.join(edges, "doc")
    nth = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("ref"))
    j = j.withColumn("nth", nth).where(F.col("nth") <= per_seed)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc", "ref"))
    return j.withColumn("place", place).where(F.col("place") <= total).select("query_id", "doc", "ref")


def citation_nodes(ranked: DataFrame, expanded: DataFrame) -> DataFrame:
    """(query_id, doc, kind): ranked documents and what they refer to, each once."""
    n = ranked.select("query_id", "doc", F.lit("ranked").alias("kind")).unionByName(expanded.select("query_id", F.col("ref").alias("doc"), F.lit("reference").alias("kind")))
    return n.groupBy("query_id", "doc").agg(F.when(F.bool_or(F.col("kind") == "ranked"), "ranked").otherwise("reference").alias("kind"))
