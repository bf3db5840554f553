"""Mixing sources to target weights: certain whole copies, then Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
BINS = 4096


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> plus target: all words shared by weight, at most max_repeat times a source's size.

    Weights repeat over the sources by code point, null last. Capping and resharing until none is above its
    cap fills sources in the order of cap per weight; the level is where what is left is spread evenly.
    One row for each source: windows over this table see no document.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = totals.select("source", "source_size", w.alias("w")).withColumn("cap", max_repeat * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    s = s.withColumn("line", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("line")).alias("target"))


def words():
    """The number of words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD_RE)), F.lit(0)).cast("long")


def uniform(key, seed: str = SEED):
    """A number strictly between 0 and 1 from the key's text: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Every document gets the whole part of its source's repetition rate as certain copies. For the rest, a
    document's inclusion probability is the rate's fraction, tilted towards longer texts (the tilt sums to
    zero over the source's words), and documents enter by rising Pareto rank u/(1-u) over p/(1-p) until the
    source's remaining words are reached; the last one enters if that brings the total nearer.
    The cut is found without sorting a source: words are summed per source and rank bin, and only the bin
    that holds the cut is ordered.
    Null texts have size 0, a null source is a source, a null doc_id draws as the text "null"; rows that
    share a doc_id draw alike and are ordered by size; ties in rank go to the smaller doc_id.
    An empty table gives no rows; extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"))
    base = common.materialize(base.withColumn("u", uniform(F.col("doc_id"), seed)).withColumn("tilt", F.floor(F.lit(1000) * F.col("size") / (F.col("size") + 512))), "sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("tilt") * F.col("size")).alias("tilted"))
    totals = common.materialize(totals, "totals")
    plan = source_targets(totals.select("source", "source_size"), weights, max_repeat)
    plan = plan.alias("a").join(totals.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "b.tilted")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (plan.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("f", F.col("rate") - F.col("whole"))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("mean", F.when(F.col("source_size") > 0, F.col("tilted") / F.col("source_size")).otherwise(0.0)))
    plan = common.materialize(plan.select("source", "source_size", "target", "whole", "f", "rest", "mean"), "plan")

    def ranked(plan: DataFrame) -> DataFrame:
        p = F.col("f") * (1 + (1 - F.col("f")) * ((F.col("tilt") - F.col("mean")) / 1000))
        odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
        d = base.alias("a").join(plan.withColumnRenamed("source", "s").alias("b"), F.expr("a.source <=> b.s")).drop("s")
        return d.withColumn("q", F.when(F.col("f") > 0, odds)).withColumn("bin", F.floor(F.lit(BINS) * F.col("q") / (1 + F.col("q"))))

    bins = ranked(plan).where("f > 0").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"))
    cut = common.materialize(cut, "cut")
    cuts = plan.alias("a").join(cut.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.*", "cut", "before")
    inside = ranked(cuts).where("bin = cut")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a running sum of the bin that holds the cut: one in 4096 of a source
    last = (inside.withColumn("upto", F.col("before") + run).where("upto - size / 2 <= rest")
            .groupBy("source").agg(F.max(F.struct("q", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "size")).alias("last")))
    last = common.materialize(last, "last")
    final = cuts.alias("a").join(last.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.*", "last")
    here = F.struct("q", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "size")
    chosen = (F.col("f") > 0) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & (here <= F.col("last"))))
    copies = (F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long")).alias("copies")
    return ranked(final).select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as `mixed` says, with the columns of docs. Rows that share id,
    source and size have the same number of copies, so these three find it."""
    n = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words")).agg(F.max("copies").alias("_copies"))
    d = docs.withColumn("_size", words())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words"))
    kept = d.join(n.where("_copies > 0"), same)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(common.table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
tilted AS (SELECT *, CAST(floor(1000 * size / (size + 512)) AS BIGINT) AS tilt FROM base),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(tilt * size) AS BIGINT) AS tilted FROM tilted GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
levels AS (
  SELECT *, 3 * source_size / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT *, CASE WHEN ratio <= level THEN CAST(3 * source_size AS DOUBLE) ELSE w * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, CASE WHEN source_size > 0 THEN tilted / source_size ELSE 0 END AS mean FROM targets),
parts AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS f, target - floor(rate) * source_size AS rest FROM rates),
odds AS (
  SELECT t.*, p.source_size, p.target, p.whole, p.f, p.rest, CASE WHEN p.f > 0 THEN p.f * (1 + (1 - p.f) * ((t.tilt - p.mean) / 1000)) END AS p
  FROM tilted t JOIN parts p ON t.source IS NOT DISTINCT FROM p.source),
ranked AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM odds),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
  whole + CASE WHEN f > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END AS copies,
  (whole + CASE WHEN f > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) * size AS taken, source
FROM summed
"""
