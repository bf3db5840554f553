"""Ranked lexical search over postings: a table of (term, document) rows, dealt out by term and part of the documents.

Scores are integers, so that no order of summing changes a ranking. The terms of the items join the postings, every match is
scored, scores are summed for each item and document, and a window takes the first k.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Parts into which the postings of a term are dealt, so that a term of every document is no single task's.
PARTS = 16
#: Rows and bytes up to which the terms of all items are broadcast; beyond, they are joined by shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Bytes of UTF-8 as terms have them: A-Z lower-cased, other ASCII signs but digits and letters as blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _counted(batches):
    """(row, doc_id, n, terms, counts) of (row, doc_id, text)."""
    for b in batches:
        n, offsets, terms, counts = [], [0], [], []
        for text in b.column(2):
            data = text.as_buffer()
            c = Counter(data.to_pybytes().translate(FOLD).split() if data else ())
            n.append(c.total())
            terms.extend(c)
            counts.extend(c.values())
            offsets.append(len(terms))
        at = pa.array(offsets, pa.int32())
        lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "counts"])


def counted(docs: DataFrame) -> DataFrame:
    """One row for each document: row (a number of its own), doc_id, n (its terms with repeats), its terms and their counts.

    Texts are read whole; null ones have no terms. Rows that repeat an id are documents of their own, null ids too; other columns
    do not matter.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.materialize(d.mapInArrow(_counted, "row long, doc_id long, n long, terms array<string>, counts array<long>"), "terms", rows=1000)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows that repeat an item_id, or lack one, are one item."""
    t = items.select("item_id", F.explode(F.array_distinct(F.split(
        F.trim(F.regexp_replace(common.lower_ascii(F.col("text").cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " "))).alias("term"))
    return common.materialize(t.where("term <> ''").distinct(), "items")


def is_small(asked: DataFrame) -> bool:
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def postings(docs: DataFrame, asked: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(term, part, row, doc_id, n, tf), written by term and part of the documents and sorted by term.

    asked: only the terms that stand in this table are kept, before anything is shuffled where it is small.
    """
    p = docs.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    p = p.select(F.col("x.terms").alias("term"), F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int").alias("part"), "row", "doc_id", "n", F.col("x.counts").alias("tf"))
    if asked is not None:
        known = asked.select("term").distinct()
        p = p.join(F.broadcast(known) if small else known, "term", "left_semi")
    return common.materialize(p.repartition("term", "part").sortWithinPartitions("term"), "postings")


def search(items: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ties by doc_id, null ids last.

    N documents have a term, L is the number of all their terms, n of one's; df documents hold a term, tf times one of them.
    w = floor(1000 ln((2N+2)/(2df+1))), m = 10 + (90nN div L), score = sum of w (10^9 tf div (1000 tf + 8m)).
    Items without terms or matches have no rows; nor has an empty table. Repeated rows are documents of their own.
    """
    asked = item_terms(items)
    small = is_small(asked)
    known = counted(docs)
    n_docs, length = known.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = postings(known, asked, small)
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    weights = common.materialize(found.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")), "weights")
    at = F.broadcast if small else lambda f: f
    scored = found.join(at(weights), "term") if small else _by_part(found, weights)
    scored = scored.withColumn("m", F.expr(f"10 + ((90L * n * {n_docs}L) div {max(1, length)}L)"))
    scored = scored.select("term", "part", "row", "doc_id", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("s"))
    if small:  # documents meet before items are dealt to them, so that sums need no further shuffle
        matched = scored.repartition("row").join(F.broadcast(asked), "term")
    else:
        matched = _by_part(scored, asked)
    sums = matched.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.sum("s").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _by_part(found: DataFrame, terms: DataFrame) -> DataFrame:
    """found joined with terms, of which every part of the documents gets a copy."""
    return found.join(terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["term", "part"])


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "benchmark"), common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN asked USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
