"""Boolean retrieval: documents that satisfy every clause of a query, a clause being alternatives of which one is enough.

An alternative is a term or a phrase, whose words must follow each other. Clauses of one alternative are musts: they are never
relaxed. Nothing is scored before the last clause.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lectern.functions import constants as C
from lectern.functions import text as T
from lectern.shared import materialize

from .retrieval import CELLS, few


def phrases(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(phrase, doc): documents (doc, tokens) that hold a phrase (phrase, words), each pair once. One pass over the texts: only words of phrases
    go on, those of longer ones with their places, which must be those of one start."""
    parts = materialize(wanted.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term")), "parts")
    near = F.broadcast(parts) if few(parts) else parts
    start = F.when(F.col("n") > 1, F.col("pos") - F.col("offset"))
    said = docs.select("doc", F.posexplode("tokens").alias("pos", "term")).join(near, "term").groupBy("doc", "phrase", "n", start.alias("start"))
    return said.agg(F.count(F.lit(1)).alias("found")).where("n = 1 OR found = n").select("doc", "phrase").distinct()


def _said(shared):
    """(doc, found): numbers of the phrases that a text (doc, hashes of words) holds, by the sums of hashes of its stretches of each length."""
    def run(batches):
        by, tables, wide = shared.value
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            word = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
            held = [np.zeros(0, np.int64)]
            for n, (known, number) in tables.items():
                at = np.arange(max(0, len(word) - n + 1))
                h = np.zeros(len(at), np.uint64)
                for j in range(n):
                    h += word[j:j + len(at)] * by[j]
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ok = (known[i] == h) & (at + n <= end[:len(at)])
                held.append(np.unique(row[:len(at)][ok] * wide + number[i[ok]]))
            held = np.unique(np.concatenate(held))
            own, many = np.unique(held // wide, return_counts=True)
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(held % wide))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), found], [b.schema.names[0], "found"])
    return run


def _met(shared):
    """(doc, q, m): the queries all of whose clauses a document (doc, found) meets, and how many alternatives of each it holds; so many documents at
    a time as keep their counts by clause within CELLS."""
    def run(batches):
        start, slot, first, clauses, ids = shared.value
        wide = int(first[-1])
        step = max(1, CELLS // wide)
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            phrase = b.column(1).flatten().to_numpy()
            for i in range(0, b.num_rows, step):
                j = min(i + step, b.num_rows)
                p, row = phrase[ends[i]:ends[j]], np.repeat(np.arange(j - i), np.diff(ends[i:j + 1]))
                n = start[p + 1] - start[p]
                at = np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held = np.bincount(np.repeat(row, n) * wide + slot[at], minlength=(j - i) * wide).reshape(j - i, wide)
                d, q = np.nonzero(np.add.reduceat(held > 0, first[:-1], axis=1, dtype=np.int64) == clauses)
                m = np.add.reduceat(held, first[:-1], axis=1)[d, q]
                own, many = np.unique(d, return_counts=True)
                to = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
                lists = [pa.ListArray.from_arrays(to, pa.array(x.astype(np.int64))) for x in (ids[q], m)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(own)), *lists], [b.schema.names[0], "q", "m"])
    return run


def _gathered(c: DataFrame, asked: DataFrame, docs: DataFrame, whole: bool = False) -> tuple[DataFrame, list]:
    """(doc, q, m) of clauses few enough for each task, and the ids of queries that the places in q stand for; with `whole`, q has the ids themselves."""
    spark = docs.sparkSession
    words = c.where("phrase <> ''").select("phrase", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).distinct().collect()  # at most ASKED_ROWS, of the queries alone
    rows = asked.select("query_id", "clause", "phrase", "clauses").orderBy("query_id", "clause").collect()
    number = {r["phrase"]: i for i, r in enumerate(words)}
    longest = max((len(r["h"]) for r in words), default=1)
    by = np.random.default_rng(longest).integers(1 << 62, size=longest).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    tables = {}
    for n in sorted({len(r["h"]) for r in words}):
        own = [i for i, r in enumerate(words) if len(r["h"]) == n]
        h = (np.array([words[i]["h"] for i in own], np.int64).view(np.uint64) * by[:n]).sum(axis=1, dtype=np.uint64)
        order = np.argsort(h)
        tables[n] = h[order], np.array(own)[order]
    slots, first, clauses, ids, pairs = {}, [], [], [], []
    for r in rows:
        if not ids or ids[-1] != r["query_id"]:
            ids.append(r["query_id"]), first.append(len(slots)), clauses.append(r["clauses"])
        at = slots.setdefault((len(ids), r["clause"]), len(slots))
        if r["phrase"] != "":
            pairs.append((number[r["phrase"]], at))
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    start = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    key = docs.schema["doc"]
    near = spark.sparkContext.broadcast((by, tables, max(1, len(words))))
    text = docs.where(F.col("doc").isNotNull()).select("doc", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t"))
    said = text.mapInArrow(_said(near), StructType([key, StructField("found", ArrayType(LongType()))]))
    held = materialize(said.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")), "phrases", rows=1024, mb=4)  # phrases of one document
    if not ids:
        return spark.createDataFrame([], StructType([key, StructField("q", ArrayType(LongType())), StructField("m", ArrayType(LongType()))])), ids
    near = spark.sparkContext.broadcast((start, pairs[:, 1], np.array([*first, len(slots)]), np.array(clauses), np.array(ids, np.int64) if whole else np.arange(len(ids))))
    return held.mapInArrow(_met(near), StructType([key, StructField("q", ArrayType(LongType())), StructField("m", ArrayType(LongType()))])), ids


def _clauses(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = clauses.withColumn("words", T.tokens(F.col("alternative"))).withColumn("phrase", F.array_join("words", " ")).where(F.col("query_id").isNotNull())
    asked = c.select("query_id", "clause", "phrase").distinct().join(c.groupBy("query_id").agg(F.count_distinct("clause").alias("clauses")), "query_id")
    return c, materialize(asked.withColumn("term", F.col("phrase")), "clauses")


def matching(clauses: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc, alternatives): documents (doc, tokens) that satisfy all clauses (query_id, clause, alternative) of a query, and how
    many different alternatives each holds. An alternative without words is never found; a clause of such alone fails. Documents without
    an id match nothing. Where clauses are few enough for each task, a text's phrases are found in its row and clauses are counted for a
    block of documents as arrays, so no task holds a table of queries and documents; beyond, they are joined and grouped."""
    c, asked = _clauses(clauses)
    if few(asked):
        met, ids = _gathered(c, asked, docs)
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), StructType([StructField("q", LongType()), asked.schema["query_id"]]))
        pairs = met.select("doc", F.explode(F.arrays_zip("q", "m")).alias("x")).select("doc", "x.q", F.col("x.m").alias("alternatives"))
        return pairs.join(F.broadcast(names), "q").select("query_id", "doc", "alternatives")
    found = materialize(phrases(docs.where(F.col("doc").isNotNull()), c.where("phrase <> ''").select("phrase", "words").distinct()), "phrases")
    held = found.repartition("doc").join(asked.drop("term"), "phrase").groupBy("query_id", "doc", "clauses", "clause").agg(F.count(F.lit(1)).alias("held"))
    both = held.groupBy("query_id", "doc", "clauses").agg(F.count(F.lit(1)).alias("met"), F.sum("held").alias("alternatives"))
    return both.where("met = clauses").select("query_id", "doc", "alternatives")


def matching_by_doc(clauses: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, q, m): what `matching` finds, a row for each document with its query ids (whole numbers) and their alternatives."""
    c, asked = _clauses(clauses)
    if few(asked):
        return _gathered(c, asked, docs, True)[0]
    found = matching(clauses, docs).groupBy("doc").agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("q"), F.col("alternatives").alias("m"))).alias("p"))
    return found.select("doc", "p.q", "p.m")


def _plain(c: Column) -> Column:
    """A term as an expression may hold it: without signs of the query language, in single blanks."""
    t = F.regexp_replace(c, r"""[(){}\[\]:;!?*^~\\"'`,|&=<>/]+""", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_+#.\-\s]+", " "), r"\s+", " "))


def _clause(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(" ")), F.concat(F.lit('all:"'), c, F.lit('"'))).otherwise(F.concat(F.lit("all:"), c))


def expression(alternatives: Column, musts: Column, limit: int = C.DISJUNCTIVE_LENGTH) -> Column:
    """`(all:a OR all:b) AND all:c`: so many of the first alternatives as keep the expression within the limit, and every must,
    whatever its length. Terms that are musts are no alternatives; empty terms are left out."""
    clean = lambda a: T.ordered_distinct(F.transform(a, _plain))
    required = F.transform(clean(musts), _clause)
    keys = F.transform(clean(musts), lambda x: F.lower(x))
    options = F.transform(F.filter(clean(alternatives), lambda x: ~F.array_contains(keys, F.lower(x))), _clause)

    def joined(parts):
        group = F.when(F.size(parts) > 0, F.array(F.concat(F.lit("("), F.array_join(parts, " OR "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(group, required), " AND ")

    prefixes = F.transform(F.sequence(F.lit(0), F.size(options)), lambda n: F.slice(options, F.lit(1), n))
    fits = F.filter(prefixes, lambda p: (F.size(p) == 0) | (F.length(joined(p)) <= limit))  # prefixes only grow
    return joined(F.element_at(fits, -1))
