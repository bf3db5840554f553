"""Leakage, independence and reliability audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.functions import text as T
from lectern.shared import materialize

from .graph import components


def leakage(queries: DataFrame, gold: DataFrame, least_tokens: int = 5, coverage: float = 0.8) -> DataFrame:
    """(query_id, doc, level) of query (query_id, text) and gold (query_id, doc, title) pairs: full_title, title_coverage or none.

    Titles under 24 characters or 3 tokens are not searched for; coverage needs `least_tokens` distinct tokens.
    """
    q = queries.select("query_id", T.tokens(F.col("text")).alias("q"))
    g = gold.select("query_id", "doc", T.tokens(F.col("title")).alias("t"), F.length("title").alias("n"))
    own = F.array_distinct("t")
    share = F.size(F.array_intersect(own, F.col("q"))) / F.size(own)
    level = (F.when((F.col("n") >= 24) & (F.size("t") >= 3) & T.contains_sequence(F.col("q"), F.col("t")), "full_title")
             .when((F.size(own) >= least_tokens) & (share >= coverage), "title_coverage").otherwise("none"))
    return g.join(q, "query_id").select("query_id", "doc", level.alias("level"))


def _grams(n: int):
    """(key, gram) of every place of an n-gram in rows (key, hashes of words): a sum of the hashes, each times a number of its place. Fewer words count whole."""
    by = np.random.default_rng(n).integers(1 << 62, size=n + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            word = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            place = np.arange(len(word)) - start[row]
            whole = np.zeros(max(0, len(word) - n + 1), np.uint64)
            for j in range(n):
                whole += word[j:j + len(whole)] * by[j]
            at = np.flatnonzero((place + n <= size[row])[:len(whole)])
            few = np.flatnonzero((size[row] < n))
            short = np.zeros(len(size), np.uint64)
            np.add.at(short, row[few], word[few] * by[place[few]])
            some = np.flatnonzero((size > 0) & (size < n))
            gram = np.concatenate([whole[at], short[some] + size[some].astype(np.uint64) * by[n]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate([row[at], some]))), pa.array(gram)], [b.schema.names[0], "gram"])
    return run


def passage_containment(docs: DataFrame, passages: DataFrame, n: int = 13) -> DataFrame:
    """(doc, passage, hits, total): passages whose token n-grams stand in documents, found by equal n-grams.

    docs (doc, text), passages (passage, text). Distinct n-grams of passages are matched; shorter passages count whole. A text is split into
    words once, a word is hashed once, and n-grams are compared by 64 bits made from the hashes of their words.
    """
    def grams(df, key):
        t = df.select(key, F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("t"))
        return t.mapInArrow(_grams(n), StructType([t.schema[key], StructField("gram", LongType())]))

    p = materialize(grams(passages, "passage").distinct(), "passages")
    total = p.groupBy("passage").agg(F.count(F.lit(1)).alias("total"))
    hits = grams(docs, "doc").join(p, "gram").groupBy("doc", "passage").agg(F.count_distinct("gram").alias("hits"))
    return materialize(hits, "grams", rows=1024, mb=4).join(total, "passage").select("doc", "passage", "hits", "total")


def _sketch(tokens: Column) -> list[Column]:
    """256 bits as four numbers, of which each token sets one: sets that differ in d tokens have sketches that differ in d bits at most."""
    h = F.transform(tokens, lambda t: F.xxhash64(t))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    quarter = lambda j: F.filter(h, lambda x: F.pmod(F.shiftright(x, 8), F.lit(4)) == j)
    return [F.aggregate(quarter(j), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x))).alias(f"b{j}") for j in range(4)]


def similar_queries(queries: DataFrame, least: float = 0.8, tokens: int = 6) -> DataFrame:
    """(left, right, jaccard) of queries (query_id, text) with Jaccard similarity of token sets of at least `least`.

    Equal sets collapse first; a pair that is similar shares one of the rarest tokens of either set (prefix
    filter), so no pair is lost and frequent tokens are not joined. Rows of the prefixes carry sizes, places and a sketch of their
    set: where these rule a pair out it ends inside the join, and only what is left is written and compared token by token. Sets
    under `tokens` tokens are only compared for equality, which `independence` does.
    """
    sets = queries.select("query_id", F.array_sort(F.array_distinct(T.tokens(F.col("text")))).alias("s")).where(F.size("s") >= tokens)
    reps = materialize(sets.groupBy("s").agg(F.min("query_id").alias("query_id")), "sets")
    words = reps.select("query_id", F.size("s").alias("n"), F.explode("s").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "w"))
    prefix = words.join(df, "w").withColumn("i", place).where(F.col("i") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("query_id", "w", "n", "i")
    prefix = materialize(prefix.join(reps.select("query_id", *_sketch(F.col("s"))), "query_id"), "prefixes")
    apart = " + ".join(f"bit_count(a.b{j} ^ b.b{j})" for j in range(4))
    near = (f"a.w = b.w and a.query_id < b.query_id and a.n >= {least} * b.n and b.n >= {least} * a.n"
            f" and 1 + least(a.n - a.i, b.n - b.i) >= {least / (1 + least)} * (a.n + b.n) - 1e-6 and {apart} <= {(1 - least) / (1 + least)} * (a.n + b.n) + 1e-6")
    cand = prefix.alias("a").join(prefix.alias("b"), F.expr(near))
    cand = materialize(cand.select(F.col("a.query_id").alias("left"), F.col("b.query_id").alias("right")).distinct(), "candidates")
    j = cand.join(reps.select(F.col("query_id").alias("left"), F.col("s").alias("ls")), "left").join(reps.select(F.col("query_id").alias("right"), F.col("s").alias("rs")), "right")
    return j.withColumn("jaccard", F.round(T.jaccard(F.col("ls"), F.col("rs")), 6)).where(F.col("jaccard") >= least).select("left", "right", "jaccard")


def independence(queries: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(query_id, component): queries that equal texts, similar token sets or common gold (query_id, doc) connect."""
    key = F.array_join(T.tokens(F.col("text")), " ")
    first = F.min("query_id").over(Window.partitionBy("key"))
    same = queries.select("query_id", key.alias("key")).withColumn("left", first).select("left", F.col("query_id").alias("right"))
    edges = same.unionByName(similar_queries(queries).select("left", "right"))
    sets = queries.select("query_id", F.array_sort(F.array_distinct(T.tokens(F.col("text")))).alias("s")).where(F.size("s") >= 6)
    edges = edges.unionByName(sets.join(sets.groupBy("s").agg(F.min("query_id").alias("left")), "s").select("left", F.col("query_id").alias("right")))
    if shared is not None:
        edges = edges.unionByName(shared.join(shared.groupBy("doc").agg(F.min("query_id").alias("left")), "doc").select("left", F.col("query_id").alias("right")))
    roots = components(edges, "left", "right")
    return queries.select("query_id").join(roots, queries.query_id == roots.node, "left").select("query_id", F.coalesce("root", "query_id").alias("component"))


def failure_class(message: Column) -> Column:
    """The first kind that fits an error message."""
    m = F.lower(message)
    return (F.when(m.rlike("parse|json|xml|decode"), "parse_failure").when(m.rlike("http|status|429|5\\d\\d"), "http_failure")
            .when(m.rlike("timeout|connection|network|dns"), "transport_failure").when(m.rlike("provider|source"), "provider_failure").otherwise("unknown_failure"))


def query_structure(text: Column) -> Column:
    n = F.length(text)
    size = F.when(n <= 80, "short").when(n <= 160, "medium").when(n <= 320, "long").otherwise("very_long")
    return F.struct(size.alias("size"), F.contains(text, F.lit('"')).alias("quoted"), text.rlike(r"\b(AND|OR|NOT)\b").alias("boolean"), text.rlike(r"(19|20)\d{2}").alias("has_year"), text.rlike(r"[^\x00-\x7F]").alias("non_ascii"))


def completeness(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One pass over a corpus: rows, rows without an id, repeated ids, and the share of each field that is filled."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~has(key) | F.col(key).isNull(), 1)).alias("without_id"), (F.count(key) - F.count_distinct(key)).alias("repeated"),
                  *[F.round(F.avg(has(c).cast("int")), 6).alias(f"has_{c}") for c in fields])


def funnel(stages: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """(place, stage, n, lost) of stages that each keep a part of the one before; anything new is an error row."""
    from functools import reduce

    rows = [df.select(*key).distinct().agg(F.lit(i).alias("place"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for i, (name, df) in enumerate(stages)]
    d = reduce(DataFrame.unionByName, rows)
    w = Window.orderBy("place")  # a row for each stage
    return d.withColumn("lost", F.coalesce(F.lag("n").over(w) - F.col("n"), F.lit(0)))
