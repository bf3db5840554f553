"""Saved indexes that a later session checks before it uses them: postings, lengths, and a manifest of what they were made from."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class IndexMismatch(ValueError):
    """A saved index does not belong to these documents or parameters, or is not whole."""


def row_digest(*fields: str) -> Column:
    """60 bits of the SHA-256 of a row: every field as its length and value, so that no two rows read alike; nulls apart from empty text."""
    each = [F.when(F.col(f).isNull(), "n").otherwise(F.concat(F.lit("s"), F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string"))) for f in fields]
    return F.conv(F.substring(F.sha2(F.concat(*each), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(docs: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """(by, n, digest) of documents: their number and the sum of their digests, which do not depend on order or partitions. Rows that repeat count as
    often as they stand."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_digest(*fields)), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def _made_from(docs: DataFrame, tokenizer: str) -> dict:
    r = fingerprint(docs, ["doc", "text"]).first()
    return {"version": VERSION, "tokenizer": tokenizer, "documents": r["n"], "digest": r["digest"]}


def save(docs: DataFrame, tokens: Column, path: str, tokenizer: str) -> None:
    """Writes an index of docs (doc, text): postings (doc, term, tf) sorted by term, lengths (doc, dl), then the manifest, so that a
    broken run leaves none. `tokenizer` names how tokens are made."""
    spark = docs.sparkSession
    t = docs.select("doc", tokens.alias("tokens"))
    t.select("doc", F.size("tokens").alias("dl")).write.parquet(f"{path}/lengths")
    post = docs.select("doc", F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    post.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
    made = _made_from(docs, tokenizer) | {"postings": spark.read.parquet(f"{path}/postings").count()}
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str, docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a saved index, once its manifest agrees with the documents, the tokenizer and what is stored."""
    try:
        made = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise IndexMismatch(f"no manifest in {path}") from e
    post, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    now = _made_from(docs, tokenizer) | {"postings": post.count()}
    wrong = [k for k in now if made.get(k) != now[k]]
    if wrong or lengths.count() != now["documents"]:
        raise IndexMismatch("differs in " + ", ".join(wrong or ["lengths"]))
    return post, lengths


def load_or_save(docs: DataFrame, tokens: Column, path: str, fresh: str, tokenizer: str) -> tuple[DataFrame, DataFrame, bool]:
    """(postings, lengths, reused): the index at `path` if it is that of these documents, else one written to `fresh`."""
    spark = docs.sparkSession
    try:
        return (*load(spark, path, docs, tokenizer), True)
    except IndexMismatch:
        save(docs, tokens, fresh, tokenizer)
        return (*load(spark, fresh, docs, tokenizer), False)
