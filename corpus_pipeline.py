"""The corpus pipeline: five operators over documents, each stage written and reread by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, common, mixing, simhash, suffix, toxicity

#: A document with at least this score is rejected.
TOXIC = 0.7
#: The columns of documents that stages read; others travel under names that no operator uses.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """A stage that other columns, whatever their names, pass through unchanged."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"aside_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        back = {v: k for k, v in aside.items()}
        clash = [c for c in out.columns if c in aside]  # a new column stands for an old one of its name
        return out.drop(*[aside[c] for c in clash]).withColumnsRenamed({v: k for v, k in back.items() if k not in clash})
    return run


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the scorer learns from the labels that are not held out.

    Null and empty texts score as texts without evidence and stay. A very long text is scored whole. Repeated rows, and
    ties in score, are judged alike; a null doc_id is scored like any other but never learnt from. Without labels
    of both classes everything stays; an empty table stays empty.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest doc_id.

    Null, empty and blank texts are one group. Of rows that repeat an id one stays; of rows without an id one of each fingerprint,
    unless a row with an id has the same. Long texts count whole; an empty table stays empty.
    """
    return simhash.keep_one(docs)


@apart
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier; n_chars follows the text.

    A null text becomes an empty one; shorter texts stay. The earlier of two places is that of the smaller doc_id, null ids
    last; rows that repeat id and text are one document, so none of them is cut for the other. What is left of a cut character
    goes too. Long texts are cut in overlapping pieces; an empty table stays empty.
    """
    cut = suffix.remove_repeats(docs, characters=True).withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document stands as often as the mix takes it, three times at most.

    Texts without words, null and empty ones too, weigh nothing and are drawn like any other. Null sources are one source, the
    last. Rows that share id, source and size draw alike; ties in rank go to the smaller doc_id, so that reruns agree. Long texts
    are taken whole. An empty table stays empty.
    """
    return mixing.repeat_documents(docs, mixing.mix(docs))


@apart
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit) and digests of ids and of what they decode to, without the text.

    Null texts are encoded as empty ones, which have no tokens; repeated rows alike; long texts whole; an empty table gives no
    rows. Columns named n_tokens, ids, ids_sha256 or decoded_sha256 are replaced.
    """
    t = bpe.round_trip(docs, bpe.vocabulary_path())
    return t.select(*[c for c in docs.columns if c not in ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256")], "ids", *bpe.digests(t))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]
#: Suffix passes, fingerprints and token merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
