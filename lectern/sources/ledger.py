"""Ledgers of verified evidence: JSON lines that are strict, or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import ids

#: Fields of a line, its schema version, signals and states, prefixes of identifiers with their fields.
FIELDS, VERSION = ("paper_identifier", "signal_name", "state", "source", "source_record_id"), "paper-quality-evidence-v1"
SIGNALS, STATES = ("retraction_status", "duplicate_risk"), ("clear", "flagged")
PREFIXES = {"doi": "doi", "arxiv": "arxiv_id", "openalex": "openalex_id", "s2": "semantic_scholar_id", "s2orc": "s2orc_corpus_id", "pmid": "pubmed_id"}
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: One object whose values are all strings, with nothing behind it.
FLAT = rf"^\s*\{{\s*(?:{STRING}\s*:\s*{STRING}\s*(?:,(?=\s*\")\s*|(?=\}})))*+\}}\s*$"


class LedgerError(ValueError):
    """A ledger has lines that are not valid evidence."""


def canonical(identifier: Column) -> Column:
    """Whether an identifier is prefix:value with a known prefix and the value in its normal form."""
    value = F.regexp_extract(identifier, r"^[^:]*:([\s\S]*)$", 1)
    own = F.lit(None).cast("string")
    for prefix, field in PREFIXES.items():
        own = F.when(F.substring_index(identifier, ":", 1) == prefix, ids.normalised(field, value)).otherwise(own)
    return F.coalesce(own == value, F.lit(False))


def read(lines: DataFrame) -> DataFrame:
    """lines (line, value) to (line, FIELDS, problem); blank lines have no row.

    problem is null for valid evidence, else invalid_line (no JSON object, a repeated key, anything but strings in it), schema_invalid (a field that is missing, unknown,
    empty or of no known value), identifier_invalid, or duplicate_signal: a paper and signal that an earlier valid line has, so that no line wins by order.
    """
    v = F.try_parse_json("value")
    keys = F.json_object_keys("value")
    d = lines.where(F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s", " ")) != "").select("line", "value", v.alias("_v"), keys.alias("_keys"))
    d = d.select("line", "_v", "_keys", F.coalesce(F.col("value").rlike(FLAT) & F.col("_v").isNotNull(), F.lit(False)).alias("_whole"))
    d = d.select("line", "_whole", "_keys", *[F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in (*FIELDS, "schema_version")])
    known = (F.size(F.array_except("_keys", F.array(*map(F.lit, (*FIELDS, "schema_version"))))) == 0) & (F.coalesce("schema_version", F.lit(VERSION)) == VERSION)
    for f in FIELDS:
        known = known & (F.coalesce(f, F.lit("")) != "")
    known = known & F.col("signal_name").isin(*SIGNALS) & F.col("state").isin(*STATES)
    problem = F.when(~F.col("_whole"), "invalid_line").when(~F.coalesce(known, F.lit(False)), "schema_invalid").when(~canonical(F.col("paper_identifier")), "identifier_invalid")
    d = d.select("line", *FIELDS, problem.alias("problem"))
    first = d.where("problem IS NULL").groupBy("paper_identifier", "signal_name").agg(F.min("line").alias("_first"))
    d = d.join(first, ["paper_identifier", "signal_name"], "left")
    again = F.col("problem").isNull() & (F.col("line") > F.col("_first"))
    return d.select("line", *FIELDS, F.when(again, "duplicate_signal").otherwise(F.col("problem")).alias("problem"))


def verified(lines: DataFrame) -> DataFrame:
    """The evidence of a ledger in which every line is valid; a LedgerError names the first that is not, and an empty ledger is refused too."""
    d = read(lines)
    bad = d.agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line"))).alias("problem"), F.min(F.when(F.col("problem").isNotNull(), F.col("line"))).alias("line"), F.count(F.lit(1)).alias("n")).first()
    if bad["line"] is not None:
        raise LedgerError(f"{bad['problem']}:{bad['line']}")
    if not bad["n"]:
        raise LedgerError("empty")
    return d.drop("problem")
