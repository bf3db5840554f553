"""Column functions over scholarly identifiers. Empty results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import title_key

#: Identifier fields and the prefixes of their keys, in order of preference for a canonical id.
PREFIX = {"doi": "doi", "arxiv_id": "arxiv", "openalex_id": "openalex", "semantic_scholar_id": "s2", "s2orc_corpus_id": "s2orc", "pubmed_id": "pmid"}


def _set(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def doi(x: Column) -> Column:
    t = F.regexp_replace(F.substring_index(F.lower(F.trim(x)), "?", 1), "[/.]+$", "")
    return _set(F.regexp_replace(F.regexp_replace(t, r"^(https?://(dx\.)?doi\.org/|doi:)", ""), "[/.]+$", ""))


def arxiv(x: Column) -> Column:
    t = F.regexp_replace(F.substring_index(F.lower(F.trim(x)), "?", 1), "/+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^.*arxiv\.org/(abs|pdf)/", ""), r"^(arxiv:)?(abs/)?(pdf/)?", "")
    return _set(F.regexp_replace(F.regexp_replace(t, r"\.pdf$", ""), r"v\d+$", ""))


def simple(x: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(x)), "/+$", "")
    t = F.when(F.contains(t, F.lit("://")), F.regexp_replace(F.regexp_replace(t, "[?#].*$", ""), "/+$", "")).otherwise(t)
    last = F.element_at(F.split(t, "/"), -1)
    return _set(F.regexp_replace(last, r"^(openalex:)?(s2:)?(pmid:)?(pubmed:)?(semantic_scholar:)?(semantic-scholar:)?(semanticscholar:)?(corpusid:)?(paper:)?", ""))


def s2orc(x: Column) -> Column:
    return _set(F.regexp_replace(F.trim(x), C.S2ORC_PATTERN, ""))


def normalised(field: str, x: Column) -> Column:
    return {"doi": doi, "arxiv_id": arxiv, "s2orc_corpus_id": s2orc}.get(field, simple)(x)


def title_year(title: Column, year: Column) -> Column:
    key = title_key(title)
    return F.when((key != "") & year.isNotNull(), F.concat_ws(":", F.lit("title_year"), key, year.cast("string")))


def keys(row: dict[str, Column]) -> Column:
    """All keys prefix:value of the given identifier columns; an arXiv DOI is an arXiv id too."""
    found = [F.concat(F.lit(p + ":"), normalised(f, row[f])) for f, p in PREFIX.items() if f in row]
    if "doi" in row:
        d = doi(row["doi"])
        found.append(F.when(d.startswith("10.48550/arxiv."), F.concat(F.lit("arxiv:"), arxiv(F.substring(d, 16, 1000)))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def canonical(row: dict[str, Column], title: Column, year: Column) -> Column:
    """arXiv by DOI, then DOI, arXiv, OpenAlex, S2, S2ORC, PubMed, then title and year."""
    order = []
    if "doi" in row:
        d = doi(row["doi"])
        order += [F.when(d.startswith("10.48550/arxiv."), F.concat(F.lit("arxiv:"), arxiv(F.substring(d, 16, 1000))))]
    order += [F.concat(F.lit(p + ":"), normalised(f, row[f])) for f, p in PREFIX.items() if f in row]
    return F.coalesce(*order, title_year(title, year))
