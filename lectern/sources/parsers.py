"""Records of four scholarly services, as columns: JSON works, JSON papers, Atom entries and article XML to one shape.

Each gives title, authors, year, venue, abstract, doi, arxiv_id, openalex_id, semantic_scholar_id, pubmed_id, landing_page,
citation_count and source. Text has single spaces; what is missing is null, a missing title is `Untitled`, a missing
abstract empty, citations at least 0. A null, or what cannot be parsed, gives only the title and the source; for XML that is
not well-formed, `error` says why.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.functions.constants import YEAR_PATTERN
from lectern.functions.text import year_of

from .corpora import inverted_abstract


def _tidy(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def _names(c: Column) -> Column:
    tidy = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(tidy, lambda x: x.isNotNull() & (x != ""))


def _shape(d: DataFrame, keep: list[str], source: str, **c: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    text = lambda k: _tidy(c.get(k, none))
    known = {f: ids.normalised(f, text(f)) for f in ("doi", "arxiv_id", "openalex_id", "semantic_scholar_id", "pubmed_id")}
    return d.select(*keep, F.coalesce(text("title"), F.lit("Untitled")).alias("title"), _names(c["authors"]).alias("authors"), c["year"].alias("year"), text("venue").alias("venue"), F.coalesce(text("abstract"), F.lit("")).alias("abstract"),
                    *[v.alias(f) for f, v in known.items()], text("landing_page").alias("landing_page"), F.greatest(F.coalesce(c.get("citations", F.lit(0)).cast("int"), F.lit(0)), F.lit(0)).alias("citation_count"), F.lit(source).alias("source"), *([c["error"].alias("error")] if "error" in c else []))


WORK = """display_name string, publication_year int, cited_by_count int, id string, doi string, authorships array<struct<author: struct<display_name: string>>>,
primary_location struct<landing_page_url: string, source: struct<display_name: string>>, ids struct<openalex: string, doi: string, arxiv: string, pmid: string>, abstract_inverted_index map<string, array<int>>"""


def works(d: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Works as JSON: abstracts are put together from positions of words; `ids` come before the record's own fields."""
    w = d.withColumn("_w", F.from_json(json, WORK))
    of = lambda p: F.col(f"_w.{p}")
    return _shape(w, keep, "openalex", title=of("display_name"), authors=F.transform(of("authorships"), lambda a: a["author"]["display_name"]), year=of("publication_year"), venue=of("primary_location.source.display_name"),
                  abstract=F.when(of("abstract_inverted_index").isNotNull(), inverted_abstract(of("abstract_inverted_index"))), doi=F.coalesce(of("ids.doi"), of("doi")), openalex_id=F.coalesce(of("ids.openalex"), of("id")),
                  arxiv_id=of("ids.arxiv"), pubmed_id=of("ids.pmid"), landing_page=F.coalesce(F.nullif(F.trim(of("primary_location.landing_page_url")), F.lit("")), of("ids.openalex"), of("id")), citations=of("cited_by_count"))


PAPER = "title string, year string, venue string, abstract string, paperId string, url string, citationCount int, authors array<struct<name: string>>, externalIds map<string, string>"


def papers(d: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Papers as JSON with a map of external ids."""
    p = d.withColumn("_p", F.from_json(json, PAPER))
    of = lambda x: F.col(f"_p.{x}")
    ext = lambda k: of("externalIds")[k]
    return _shape(p, keep, "semantic_scholar", title=of("title"), authors=F.transform(of("authors"), lambda a: a["name"]), year=year_of(of("year")), venue=of("venue"), abstract=of("abstract"), doi=ext("DOI"), arxiv_id=ext("ArXiv"),
                  semantic_scholar_id=of("paperId"), pubmed_id=ext("PubMed"), landing_page=F.coalesce(F.nullif(F.trim(of("url")), F.lit("")), of("paperId")), citations=of("citationCount"))


def _within(e: ET.Element, path: str) -> str | None:
    """The text of the first element at the path, what is nested in it too."""
    found = e.find(path)
    return None if found is None else "".join(found.itertext())


def _entry(e: ET.Element) -> dict:
    link = _within(e, "{*}id")
    return {"title": _within(e, "{*}title"), "authors": [_within(x, "{*}name") for x in e.findall("{*}author")], "year": _within(e, "{*}published") or _within(e, "{*}updated"), "venue": _within(e, "{*}journal_ref"),
            "abstract": [_within(e, "{*}summary")], "doi": _within(e, "{*}doi"), "id": link}


def _person(author: ET.Element) -> str | None:
    group, last, first = (_within(author, p) for p in ("CollectiveName", "LastName", "ForeName"))
    if group and group.strip():
        return group
    return " ".join(x for x in (first or _within(author, "Initials"), last) if x) if last and last.strip() else None


def _article(e: ET.Element) -> dict:
    years = [_within(e, f".//{p}") for p in ("ArticleDate/Year", "JournalIssue/PubDate/Year", "PubMedPubDate/Year", "JournalIssue/PubDate/MedlineDate")]
    ids = [x for path, kind in ((".//ArticleIdList/ArticleId", "IdType"), (".//ELocationID", "EIdType")) for x in e.findall(path) if x.get(kind, "").lower() == "doi"]
    venues = [v for p in ("Title", "ISOAbbreviation") if (v := _within(e, f".//Journal/{p}")) and v.strip()]
    return {"title": _within(e, ".//Article/ArticleTitle"), "authors": [_person(a) for a in e.findall(".//AuthorList/Author")], "year": next((y for y in years if y and YEAR.search(y)), None), "venue": next(iter(venues), None),
            "abstract": ["".join(a.itertext()) for a in e.findall(".//Abstract/AbstractText")], "doi": next(("".join(x.itertext()) for x in ids), None), "id": _within(e, ".//MedlineCitation/PMID")}


YEAR = re.compile(YEAR_PATTERN)
_FIELDS = "title string, authors array<string>, year string, venue string, abstract array<string>, doi string, id string, error string"


def _read(xml: Column, of) -> Column:
    """A struct of the fields that `of` takes from the root of each document, or of an error alone."""
    def parsed(text: str | None) -> dict:
        try:
            return {} if text is None else of(ET.fromstring(text))
        except ET.ParseError as e:
            return {"error": str(e)}

    @F.pandas_udf(_FIELDS)
    def fields(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        return pd.DataFrame([[x.get(n) for n in names] for x in map(parsed, texts)], columns=names, dtype=object)

    return fields(xml)


def entries(d: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Atom entries: the venue is the journal reference, else `arXiv`; the id's version goes."""
    of = lambda p: F.col(f"_x.{p}")
    return _shape(d.withColumn("_x", _read(F.col(xml), _entry)), keep, "arxiv", title=of("title"), authors=of("authors"), year=year_of(of("year")), venue=F.coalesce(_tidy(of("venue")), F.when(of("error").isNull(), "arXiv")),
                  abstract=F.array_join(of("abstract"), " "), doi=of("doi"), arxiv_id=F.regexp_extract(of("id"), r"abs/(.+)$", 1), landing_page=of("id"), error=of("error"))


def articles(d: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Article XML: an author is a collective name, or fore name (else initials) and last name, or the last name alone; the parts of
    an abstract are joined, with the text of their markup; the journal's title or abbreviation, else `PubMed`; the year of
    the article, else of the issue, of its history, of a date in words."""
    of = lambda p: F.col(f"_x.{p}")
    pmid = F.nullif(F.trim(of("id")), F.lit(""))
    return _shape(d.withColumn("_x", _read(F.col(xml), _article)), keep, "pubmed", title=of("title"), authors=of("authors"), year=year_of(of("year")), venue=F.coalesce(_tidy(of("venue")), F.when(of("error").isNull(), "PubMed")),
                  abstract=F.array_join(_names(of("abstract")), " "), doi=of("doi"), pubmed_id=pmid, landing_page=F.when(pmid.isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))), error=of("error"))
