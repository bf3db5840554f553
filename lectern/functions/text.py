"""Column functions over text: tokenizers, normalisers, containment, query features. No UDFs but one over Arrow batches (nfkc).

`lower` stands for case folding; the two differ for the German eszett and the dotted capital I.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

TOKEN = r"[\p{L}\p{N}_]+"
YEAR = C.YEAR_PATTERN


def words_of(values) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens without academic filler, or all tokens if nothing else is left."""
    every = tokens(text)
    focused = F.filter(every, lambda t: ~F.array_contains(words_of(C.QUERY_STOPWORDS), t))
    return F.when(F.size(focused) > 0, focused).otherwise(every)


def let(value: Column, use) -> Column:
    """use(value), with value made once for each row, also where lambdas over arrays use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_distinct(values: Column) -> Column:
    """Trimmed values, the first spelling of each, empty ones dropped."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return let(trimmed, lambda t: let(F.transform(t, lambda v: F.lower(v)), lambda seen: F.filter(t, lambda v, i: F.array_position(seen, F.lower(v)) == i + 1)))


def translated(text: Column, pairs) -> Column:
    """The terms that stand for words which the text holds, in the order of the pairs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(word)), F.lit(term)) for word, term in pairs]))


def judgement_terms(text: Column) -> Column:
    """Latin words of three letters or more (and AI, ML, CV), without stop words, in order, each once."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9+.#-]*"), F.lit(0))
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")
    keep = F.filter(words, lambda w: (bare(w) != "") & ~bare(w).isin(*C.JUDGEMENT_STOPWORDS) & ((F.length(bare(w)) > 2) | bare(w).isin("ai", "ml", "cv")))
    return ordered_distinct(F.concat(F.transform(keep, lambda w: F.when(F.lower(w).isin(*C.UPPER_TERMS), F.upper(w)).otherwise(w)), translated(text, C.JUDGEMENT_TRANSLATIONS)))


def padded(text: Column) -> Column:
    """Plain tokens between single blanks, in which a whole token is found as a substring."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^a-z0-9+.#-]+", " "), F.lit(" "))


def contains_term(text: Column, term: Column, pad: Column | None = None) -> Column:
    """A whole-token hit for a plain term, else a substring. Both sides are lower-case already; pad: padded(text)."""
    plain = term.rlike(r"^[a-z0-9+.#-]+$")
    return (term != "") & F.when(plain, F.contains(padded(text) if pad is None else pad, F.concat(F.lit(" "), term, F.lit(" ")))).otherwise(F.contains(text, term))


def contained(terms: Column, text: Column) -> Column:
    """Those of the terms that contains_term finds in the text: plain ones among its tokens, which are gathered once."""
    plain = lambda t: t.rlike(r"^[a-z0-9+.#-]+$")
    tokens_ = F.split(F.regexp_replace(text, r"[^a-z0-9+.#-]+", " "), " ")
    return F.concat(F.array_intersect(F.filter(terms, plain), tokens_), F.filter(terms, lambda t: (t != "") & ~plain(t) & F.contains(text, t)))


def singular(token: Column) -> Column:
    """Plain English plurals to singulars; a result of three letters or fewer is not taken."""
    n = F.length(token)
    drop = lambda k, add="": F.concat(F.substr(token, F.lit(1), n - k), F.lit(add))
    found = (F.when(n <= 4, token)
             .when(token.endswith("ies"), drop(3, "y"))
             .when(token.rlike("(ches|shes|xes|zes|sses)$"), drop(2))
             .when(token.endswith("s") & ~token.rlike("(ss|us|is)$"), drop(1))
             .otherwise(token))
    return F.when(F.length(found) > 3, found).otherwise(token)


def lexical_tokens(text: Column) -> Column:
    """Comparable tokens: no possessives, dotted abbreviations joined, plurals to singulars."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<=[\p{L}\p{N}_])['’]s\b", "")
    t = F.regexp_replace(t, r"\b([\p{L}])\.(?=[\p{L}]\.)|(?<=\.[\p{L}])\.", "$1")
    return F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), singular)


def contains_sequence(observed: Column, expected: Column) -> Column:
    """expected stands in observed without a gap; an empty one does not."""
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(expected) > 0) & F.contains(joined(observed), joined(expected))


def title_key(title: Column) -> Column:
    """Lower-case, LaTeX commands replaced by their argument, punctuation to single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), C.LATEX_PATTERN, " $1 ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def venue_key(venue: Column) -> Column:
    return F.regexp_replace(F.lower(venue), r"[\s_-]+", "")


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def letters_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def language(text: Column) -> Column:
    cjk, latin = text.rlike(r"[\x{4e00}-\x{9fff}]"), text.rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("unknown")


def contains_any(text: Column, values) -> Column:
    return F.exists(words_of(values), lambda v: F.contains(text, v))


def intent(text: Column) -> Column:
    """The first intent one of whose patterns stands in the query."""
    t, out = F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lit("general")
    for name, patterns in reversed(C.INTENT_PATTERNS):
        out = F.when(contains_any(t, patterns), name).otherwise(out)
    return out


def domain(text: Column) -> Column:
    t = F.lower(text)
    return (F.when(contains_any(t, C.BIOMEDICAL_TERMS), "biomedical").when(contains_any(t, C.MACHINE_LEARNING_TERMS), "machine_learning")
            .when(contains_any(t, C.COMPUTER_SCIENCE_TERMS), "computer_science").otherwise("general_science"))


def time_range(text: Column, as_of_year: int) -> Column:
    """struct(start_year, end_year, label) of the first rule that fits, else null."""
    t = F.lower(text)

    def got(pattern: str, label: str, start=lambda y: y, end=None):
        hit = F.regexp_extract(t, pattern, 1)
        last = F.lit(None).cast("int") if end is None else end(pattern)
        return F.when(hit != "", F.struct(start(hit.cast("int")).cast("int").alias("start_year"), last.cast("int").alias("end_year"), F.lit(label).alias("label")))

    second = lambda p: F.regexp_extract(t, p, 2)
    now = lambda p: F.lit(as_of_year)
    recent = lambda cond, years: F.when(cond, F.struct(F.lit(as_of_year - years).cast("int").alias("start_year"), F.lit(as_of_year).cast("int").alias("end_year"), F.lit("recent").alias("label")))
    return F.coalesce(
        got(C.RANGE_PATTERN, "explicit_range", end=second),
        got(C.FROM_TO_PATTERN, "from_to", end=second),
        got(C.SINCE_PATTERN, "since"),
        got(C.AFTER_PATTERN, "after", start=lambda y: y + 1),
        got(C.LAST_YEARS_PATTERN, "recent", start=lambda y: F.lit(as_of_year) - F.greatest(F.lit(1), y), end=now),
        recent(F.contains(t, F.lit(C.LAST_THREE_YEARS)), 3),
        recent(contains_any(t, C.RECENT_MARKERS), 3))


def venues(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.filter(words_of(C.VENUES), lambda v: F.contains(padded, F.concat(F.lit(" "), F.lower(v), F.lit(" "))))


def known_terms(text: Column, values) -> Column:
    t = F.lower(text)
    return F.filter(words_of(values), lambda v: F.contains(t, v))


def dataset_terms(text: Column) -> Column:
    named = F.regexp_extract_all(text, F.lit(C.DATASET_PATTERN), F.lit(1))
    return ordered_distinct(F.concat(known_terms(text, C.DATASET_TERMS), F.filter(named, lambda n: ~F.lower(n).isin(*C.DATASET_NO_NAMES))))


def method_terms(text: Column) -> Column:
    named = F.regexp_extract_all(text, F.lit(C.METHOD_PATTERN), F.lit(1))
    clean = F.transform(named, lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda w: ~F.lower(w).isin(*C.ANALYSIS_STOPWORDS)), " "))
    return ordered_distinct(F.concat(known_terms(text, C.METHOD_TERMS), clean))


def keyword_terms(text: Column) -> Column:
    """Latin words that analysis keeps, in order, then terms for Chinese words, then the venues."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9+.#-]*"), F.lit(0))
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")
    keep = F.filter(words, lambda w: (bare(w) != "") & ~bare(w).isin(*C.ANALYSIS_STOPWORDS) & ((F.length(bare(w)) > 2) | F.upper(w).isin("AI", "ML", "CV")))
    return ordered_distinct(F.concat(F.transform(keep, lambda w: F.when(F.lower(w).isin(*C.KEYWORD_UPPER_TERMS), F.upper(w)).otherwise(w)), translated(text, C.KEYWORD_TRANSLATIONS), venues(text)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; `empty` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def retention(original: Column, kept: Column) -> Column:
    """The share of the original terms that stay; 1 if there are none."""
    low = lambda a: F.array_distinct(F.transform(a, lambda v: F.lower(v)))
    n = F.size(low(original))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(low(original), low(kept))) / n)


def short_text(text: Column, limit: int = 160) -> Column:
    return F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def snippet(abstract: Column, term: Column) -> Column:
    """The first sentence that holds the term, else the beginning."""
    marked = F.regexp_replace(F.trim(abstract), r"([.!?。！？])\s+", "$1\x01")
    hit = F.get(F.filter(F.split(marked, "\x01"), lambda s: F.contains(F.lower(s), term)), F.lit(0))
    return short_text(F.coalesce(hit, abstract))


def cut_at_word(text: Column, limit: int) -> Column:
    """At most `limit` characters, back to the last space if a word was cut."""
    part = F.substring(text, 1, limit)
    whole = F.regexp_extract(part, r"^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= limit, text).when(whole != "", F.rtrim(whole)).otherwise(part)


def year_of(text: Column) -> Column:
    y = F.regexp_extract(text, YEAR, 1)
    return F.when((y != "") & y.cast("int").between(1900, 2100), y.cast("int"))


def visible_html(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, block ends to blank lines, the usual entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(/?(p|div|section|article|h[1-6]|li|ul|ol|table|tr|blockquote|header|footer|main|pre)\b[^>]*|br\s*/?)>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return tidy(t)


def tidy(text: Column) -> Column:
    """LF line ends, no blanks at line ends, none at either end of the text."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]{2,})"'), F.lit(1))


def strip_identifiers(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+", " ")
    t = F.regexp_replace(t, r"(?i)\b10\.\d{4,9}/\S+", " ")
    return F.regexp_replace(t, r"(?i)\b(?:arxiv\s*:\s*)?(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?\b", " ")


def protected(text: Column, limit: int) -> Column:
    """struct(value, status): control signs shown as escapes, cut at the limit; preserved, normalized, escaped or truncated."""
    flat = F.regexp_replace(text, "[\r\n\t]", " ")
    shown = F.regexp_replace(flat, r"[\x00-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "\ufffd")
    status = F.when(F.length(shown) > limit, "truncated").when(shown != flat, "escaped").when(flat != text, "normalized").otherwise("preserved")
    return F.struct(F.substring(shown, 1, limit).alias("value"), status.alias("status"))


def safe_url(url: Column) -> Column:
    """The url if it is http(s) with a host and without credentials, else null."""
    host = F.regexp_extract(url, r"^https?://([^/?#]+)", 1)
    return F.when((host != "") & ~F.contains(host, F.lit("@")) & ~url.rlike(r"[\s<>\"]"), url)


def safe_message(text: Column) -> Column:
    """Messages of plain words stay; others become a code of their hash."""
    return F.when(text.rlike(r"^[A-Za-z0-9 _.:,-]{1,240}$"), text).otherwise(F.concat(F.lit("untrusted_source_error:"), F.substring(F.sha2(text, 256), 1, 16)))


def dcg_gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nfkc(text: Column) -> Column:
    """Compatibility normalisation of Unicode (NFKC). Null stays null. Batches of ASCII pass as they are; other texts go through Python's
    tables, as Arrow's own kernel takes texts apart but does not compose them again."""
    @F.arrow_udf("string")
    def normalised(a: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(a), min_count=0).as_py():
            return a
        return pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x) for x in a.to_pylist()], pa.string())

    return normalised(text.cast("string"))


def visible_query(text: Column) -> Column:
    """A query as a snapshot's key has it: NFKC, without control characters but line breaks and tabs, in single blanks. Syntax, quotes and
    order of words stay."""
    shown = F.regexp_replace(nfkc(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.trim(F.regexp_replace(shown, r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def academic_tokens(text: Column) -> Column:
    """Latin words with their inner `-_+#.` and runs of Chinese signs, of the normalised text, in order."""
    return F.regexp_extract_all(F.coalesce(nfkc(text), F.lit("")), F.lit(r"[A-Za-z0-9]+(?:[-_+#.][A-Za-z0-9]+)*|[\x{4e00}-\x{9fff}]+"), F.lit(0))
