"""Text functions: Column in, Column out, all inside the JVM. White space is Unicode's ((?U)\\s)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the sections that rank above or below others, and words kept small in titles.
SECTION_WEIGHTS = {
    "results": 1.35,
    "discussion": 1.2,
    "conclusion": 1.3,
    "conclusions": 1.3,
    "abstract": 1.1,
    "introduction": 1.0,
    "background": 1.0,
    "methods": 0.85,
    "materials_and_methods": 0.85,
    "methodology": 0.85,
    "supplementary": 0.75,
}
SMALL_WORDS = ["and", "or", "of", "in", "on", "for", "with", "to", "the", "a", "an"]
#: Names that stand for another one.
NAME_SYNONYMS = {
    "dm": "diabetes",
    "diabetes mellitus": "diabetes",
    "vte history": "prior vte",
    "history of vte": "prior vte",
    "long term braking": "immobility",
    "long-term braking": "immobility",
    "long term break": "immobility",
    "prolonged anesthesia": "surgery",
    "anesthesia duration": "surgery",
    "blood transfusion": "surgery",
    "transfusion": "surgery",
    "venous thromboembolism": "thromboembolism",
    "thromboembolic events": "thromboembolism",
}


def lookup(key: Column, table: dict) -> Column:
    """Constant table as a map literal; null where it lacks the key."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*(nonblank(c) for c in columns))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def canonical_doi(c: Column) -> Column:
    """First DOI in the text, lower case, without closing punctuation; '' without one."""
    # fixed value: what a DOI looks like inside a text
    found = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "10\\.\\d{4,9}/[^\\s\"<>]+", 0))
    return F.regexp_replace(found, "[).,;\\]}>\"']+$", "")


def doi_without_prefixes(c: Column) -> Column:
    """Lower case, without a resolver address or a doi: mark in front; the marks are tried in this order, once each."""
    out = F.lower(strip(F.coalesce(c, F.lit(""))))
    for mark in ("https://doi\\.org/", "http://doi\\.org/", "http://dx\\.doi\\.org/", "doi:"):
        out = strip(F.regexp_replace(out, f"^{mark}", ""))
    return out


def doi_without_addresses(c: Column) -> Column:
    """Without either resolver address wherever it stands (as written), then lower case."""
    out = strip(F.coalesce(c, F.lit("")))
    for address in ("https://doi.org/", "http://doi.org/"):
        out = F.replace(out, F.lit(address), F.lit(""))
    return F.lower(out)


def doi_from_plain(c: Column) -> Column:
    """The prefixes stripped from a text whose punctuation became spaces."""
    out = plain_spaced(c)
    for mark in ("https doi org ", "http doi org ", "http dx doi org ", "doi "):
        out = F.trim(F.regexp_replace(out, f"^{mark}", ""))
    return out


def plain(c: Column) -> Column:
    """Lower case, spaces squeezed, all but ASCII letters, digits and spaces deleted."""
    return F.regexp_replace(squeeze(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]+", "")


def plain_spaced(c: Column) -> Column:
    """Lower case; all but ASCII letters and digits become single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words of two characters at least."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.length(x) >= 2), F.lower)


def section_key(c: Column) -> Column:
    """Name of a section as a key: lower case, other characters to single underscores; null if nothing is left."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))
    return F.nullif(F.replace(words, F.lit(" "), F.lit("_")), F.lit(""))


def section_weight(c: Column, weights: dict[str, float] | None = None) -> Column:
    return F.coalesce(lookup(section_key(c), weights or SECTION_WEIGHTS), F.lit(1.0))


def title_key(c: Column) -> Column:
    return squeeze(F.lower(c))


def section_title(c: Column) -> Column:
    """Title case with small words inside."""
    parts = F.transform(F.split(title_key(c), " "), lambda w: F.when(w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    joined = F.array_join(parts, " ")
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1_000_000))


def truncated(c: Column, n: int | Column) -> Column:
    """At most n characters; three dots end what was cut."""
    size = F.lit(n) if isinstance(n, int) else n
    text = strip(F.coalesce(c, F.lit("")))
    cut = F.regexp_replace(F.left(text, F.greatest(size - 3, F.lit(0))), r"(?U)\s+$", "")
    return F.when(size <= 0, F.lit("")).when(F.length(text) <= size, text).when(size <= 3, F.left(text, size)).otherwise(F.concat(cut, F.lit("...")))


def capped(c: Column, n: int) -> Column:
    """At most n characters, without dots."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.left(text, F.lit(n)), r"(?U)\s+$", ""))


def canonical_name(c: Column) -> Column:
    """The name that a synonym stands for; other names keep their spelling."""
    return F.coalesce(lookup(squeeze(F.lower(c)), NAME_SYNONYMS), F.coalesce(c, F.lit("")))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("x", "yes", "true", "1", "y"), F.lit(False))


def to_int(c: Column) -> Column:
    """Whole number of a text or number, null if it isn't one; fractions are cut off."""
    return c.try_cast("double").try_cast("bigint")


def digits_to_int(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def name_list(c: Column) -> Column:
    """Trimmed names without blanks, null if none is left."""
    out = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(out) > 0, out)


def year_in(c: Column) -> Column:
    """First word of four digits."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{4})\b", 1), F.lit("")).cast("int")


def disease(*texts: Column) -> Column:
    """Topic by the words it holds; clots come before tumours."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.when(text.rlike("thrombosis|thromboembolism|vte"), "thrombosis").when(text.rlike("cancer|carcinoma|neoplasm|tumou?r|malignancy"), "cancer").otherwise("unknown")


def run_mode(name: Column) -> Column:
    """Mode by the name of a file: the one without the second query first, as its name holds the other's."""
    low = F.lower(name)
    return F.when(low.contains("rag_no_hyde"), "rag_no_hyde").when(low.contains("rag_hyde"), "rag_hyde").when(low.contains("llm_only"), "llm_only").otherwise("unknown")


def metric_label(name: Column) -> Column:
    """Names of metrics as tables print them: p@5 -> P@5, ndcg@5 -> nDCG@5."""
    return F.when(F.lower(name) == "mrr", "MRR").when(F.lower(name).startswith("ndcg@"), F.concat(F.lit("nDCG"), F.substring(name, 5, 99))).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 99)))
