"""Functions on RDF terms and texts as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import fixed

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
FOAF = "http://xmlns.com/foaf/0.1/"
#: White space of any script; the same class in Java and RE2.
WS = r"[\s\x0b\x85\p{Z}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at the ends (Spark's ``trim`` only takes spaces)."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+$", "")


def slugify(c: Column | str) -> Column:
    """A name as the end of an IRI: letters, digits, ``_`` and ``-``, white space as ``_``; ``Unknown`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{M}\p{N}_\-\s\x0b\x85\p{Z}]", ""), f"{WS}+", "_")
    return F.when(s == "", F.lit("Unknown")).otherwise(s)


def norm_surface(c: Column | str) -> Column:
    """A mention without punctuation at its end."""
    return F.regexp_replace(strip(c), r"[.,;:!?]+$", "")


def is_valid_mention(c: Column | str) -> Column:
    c = _c(c)
    return (F.length(c) >= 2) & ~F.lower(c).isin(*fixed.ENTITY_STOP)


def short_name(c: Column | str) -> Column:
    """What stands behind the last ``#``, then the last ``/``, with spaces for ``_``."""
    return F.replace(F.substring_index(F.substring_index(_c(c), "#", -1), "/", -1), F.lit("_"), F.lit(" "))


def local_name(c: Column | str) -> Column:
    """What stands behind the last ``/``, then the last ``#``."""
    return F.substring_index(F.substring_index(_c(c), "/", -1), "#", -1)


def is_qid(c: Column | str) -> Column:
    return _c(c).rlike(r"^Q[0-9]+$")


def is_opaque(c: Column | str) -> Column:
    return _c(c).rlike(r"(?i)^(m\.|g/)")


def is_file(c: Column | str) -> Column:
    return F.lower(_c(c)).rlike(r"\.(" + "|".join(fixed.FILE_ENDINGS) + ")$")


def ascii_letters(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(c), "[^A-Za-z]", ""))


def format_value(o: Column | str, kind: Column | str) -> Column:
    """An object for reading: a literal as it is, an IRI's short name without ``Category:``; null for opaque ids."""
    o, kind = _c(o), _c(kind)
    name = short_name(o)
    return F.when(kind != "uri", o).when(is_qid(name), F.lit(None)).when(name.startswith("Category:"), F.substring(name, 10, 1_000_000)).otherwise(name)


def words(c: Column | str) -> Column:
    """The words between white space."""
    return F.filter(F.split(_c(c), f"{WS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def clean_text(c: Column | str) -> Column:
    """A text's lines without headings, blank lines and fragments under 15 characters, joined by spaces."""
    lines = F.transform(F.split(_c(c), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 15) & ~(x.startswith("==") & x.endswith("=="))), " ")


def main_text(html: Column | str) -> Column:
    """A page's text without scripts, styles, navigation and tags."""
    out = _c(html)
    for tag in ("script", "style", "nav"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), f"{WS}+", " "))


def sparql_block(c: Column | str) -> Column:
    """The query in a model's answer: of the first fenced block, else from the first line that opens a query, else all of it."""
    c = _c(c)
    fenced = F.regexp_extract(c, r"(?is)```(?:sparql)?\s*(.*?)```", 1)
    lines = F.split(c, "\n")
    first = F.array_position(F.transform(lines, lambda x: strip(x).rlike("(?i)^(SELECT|PREFIX|CONSTRUCT|ASK|DESCRIBE)")), True)
    kept = F.filter(F.slice(lines, F.when(first > 0, first).otherwise(F.lit(1)).cast("int"), F.size(lines)), lambda x: ~strip(x).startswith("```"))
    return F.when(c.rlike("(?s)```.*?```"), strip(fenced)).when(first > 0, strip(F.array_join(kept, "\n"))).otherwise(strip(c))


def ngrams(ws: Column | str, most: int = 4) -> Column:
    """All runs of words, longest first, then from left to right."""
    ws = _c(ws)
    n = F.size(ws)
    runs = F.transform(
        F.sequence(F.least(F.lit(most), n), F.lit(1), F.lit(-1)),
        lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(ws, i, k), " ")),
    )
    return F.when(n > 0, F.filter(F.flatten(runs), lambda x: F.length(x) >= 2)).otherwise(F.array().cast("array<string>"))


def question_words(c: Column | str) -> Column:
    """The words of a question that may name things; punctuation only matters to the test."""
    return F.filter(words(F.lower(_c(c))), lambda w: ~F.regexp_replace(w, r"^[?,!.]+|[?,!.]+$", "").isin(*fixed.QUESTION_STOP))


def prefix_block(prefixes: dict[str, str]) -> str:
    """The ``PREFIX`` lines of a query, sorted, with the usual ones added."""
    full = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL} | prefixes
    return "\n".join(f"PREFIX {k}: <{v}>" for k, v in sorted(full.items()))


def isin(c: Column | str, values: Iterable[str]) -> Column:
    return _c(c).isin(*values)
