"""Text functions, Column -> Column, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Section names that make a line a header, in their usual order.
SECTION_NAMES = (
    "abstract", "introduction", "background", "methods", "materials and methods", "method", "results",
    "results and discussion", "discussion", "conclusion", "conclusions", "references", "acknowledgements",
    "acknowledgments",
)
#: The six sections every paper should have, and how their headers read; in alphabetical order, as the
#: missing ones are listed.
SECTION_PATTERNS = {
    "abstract": "abstract",
    "discussion": "discussion",
    "introduction": "introduction",
    "methods": "methods|methodology|materials and methods",
    "references": "references|bibliography|literature cited",
    "results": "results",
}
#: How a caption and a numbered heading begin, what a whole total cell says.
CAPTION = r"(?iu)(?U)^\s*(figure|fig\.?|table|scheme|plate)\s*\d+"
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+)*)[.)]?\s+([A-Za-z][\s\S]*)$"
TOTAL = r"(?i)(?U)^\s*(total|totals|sum|sums|overall)\s*[:.]?\s*$"

ORPHAN_CHARS = 100


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_upper(text: Column) -> Column:
    """Cased letters exist and all of them are upper case."""
    return (text == F.upper(text)) & (F.lower(text) != text)


def classify(text: Column) -> Column:
    """Block kind from the text alone: other, caption, section_header or paragraph."""
    t = strip(text)
    rest = F.regexp_extract(t, NUMBERED, 2)
    numbered = rest != ""
    bare = strip(F.regexp_replace(F.when(numbered, rest).otherwise(t), r"[:.]+$", ""))
    n = F.size(words(bare))
    header = (
        F.lower(bare).isin(*SECTION_NAMES)
        | (numbered & (n <= 8) & ~bare.endswith("."))
        | ((n <= 6) & is_upper(bare) & (F.length(bare) > 2))
    )
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "other").when(t.rlike(CAPTION), "caption").when(header, "section_header").otherwise("paragraph")
    )


def sentences(text: Column) -> Column:
    """Pieces after . ! ? and white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def level(text: Column) -> Column:
    """Lower case, with runs of other than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def grams(text: Column, size: int = 3) -> Column:
    """The set of ``size``-character substrings of the text in lower case, with other than a-z0-9 levelled to one space."""
    t = level(text)
    return F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))


def tokens(text: Column) -> Column:
    """Search terms: lower-case runs of a-z0-9 of two or more characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def parse_number(raw: Column) -> Column:
    """The number formats papers print, or null: three dashes as minus, %, spaces and thousands commas dropped, wrapped in
    brackets negative (so that a minus inside brackets turns positive again)."""
    t = F.translate(strip(raw), "−–—%  ", "---")
    wrapped = t.startswith("(") & t.endswith(")")
    t = F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), ",", "")
    number = t.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    named = F.lower(t).rlike(r"^[+-]?(nan|inf|infinity)$")
    value = F.when(number | named, F.regexp_replace(t, "_", "").try_cast("double"))
    return F.when(wrapped, -value).otherwise(value)


def page_stem(filename: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def cell_text(texts: Column) -> Column:
    """All filled cells of a table, row by row."""
    return F.filter(F.flatten(F.filter(texts, lambda r: r.isNotNull())), lambda c: c.isNotNull() & (c != ""))
