"""Column functions for names, sizes and Markdown text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space including the ideographic and the no-break space and the byte-order mark.
WS = r"[\s\x{3000}\x{00A0}\x{FEFF}]"

# Accepted files and their types.
MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def mime_type(name: Column) -> Column:
    """The type of an accepted file by its extension; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension(name))


def accepted(name: Column) -> Column:
    return extension(name).isin(*MIME)


def title_from_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def strip_anchors(markdown: Column) -> Column:
    """Without the lines that only mark a page, sheet or slide."""
    return trim(F.regexp_replace(markdown, r"(?m)^<!--\s*(page|sheet|slide):[^>]*-->\s*$", ""))


def human_bytes(n: Column) -> Column:
    """Bytes, KB or MB with one decimal, halves rounded up."""

    def tenths(unit: int) -> Column:
        t = F.floor((n * 10 + unit // 2) / unit).cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenths(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))


def slug(index: Column, heading: Column) -> Column:
    """Anchor name of a heading: letters and digits joined by hyphens, 40 characters at most, behind its number among the headings."""
    s = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, 40)
    return F.concat(F.lit("h-"), index.cast("string"), F.lit("-"), F.when(s == "", F.lit("section")).otherwise(s))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; nulls stay null."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
