"""Quality of extracted text, from its pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant.functions.text import WS, trim, utf16_length

# Penalties and limits of the quality gate.
PENALTIES = {"chars_per_page": 0.3, "blank_page_ratio": 0.25, "garbled_ratio": 0.2, "cjk_ratio": 0.1, "broken_table_ratio": 0.1, "no_structure": 0.05, "too_short": 0.3}
FEW_CHARS, MANY_BLANK, MUCH_GARBLED, LITTLE_CJK, MANY_BROKEN, LONG, SHORT, BLANK_PAGE, FALLBACK = 200, 0.3, 0.005, 0.1, 0.2, 3000, 100, 20, 0.6


def quality(pages: Column) -> Column:
    """struct<confidence, chars_per_page, blank_page_ratio, garbled_ratio, cjk_ratio, broken_table_ratio, has_structure, text_length>.

    No pages, or null, count as one empty page; a null page is empty. An empty text counts as all garbled.
    """
    p = F.transform(F.when(pages.isNull() | (F.size(pages) == 0), F.array(F.lit(""))).otherwise(pages), lambda x: F.coalesce(x, F.lit("")))
    text = F.array_join(p, "\n")
    length, n = utf16_length(text), F.size(p)
    per_page = length / n
    blank = F.size(F.filter(p, lambda x: F.length(trim(x)) < BLANK_PAGE)) / n
    garbled = F.when(length > 0, F.regexp_count(text, F.lit(r"\x{FFFD}|\(cid:\d+\)")) / length).otherwise(1.0)
    cjk = F.when(length > 0, F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]")) / length).otherwise(0.0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(trim(x)) > 0)
    solid = r"[^\s\x{3000}\x{00A0}\x{FEFF}]"
    broken = F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(rf"{solid}{WS}{{3,}}{solid}"))) / F.size(lines)).otherwise(0.0)
    structure = (length <= LONG) | text.rlike(r"(?m)^#{1,6} ")
    w = PENALTIES
    flags = [
        (per_page < FEW_CHARS, w["chars_per_page"]),
        (blank > MANY_BLANK, w["blank_page_ratio"]),
        (garbled > MUCH_GARBLED, w["garbled_ratio"]),
        (cjk < LITTLE_CJK, w["cjk_ratio"]),
        (broken > MANY_BROKEN, w["broken_table_ratio"]),
        (~structure, w["no_structure"]),
        (length < SHORT, w["too_short"]),
    ]
    penalty = F.lit(0.0)
    for flag, weight in flags:
        penalty = penalty + F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - penalty)).alias("confidence"),
        per_page.alias("chars_per_page"),
        blank.alias("blank_page_ratio"),
        garbled.alias("garbled_ratio"),
        cjk.alias("cjk_ratio"),
        broken.alias("broken_table_ratio"),
        structure.alias("has_structure"),
        length.alias("text_length"),
    )


def needs_fallback(confidence: Column) -> Column:
    return confidence < FALLBACK
