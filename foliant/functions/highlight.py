"""Where query terms stand in a text, and excerpts around them. Offsets count code points."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

WINDOW, EXCERPTS = 160, 2


class _Folded(dict):
    """Compatibility form and lower case of a character, computed once for each that occurs."""

    def __missing__(self, ch: str) -> str:
        self[ch] = flat = unicodedata.normalize("NFKC", ch).lower()
        return flat


_FOLD = _Folded()


@dataclass
class Spans:
    """Disjoint occurrences in text order: places and the number of the term that each began with."""

    start: np.ndarray
    end: np.ndarray
    term: np.ndarray


def fold_with_map(text: str) -> tuple[str, np.ndarray]:
    """The text in compatibility form and lower case, character by character, and for each of its characters the place in the original; one more for the end."""
    if text.isascii():
        return text.lower(), np.arange(len(text) + 1)
    parts = [_FOLD[c] for c in text]
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return "".join(parts), np.r_[np.repeat(np.arange(len(text)), size), len(text)]


def find_hits(text: str, terms: list[str]) -> Spans:
    """All occurrences; those that touch or overlap are one, under the term of the first."""
    flat, at = fold_with_map(text)
    spans = []
    for n, term in enumerate(terms):
        if t := unicodedata.normalize("NFKC", term).lower():
            spans += [(m.start(), m.end(), n) for m in re.finditer(re.escape(t), flat)]
    if not spans:
        return Spans(*np.zeros((3, 0), dtype=np.int64))
    a, b, n = np.array(spans, dtype=np.int64).T
    start, end = at[a], np.maximum(at[b], at[b - 1] + 1)  # a character that folds to several is hit as a whole
    order = np.lexsort((end, start))
    start, end, n = start[order], end[order], n[order]
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return Spans(start[head], reach[np.r_[head[1:] - 1, len(reach) - 1]], n[head])


def excerpts(text: str, hits: Spans, window: int = WINDOW, most: int = EXCERPTS) -> list[dict]:
    """The windows with most different terms, then most hit characters, then the earliest; in text order, cut at hits.

    Every hit has a window around it. Windows move on with the hits, so the hits in each are a range and all ranges come from two
    searches; terms and characters in them are differences of running counts.
    """
    if not len(hits.start):
        return [{"offset": 0, "segments": [{"text": text[:window], "hit": False}]}]
    a = np.maximum(0, (hits.start + hits.end) // 2 - window // 2)
    b = np.minimum(len(text), a + window)
    lo, hi = np.searchsorted(hits.end, a, side="right"), np.searchsorted(hits.start, b, side="left")
    chars = np.r_[0, np.cumsum(hits.end - hits.start)]
    kinds = np.zeros(len(a), dtype=np.int64)
    for t in np.unique(hits.term):
        seen = np.r_[0, np.cumsum(hits.term == t)]
        kinds += seen[hi] > seen[lo]
    free, taken = np.lexsort((a, chars[lo] - chars[hi], -kinds)), []
    while len(free) and len(taken) < most:
        w = free[0]
        taken.append(w)
        free = free[(a[free] >= b[w]) | (b[free] <= a[w])]
    return [{"offset": int(a[w]), "segments": _segments(text, int(a[w]), int(b[w]), hits.start[lo[w] : hi[w]], hits.end[lo[w] : hi[w]])} for w in sorted(taken)]


def _segments(text: str, a: int, b: int, start: np.ndarray, end: np.ndarray) -> list[dict]:
    """text[a:b] cut at the edges of the hits; every second part is one, and empty parts are left out."""
    edges = np.clip(np.r_[a, np.stack([start, end], 1).ravel(), b], a, b).tolist()
    return [{"text": text[x:y], "hit": bool(i & 1)} for i, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]


EXCERPT = "array<struct<offset:int,segments:array<struct<text:string,hit:boolean>>>>"


def highlight(text: Column, terms: Column, window: int = WINDOW, most: int = EXCERPTS) -> Column:
    """Excerpts of a text around the terms; null for a null text, the beginning where no term stands."""

    @F.pandas_udf(EXCERPT)
    def run(t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else excerpts(x, find_hits(x, [] if y is None else list(y)), window, most) for x, y in zip(t, q)])

    return run(text, terms)
