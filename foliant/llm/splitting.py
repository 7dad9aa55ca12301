"""Cutting oversized texts at natural boundaries: structure-tree packing.

A text is read as a tree: headings nest by level, below them blocks between blank lines, in them lists with nested items, tables with
rows, and lines, then sentences. A node within the limit is left whole. An oversized node is opened; what its children yield is
merged bottom-up, neighbour by neighbour, as far as the limit allows, so pieces end at the coarsest boundary that fits.
Only a sentence that is itself too long is cut inside, at white space where there is any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from foliant.runtime import spread

DEFAULT_TARGET, DEFAULT_OVERLAP = 700, 100
_BLANK = re.compile(r"(?:^|(?<=\n))[^\S\n]*(?:\n|\Z)")
_SENTENCE = re.compile(r"\n|[。！？!?]|\.(?=\s)")
_HEAD = re.compile(r"^(#{1,6})[ \t]+\S", re.M)
_ITEM = re.compile(r"^([ \t]*)(?:[-*+•・]|\d+[.)])[ \t]+\S", re.M)
_ROW = re.compile(r"[ \t]*\|")
#: Kinds of nodes, and the boundary that cutting out such a node needs.
BOUNDARY = {"section": "paragraph", "block": "paragraph", "part": "line", "item": "line", "line": "line", "sentence": "sentence"}
_ORDER = ("paragraph", "line", "sentence", "none")


def _paragraph_cuts(text: str, a: int, b: int) -> list[int]:
    """Ends of the runs of blank lines within [a, b)."""
    cuts, end = [], -1
    for m in _BLANK.finditer(text, a, b):
        if m.end() == m.start():
            continue
        if cuts and m.start() == end:
            cuts[-1] = m.end()
        else:
            cuts.append(m.end())
        end = m.end()
    return [c for c in cuts if a < c < b]


def _line_cuts(text: str, a: int, b: int) -> list[int]:
    return [m.end() for m in re.compile("\n").finditer(text, a, b) if m.end() < b]


def _outermost(found: list[tuple[int, int]]) -> list[int]:
    """Places of the marks of the lowest depth."""
    top = min((d for _, d in found), default=0)
    return [at for at, d in found if d == top]


def _children(text: str, a: int, b: int, kind: str) -> tuple[list[int], str]:
    """Where the node [a, b) parts into its children, and their kind; no kind for a node without children.

    A section holds the sections of its outermost headings, or blocks between blank lines. A block parts at headings within, a list into
    its items with all that is indented below them, a table behind its head and then by rows, other text into lines, a line into sentences.
    """
    if kind == "section":
        starts = {a, *_paragraph_cuts(text, a, b)}
        cuts = _outermost([(m.start(), len(m[1])) for m in _HEAD.finditer(text, a, b) if m.start() in starts and text[a : m.start()].strip()])
        return (cuts, "section") if cuts else (_paragraph_cuts(text, a, b), "block")
    if kind in ("block", "part"):
        if cuts := _outermost([(m.start(), len(m[1])) for m in _HEAD.finditer(text, a, b) if text[a : m.start()].strip()]):
            return cuts, "part"
        lines = _line_cuts(text, a, b)
        if len(lines) > 1 and _ROW.match(text, a) and _ROW.match(text, lines[0]) and "-" in text[lines[0] : lines[1]]:
            return lines[1:], "line"
    if kind in ("block", "part", "item"):
        if cuts := _outermost([(m.start(), len(m[1].expandtabs(4))) for m in _ITEM.finditer(text, a, b) if m.start() > a]):
            return cuts, "item"
        return _line_cuts(text, a, b), "line"
    if kind == "line":
        cuts = [m.end() for m in _SENTENCE.finditer(text, a, b) if m.end() < b]
        return cuts, "sentence"
    return [], ""


def _hard(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Pieces within one long stretch: at white space in the second half of the room, else where no mark or joiner follows."""
    out = []
    while b - a > limit:
        end = a + limit
        cut = next((i + 1 for i in range(end - 1, a + limit // 2, -1) if text[i].isspace()), 0)
        if not cut:
            cut = end
            while cut > a + 1 and ("̀" <= text[cut] <= "ͯ" or text[cut] in "゙゚‍️" or text[cut - 1] == "‍"):
                cut -= 1
            cut = cut if cut > a + 1 else end
        out.append((a, cut))
        a = cut
    return [*out, (a, b)]


def _pack(text: str, a: int, b: int, limit: int, kind: str = "section") -> list[tuple[int, int]]:
    """Pieces of the node [a, b) within the limit: it is opened only if it is too long, and what its children yield is merged neighbour by neighbour."""
    if b - a <= limit:
        return [(a, b)]
    cuts, below = _children(text, a, b, kind)
    if not below:
        return _hard(text, a, b, limit)
    merged: list[tuple[int, int]] = []
    for x, y in zip([a, *cuts], [*cuts, b]):
        for c, d in [(x, y)] if y - x <= limit else _pack(text, x, y, limit, below):
            if merged and d - merged[-1][0] <= limit:
                merged[-1] = (merged[-1][0], d)
            else:
                merged.append((c, d))
    return merged


def _opened(text: str, a: int, b: int, target: int, kind: str) -> int:
    """How deep the tree below the node [a, b), which is cut out itself, has to be opened until no node is longer than the target, white space at its ends aside."""
    own = _ORDER.index(BOUNDARY[kind])
    if b - a <= target or len(text[a:b].strip()) <= target:
        return own
    cuts, below = _children(text, a, b, kind)
    if not below:
        return _ORDER.index("none")
    return max(own, *(_opened(text, x, y, target, below) for x, y in zip([a, *cuts], [*cuts, b])))


def boundary_of(text: str, target: int) -> str | None:
    """The coarsest boundary at which cutting everywhere leaves no stretch longer than the target: that of the deepest nodes that the tree has to be opened to. Null if the text fits."""
    return None if len(text) <= target else _ORDER[_opened(text, 0, len(text), target, "section")]


def split_text(text: str | None, target: float | None, overlap: float | None) -> list[tuple[int, int, int, str]]:
    """(start, body, end, boundary) of each piece; a piece is text[start:end], and [start, body) repeats the end of the piece before.

    No piece is longer than the target. The overlap is exact unless the text before is shorter. A missing or
    non-positive target counts as the default, a missing overlap as the default, a negative one as 0; an overlap
    of the target or more, which leaves no room for text, counts as half of the target.
    """
    if text is None:
        return []
    size = int(target) if target == target and target is not None and target > 0 else DEFAULT_TARGET
    lap = max(0, int(overlap)) if overlap == overlap and overlap is not None else DEFAULT_OVERLAP
    if len(text) <= size:
        return [(0, 0, len(text), "")]
    lap = lap if lap < size else size // 2
    pieces = _pack(text, 0, len(text), size - lap)
    while lap and len(pieces) > 1 and pieces[1][1] <= size:  # the first piece repeats nothing, so it has more room
        pieces[:2] = [(0, pieces[1][1])]
    boundary = boundary_of(text, size) or ""
    return [(max(0, a - lap) if i else a, a, b, boundary) for i, (a, b) in enumerate(pieces)]


PIECES = "section_id long, version_id string, document_id string, heading_path string, piece_no int, start int, body int, end int, boundary string, oversized boolean, text string"


def split_sections(sections: DataFrame) -> DataFrame:
    """Pieces of every section, in order, each with the section's heading_path; columns of `PIECES`.

    boundary is null for a section within its target, which comes out whole. A null text has no piece, an empty one
    has one empty piece. Joining text[body - start:] of the pieces in order gives the section back. Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, v, d, h, t, size, lap in zip(b.section_id, b.version_id, b.document_id, b.heading_path, b.text, b.target_size, b.overlap):
                rows += [(s, v, d, h, n, x, y, z, k or None, bool(k), t[x:z]) for n, (x, y, z, k) in enumerate(split_text(t, size, lap))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    cols = sections.selectExpr("cast(section_id as long) section_id", "version_id", "document_id", "heading_path", "text", "cast(target_size as double) target_size", "cast(overlap as double) overlap")
    return spread(cols).mapInPandas(run, PIECES)
