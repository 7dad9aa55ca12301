"""Evaluation passages inside a corpus: a distributed positional inverted index.

The corpus is read once into index segments, one for each few megabytes of text: for every term of the test items the positions at
which it stands. Terms are words; for Chinese and Japanese items, where a word is a character, a term is the three characters from a
position on. The segments are written to the shared folder. Their totals tell which terms are rare. To look an item up,
every window of the passage length is entered at its rarest term; the position lists of the neighbouring terms, each
shifted by its offset in the item, are intersected with that term's list, and what survives is followed to both ends. An item whose terms
stand near each other, changed or reordered in part, is found by the same lists: of its rarest terms, so many that some must be there, those
that meet within a window lead to the places where all its terms are counted.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.runtime import discard, materialise, spread

PASSAGE_WORDS, PASSAGE_CHARS, GRAM = 8, 20, 3
SEGMENT_BYTES = 4_000_000
#: The terms of at most so many characters of test items are indexed at once, which is what is broadcast; items are looked up in blocks of at most so many.
INDEX_CHARS, BLOCK_CHARS = 16_000_000, 2_000_000
#: An item is near a place where a window of its length and a quarter holds this share of its terms.
NEAR, ROOM = 0.8, 4
DROP, BREAK, WORD, WIDE = 0, 1, 2, 3
_P = np.uint64(0x9E3779B97F4A7C15)


class Chars:
    """Tables over code points: the folded character, its class, and whether folding needs the text around it."""

    fold: np.ndarray
    kind: np.ndarray
    slow: np.ndarray
    _done = False

    @classmethod
    def load(cls) -> type[Chars]:
        if not cls._done:
            n = sys.maxunicode + 1
            fold, kind, slow = np.arange(n, dtype=np.uint32), np.full(n, BREAK, dtype=np.uint8), np.zeros(n, dtype=bool)
            for o in range(n):
                ch = chr(o)
                cat = unicodedata.category(ch)
                if cat in ("Cn", "Co", "Cs"):
                    continue
                if cat == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
                    kind[o] = DROP
                    continue
                flat = unicodedata.normalize("NFKC", ch).casefold()
                if len(flat) != 1 or cat[0] == "M" or o in (0xFF9E, 0xFF9F):
                    slow[o] = True
                    kind[o] = BREAK if cat[0] != "M" else DROP
                    continue
                fold[o] = ord(flat)
                if flat.isalnum():
                    c = ord(flat)
                    kind[o] = WIDE if 0x2E80 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x3FFFF else WORD
            cls.fold, cls.kind, cls.slow, cls._done = fold, kind, slow, True
        return cls


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each begins (and the last ends)."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return code, np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]


@dataclass
class Streams:
    """Terms of some texts in reading order. Positions run through all texts with a gap between two."""

    word_hash: np.ndarray
    word_doc: np.ndarray
    word_pos: np.ndarray
    gram_hash: np.ndarray
    gram_doc: np.ndarray
    gram_pos: np.ndarray
    wide: np.ndarray  # characters of the wide kind in each text
    narrow: np.ndarray
    words: np.ndarray  # words and characters of each text
    chars: np.ndarray


def streams(texts: list[str]) -> Streams:
    """Words (runs of letters and digits, a run of wide characters being one) and character trigrams, whatever case, width, spacing or punctuation."""
    t = Chars.load()
    code, off = _codes(texts)
    odd = np.flatnonzero(t.slow[code])
    if len(odd):
        texts = list(texts)
        for i in np.unique(np.searchsorted(off, odd, side="right") - 1):
            texts[i] = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", texts[i]).casefold())
        code, off = _codes(texts)
    n = len(texts)
    kind = t.kind[code]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    keep = kind != DROP
    if not keep.all():
        code, kind, doc = code[keep], kind[keep], doc[keep]
    code = t.fold[code]
    ink = kind >= WORD
    # words
    fresh = ink.copy()
    if len(code) > 1:
        fresh[1:] &= (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(ink)
    starts = np.flatnonzero(fresh[at])
    if len(at):
        w = np.cumsum(fresh[at]) - 1
        nth = np.arange(len(at)) - starts[w]
        power = np.cumprod(np.full(int(nth.max()) + 1, _P, dtype=np.uint64))
        h = (code[at].astype(np.uint64) + np.uint64(1)) * power[nth]
        word_hash = np.add.reduceat(h, starts)
    else:
        word_hash = np.zeros(0, dtype=np.uint64)
    word_doc = doc[at][starts] if len(at) else np.zeros(0, dtype=np.int32)
    # characters
    cdoc, c = doc[at], code[at].astype(np.uint64)
    m = max(0, len(c) - GRAM + 1)
    gram = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        gram *= _P
        gram += c[j : m + j]
    gram = (gram ^ gram >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    same = cdoc[:m] == cdoc[GRAM - 1 :] if m else np.zeros(0, dtype=bool)
    where = np.flatnonzero(same)
    size = lambda d, k=None: np.bincount(d, weights=k, minlength=n).astype(np.int64)
    return Streams(word_hash, word_doc, np.arange(len(word_hash)) + word_doc, gram[where], cdoc[where], where + cdoc[where], size(cdoc, kind[at] == WIDE), size(cdoc, kind[at] == WORD), size(word_doc), size(cdoc))


# ---------------------------------------------------------------- test items


@dataclass
class Items:
    """Test items of one block: their term sequences over a vocabulary of term numbers."""

    ids: np.ndarray
    wide: np.ndarray  # looked up by characters
    start: np.ndarray  # of each item's sequence in seq
    seq: np.ndarray  # term numbers
    size: np.ndarray  # words, or characters, of each item
    vocab: np.ndarray  # sorted hashes; trigrams and words are told apart by their lowest bit
    slots: np.ndarray  # open-addressing table over vocab


def _table(vocab: np.ndarray) -> np.ndarray:
    """Hash slots: the vocabulary number + 1 at each occupied slot, four probes deep at most on average."""
    size = 1 << max(16, int(len(vocab) * 8).bit_length())
    slots = np.zeros(size, dtype=np.int32)
    for i, h in enumerate(vocab.tolist()):
        s = (h >> 17) & (size - 1)
        while slots[s]:
            s = (s + 1) & (size - 1)
        slots[s] = i + 1
    return slots


def lookup(items: Items, h: np.ndarray) -> np.ndarray:
    """Term number of every hash, -1 for terms that no item has."""
    mask = np.uint64(len(items.slots) - 1)
    out = np.full(len(h), -1, dtype=np.int32)
    s = (h >> np.uint64(17) & mask).astype(np.int64)
    got = items.slots[s]
    live = np.flatnonzero(got)
    while len(live):
        v = got[live] - 1
        hit = items.vocab[v] == h[live]
        out[live[hit]] = v[hit]
        live = live[~hit]
        s[live] = (s[live] + 1) & int(mask)
        got[live] = items.slots[s[live]]
        live = live[got[live] != 0]
    return out


def prepare(ids: list[int], texts: list[str]) -> Items:
    """Items with at least one passage length of words or characters; shorter ones can't be repeated in a passage."""
    s = streams(texts)
    wide = s.wide > s.narrow
    wo, go = np.searchsorted(s.word_doc, np.arange(len(texts) + 1)), np.searchsorted(s.gram_doc, np.arange(len(texts) + 1))
    seqs, keep, size = [], [], []
    for i in range(len(texts)):
        q = s.gram_hash[go[i] : go[i + 1]] | np.uint64(1) if wide[i] else s.word_hash[wo[i] : wo[i + 1]] & ~np.uint64(1)
        if (len(q) + GRAM - 1 >= PASSAGE_CHARS) if wide[i] else len(q) >= PASSAGE_WORDS:
            seqs.append(q)
            keep.append(i)
            size.append(int(s.chars[i] if wide[i] else s.words[i]))
    allof = np.concatenate(seqs) if seqs else np.zeros(0, dtype=np.uint64)
    vocab, seq = np.unique(allof, return_inverse=True)
    return Items(np.array(ids, dtype=np.int64)[keep], wide[keep], np.r_[0, np.cumsum([len(q) for q in seqs])].astype(np.int64), seq.astype(np.int32), np.array(size, dtype=np.int64), vocab, _table(vocab))


def entries(items: Items, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) at which to enter: of every window of the passage length the place of its rarest term in the corpus."""
    who, place = [], []
    for i in range(len(items.ids)):
        q = items.seq[items.start[i] : items.start[i + 1]]
        w = PASSAGE_CHARS - GRAM + 1 if items.wide[i] else PASSAGE_WORDS
        view = np.lib.stride_tricks.sliding_window_view(total[q], w)
        at = np.unique(view.argmin(1) + np.arange(len(view)))
        who.append(np.full(len(at), i))
        place.append(at)
    z = np.zeros(0, dtype=np.int64)
    return (np.concatenate(who), np.concatenate(place)) if who else (z, z)


# ---------------------------------------------------------------- index segments

SEGMENT = "docs binary, word_term binary, word_n binary, word_at binary, gram_term binary, gram_n binary, gram_at binary, word_starts binary, gram_starts binary"
_COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a), 1)


def _postings(term: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Terms, number of positions of each, and the positions as differences, by term."""
    hit = term >= 0
    term, pos = term[hit], pos[hit]
    order = np.argsort(term, kind="stable")
    term, pos = term[order], pos[order].astype(np.int32)
    names, first, n = np.unique(term, return_index=True, return_counts=True)
    step = np.diff(pos, prepend=np.int32(0))
    step[first] = pos[first]
    return _pack(names.astype(np.int32)), _pack(n.astype(np.int32)), _pack(step)


def _read(names: bytes, n: bytes, step: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, n, step = (np.frombuffer(zlib.decompress(x), dtype=np.int32) for x in (names, n, step))
    run = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(n) - n
    base = np.where(first > 0, run[first - 1], 0) if len(first) else first
    return names, n, run - np.repeat(base, n)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        size += 3 * len(t)
        if size >= SEGMENT_BYTES or i == len(texts) - 1:
            yield ids[a : i + 1], texts[a : i + 1]
            a, size = i + 1, 0


def build_index(docs: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """Index segments over the terms of a block of items; columns of `SEGMENT`."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        any_wide, any_word = bool(it.wide.any()), bool((~it.wide).any())
        for batch in batches:
            for ids, texts in _slices(batch):
                s = streams(texts)
                z = np.zeros(0, dtype=np.int32)
                w = _postings(lookup(it, s.word_hash & ~np.uint64(1)), s.word_pos) if any_word else _postings(z, z)
                g = _postings(lookup(it, s.gram_hash | np.uint64(1)), s.gram_pos) if any_wide else _postings(z, z)
                # where each text's positions begin
                ws = np.r_[0, np.cumsum(s.words + 1)].astype(np.int64)
                gs = np.r_[0, np.cumsum(s.chars + 1)].astype(np.int64)
                row = [_pack(ids.astype(np.int64)), *w, *g, _pack(ws), _pack(gs)]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.binary()) for x in row], names=_COLUMNS)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return spread(rows).mapInArrow(run, SEGMENT)


def term_totals(index: DataFrame, terms: int) -> np.ndarray:
    """How often each term stands in the corpus; summed in the tasks first, `terms` rows reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for names, counts in (("word_term", "word_n"), ("gram_term", "gram_n")):
                for x, y in zip(batch.column(names).to_pylist(), batch.column(counts).to_pylist()):
                    n[np.frombuffer(zlib.decompress(x), dtype=np.int32)] += np.frombuffer(zlib.decompress(y), dtype=np.int32)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    got = index.select("word_term", "word_n", "gram_term", "gram_n").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms, dtype=np.int64)
    out[got["term"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def _follow(stream: np.ndarray, items: Items, item: np.ndarray, place: np.ndarray, pos: np.ndarray, step: int, limit: int) -> np.ndarray:
    """How many terms in a row agree from an entry on, in one direction, up to a limit."""
    lo, hi = items.start[item], items.start[item + 1]
    q = lo + place
    n = np.zeros(len(item), dtype=np.int64)
    live = np.arange(len(item))
    for k in range(1, limit + 1):
        a, b = q[live] + k * step, pos[live] + k * step
        ok = (a >= lo[live]) & (a < hi[live]) & (b >= 0) & (b < len(stream))
        live, a, b = live[ok], a[ok], b[ok]
        live = live[stream[b] == items.seq[a]]
        if not len(live):
            break
        n[live] = k
    return n


@dataclass
class Lists:
    """The position lists of one segment for a block of items, by term number, and the same as a stream of terms (-1 where another one stands)."""

    first: np.ndarray
    count: np.ndarray
    at: np.ndarray
    stream: np.ndarray

    def of(self, who: np.ndarray, place: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, position) of all occurrences of the terms at some places of items."""
        term = items.seq[items.start[who] + place]
        c = self.count[term]
        at = self.at[np.repeat(self.first[term], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] if len(self.at) else np.zeros(0, dtype=np.int64)
        return np.repeat(who, c), np.repeat(place, c), at


def _lists(names: np.ndarray, n: np.ndarray, at: np.ndarray, length: int, number: np.ndarray, terms: int) -> Lists:
    """number: the block's number of each indexed term, -1 for those that it doesn't have."""
    mine = number[names]
    keep = np.repeat(mine >= 0, n)
    at, n, mine = at[keep], n[mine >= 0], mine[mine >= 0]
    stream = np.full(length, -1, dtype=np.int32)
    stream[at] = np.repeat(mine, n)
    first, count = np.zeros(terms + 1, dtype=np.int64), np.zeros(terms + 1, dtype=np.int64)
    first[mine], count[mine] = np.cumsum(n) - n, n
    return Lists(first, count, at, stream)


def _passages(items: Items, who: np.ndarray, place: np.ndarray, lists: Lists, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, first place, terms, position) of all passages in one segment."""
    stream = lists.stream
    pick = items.wide[who] == wide
    item, q, pos = lists.of(who[pick], place[pick], items)
    w = PASSAGE_CHARS - GRAM + 1 if wide else PASSAGE_WORDS
    half = w // 2
    right = _follow(stream, items, item, q, pos, 1, half)
    left = _follow(stream, items, item, q, pos, -1, half)
    ok = (right >= half) | (left >= half) | (left + right + 1 >= w)
    item, q, pos = item[ok], q[ok], pos[ok]
    longest = int((items.start[1:] - items.start[:-1]).max()) if len(items.ids) else 0
    right, left = _follow(stream, items, item, q, pos, 1, longest), _follow(stream, items, item, q, pos, -1, longest)
    ok = right + left + 1 >= w
    item, q, pos, n = item[ok], q[ok] - left[ok], pos[ok] - left[ok], (right + left + 1)[ok]
    seen = np.unique(np.stack([item, q, n, pos]), axis=1) if len(item) else np.zeros((4, 0), dtype=np.int64)
    return seen[0], seen[1], seen[2], seen[3]


@dataclass
class Rarest:
    """Of each item the places of its rarest terms, and how many of them a place near it must have."""

    who: np.ndarray
    place: np.ndarray
    need: np.ndarray


def rarest(items: Items, total: np.ndarray) -> Rarest:
    """If at most a fifth of an item's terms may lack, then of any two fifths and one a fifth and one must be there."""
    who, place, need = [], [], []
    for i in range(len(items.ids)):
        q = items.seq[items.start[i] : items.start[i + 1]]
        lack = len(q) - int(np.ceil(NEAR * len(q) - 1e-9))
        m = min(len(q), 2 * lack + 1)
        at = np.argsort(total[q], kind="stable")[:m]
        who.append(np.full(m, i))
        place.append(at)
        need.append(m - lack)
    z = np.zeros(0, dtype=np.int64)
    return Rarest(np.concatenate(who), np.concatenate(place), np.array(need)) if who else Rarest(z, z, z)


def _fullest(stream: np.ndarray, item: np.ndarray, room: int) -> tuple[int, int]:
    """(terms, start) of the first window of `room` places that holds most terms of an item, each as often as the item has it."""
    left = np.bincount(item, minlength=1)
    at = np.flatnonzero(np.isin(stream, item))
    have: dict[int, int] = {}
    held = best = start = 0
    a = 0
    for b in at.tolist():
        t = int(stream[b])
        have[t] = have.get(t, 0) + 1
        held += have[t] <= left[t]
        while at[a] <= b - room:
            t = int(stream[at[a]])
            held -= have[t] <= left[t]
            have[t] -= 1
            a += 1
        if held > best:
            best, start = held, int(at[a])
    return best, start


def _near(items: Items, r: Rarest, lists: Lists, starts: np.ndarray, wide: bool) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, terms, position) where a window holds enough of an item's terms; the fullest window of each document, the first of equals."""
    pick = items.wide[r.who] == wide
    item, _, pos = lists.of(r.who[pick], r.place[pick], items)
    if not len(item):
        return
    seen = np.unique(np.stack([item, pos]), axis=1)  # a term that an item has twice is found twice
    item, pos = seen[0], seen[1]
    doc = np.searchsorted(starts, pos, side="right") - 1
    size = (items.start[1:] - items.start[:-1])[item]
    room = size + size // ROOM
    j = np.arange(len(item)) + r.need[item] - 1
    ok = j < len(item)
    j = np.minimum(j, len(item) - 1)
    ok &= (item[j] == item) & (doc[j] == doc) & (pos[j] - pos < room)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    end: dict[tuple[int, int], int] = {}
    for x in np.flatnonzero(ok).tolist():
        d, i, w = int(doc[x]), int(item[x]), int(room[x])
        if pos[x] < end.get((d, i), -1):
            continue
        # all windows that hold this occurrence and the next ones up to a window further
        a, b = max(int(starts[d]), int(pos[x]) - w + 1), min(int(starts[d + 1]), int(pos[x]) + 2 * w)
        end[d, i] = int(pos[x]) + w
        n, at = _fullest(lists.stream[a:b], items.seq[items.start[i] : items.start[i + 1]], w)
        if n >= NEAR * size[x] - 1e-9 and n > best.get((d, i), (0, 0))[0]:
            best[d, i] = n, a + at
    for (d, i), (n, at) in best.items():
        yield d, i, n, at


MATCH = "doc_id long, item_id long, kind string, item_words int, covered int, passages int, longest int, first_at int"


def match(index: DataFrame, items: Items, total: np.ndarray, number: np.ndarray) -> DataFrame:
    """One row for each document and item with a passage in common (kind phrase), and one for each place near an item (kind near); columns of `MATCH`.

    covered: the item's words that lie in passages, or its terms that the fullest window holds; first_at: where in the text the first passage or
    the window begins, in words (characters). A passage agrees in eight hashes of 64 bits or more, so no text is read again to confirm it.
    """
    who, place = entries(items, total)
    shared = index.sparkSession.sparkContext.broadcast((items, who, place, rarest(items, total), number))
    names_out = [c.split()[0] for c in MATCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        it, who, place, rare, number = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                docs, ws, gs = (np.frombuffer(zlib.decompress(row[c]), dtype=np.int64) for c in ("docs", "word_starts", "gram_starts"))
                parts, near = [], []
                for wide, kind, starts, more in ((False, "word", ws, 0), (True, "gram", gs, GRAM - 1)):
                    if not (it.wide == wide).any():
                        continue
                    lists = _lists(*_read(row[f"{kind}_term"], row[f"{kind}_n"], row[f"{kind}_at"]), int(starts[-1]) + 1, number, len(it.vocab))
                    item, q, size, pos = _passages(it, who, place, lists, wide)
                    d = np.searchsorted(starts, pos, side="right") - 1
                    parts.append(pd.DataFrame({"d": d, "item": item, "a": q, "b": q + size + more, "at": pos - starts[d]}))
                    near += [(docs[d], it.ids[i], "near", it.size[i], n, 0, 0, at - starts[d]) for d, i, n, at in _near(it, rare, lists, starts, wide)]
                if near:
                    yield pd.DataFrame(near, columns=names_out)
                p = pd.concat(parts) if parts else pd.DataFrame()
                if not len(p):
                    continue
                p = p.sort_values(["d", "item", "a", "b"])
                group = p.groupby(["d", "item"], sort=False)
                reach = group["b"].cummax().groupby([p["d"], p["item"]], sort=False).shift(fill_value=0)
                p["fresh"] = (p["b"] - np.maximum(p["a"], reach)).clip(lower=0)
                p["size"] = p["b"] - p["a"]
                g = p.groupby(["d", "item"], sort=False).agg(covered=("fresh", "sum"), passages=("a", "size"), longest=("size", "max"), first_at=("at", "min")).reset_index()
                i = g["item"].to_numpy()
                yield pd.DataFrame({"doc_id": docs[g["d"]], "item_id": it.ids[i], "kind": "phrase", "item_words": it.size[i], "covered": g["covered"], "passages": g["passages"], "longest": g["longest"], "first_at": g["first_at"]})

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in MATCH.split(", ")])
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return index.mapInArrow(arrow, MATCH)


def _joined(parts: list[Items]) -> Items:
    """Items that hold the terms of several blocks, for the index."""
    vocab = np.unique(np.concatenate([p.vocab for p in parts]))
    z = np.zeros(0, dtype=np.int64)
    return Items(z, np.concatenate([p.wide for p in parts]), z, z, z, vocab, _table(vocab))


def find_leaks(docs: DataFrame, key: str, text: str, tests: DataFrame, test_key: str, test_text: str) -> DataFrame:
    """All (document, item) with a common passage of PASSAGE_WORDS words, or PASSAGE_CHARS characters, in a row, or with a place near the item; columns of `MATCH`.

    The corpus is read once for every INDEX_CHARS of test items, which are then looked up in blocks of BLOCK_CHARS. Null keys and texts take no part, and
    items shorter than a passage match nothing; the key of an item should be unique; repeated document rows are answered again.
    """
    sized = tests.select(F.col(test_key).cast("long").alias("k"), F.col(test_text).alias("t")).where("k is not null and t is not null")
    n = int(sized.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0])
    blocks = max(1, -(-n // BLOCK_CHARS))
    together = max(1, INDEX_CHARS // BLOCK_CHARS)
    out = None
    for first in range(0, blocks, together):
        parts = []
        for b in range(first, min(first + together, blocks)):
            rows = sized.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).orderBy("k").collect()
            parts.append(prepare([r["k"] for r in rows], [r["t"] for r in rows]))
        whole = _joined(parts)
        index = materialise(build_index(docs, key, text, whole), "postings")
        total = term_totals(index, len(whole.vocab))
        for items in parts:
            mine = np.searchsorted(whole.vocab, items.vocab)
            number = np.full(len(whole.vocab) + 1, -1, dtype=np.int32)
            number[mine] = np.arange(len(mine))
            got = materialise(match(index, items, total[mine], number), "matches")
            out = got if out is None else out.unionByName(got)
        discard(index)
    return out
