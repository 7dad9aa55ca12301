"""Language of documents and of their segments by prediction by partial matching (PPM, escape method C).

For every language a variable-order context tree over bytes is counted on labelled rows and then frozen. The code
length of a text under a tree is exact: at each byte the longest known context either predicts the byte or pays the
escape and hands over to the next shorter one, down to a uniform byte. The trees of all languages share one set of
contexts, which makes them an automaton (state: the longest context that ends here), so that a batch of sentences
is scored in lockstep with a table lookup for each byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.runtime import spread

LANGS = ("ja", "en", "de", "fr", "es", "pt", "zh")
MAX_ORDER = 4
MAX_STATES = 12_000
#: The fit reads at most this many labelled rows of each language, each of at most TRAIN_CHARS characters (longer rows aren't candidates).
TRAIN_ROWS, TRAIN_CHARS = 240, 3_000
QUANT = 8  # a code length is kept in eighths of a bit
SPAN = 360  # bytes scored in one go; longer sentences are scored in parts
SWITCH_BITS = 14.0  # cost of a change of language between neighbouring segments

# Spellings of the languages, lower case, without region.
SPELLINGS = {
    "ja": "ja jp jpn jap japanese 日本語 nihongo japonais japanisch japonés japonês",
    "en": "en eng english 英語 anglais englisch inglés inglês",
    "de": "de ger deu german deutsch ドイツ語 allemand alemán alemão",
    "fr": "fr fre fra french français francais フランス語 französisch francés francês",
    "es": "es spa esp spanish español espanol castellano スペイン語 espagnol spanisch espanhol",
    "pt": "pt por portuguese português portugues ポルトガル語 portugais portugiesisch portugués",
    "zh": "zh chi zho cn cmn chinese 中文 汉语 漢語 中国語 简体中文 简体 chinois chinesisch chino chinês",
}
# Words that stand for no label.
PLACEHOLDERS = "und undefined unknown n/a na none null nil ?? ? - -- xx zxx mul mis tbd auto other"


def canonical_label(label: Column) -> Column:
    """The language a label names as one of LANGS; the lower-case base tag for another language; null for null, empty and placeholders."""
    base = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s　]+|[\s　]+$", "")), r"^([a-z]{2,3})[-_][a-z0-9_-]+$", "$1")
    pairs = [F.lit(x) for lang, words in SPELLINGS.items() for w in words.split() for x in (w, lang)]
    known = F.create_map(*pairs)
    blank = base.isin(*PLACEHOLDERS.split()) | (F.regexp_replace(base, r"[^\p{L}]", "") == "")
    return F.when(label.isNull() | blank, F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, base), base))


# ---------------------------------------------------------------- the trees


def _fold() -> np.ndarray:
    """Bytes as the trees see them: ASCII letters in lower case, one digit, white space as a space."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[48:58] = 48
    t[9:14] = 32
    return t


FOLD = _fold()
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


@dataclass
class Trees:
    """Frozen trees as an automaton: next[state * 256 + byte] and the packed code lengths of all languages for that step."""

    nxt: np.ndarray
    cost: np.ndarray  # uint64[(states * 256), 2]: eight lanes of 16 bits
    langs: tuple[str, ...]
    states: int

    @staticmethod
    def fit(samples: dict[str, list[str]], max_order: int = MAX_ORDER, max_states: int = MAX_STATES) -> Trees:
        langs = tuple(x for x in LANGS if samples.get(x))
        if not langs:
            raise ValueError("no labelled rows to fit on")
        grams: list[dict[bytes, np.ndarray]] = []
        total: dict[bytes, int] = {b"": 1 << 60}
        for lang in langs:
            data = FOLD[np.frombuffer("\n".join(samples[lang]).encode(), dtype=np.uint8)]
            own: dict[bytes, np.ndarray] = {b"": np.bincount(data, minlength=256)}
            for k in range(1, max_order + 1):
                if len(data) <= k:
                    break
                key = np.zeros(len(data) - k, dtype=np.int64)
                for j in range(k + 1):
                    key = key << 8 | data[j : len(data) - k + j]
                uniq, n = np.unique(key, return_counts=True)
                heads, first = np.unique(uniq >> 8, return_index=True)
                for h, lo, hi in zip(heads.tolist(), first.tolist(), [*first[1:].tolist(), len(uniq)]):
                    s = n[lo:hi].sum()
                    if s >= 3:
                        c = h.to_bytes(k, "big")
                        own[c] = np.stack([uniq[lo:hi] & 255, n[lo:hi]])
                        total[c] = total.get(c, 0) + int(s)
            grams.append(own)
        chosen = sorted(sorted(total, key=lambda c: (-total[c], len(c), c))[:max_states], key=lambda c: (len(c), c))
        have = set(chosen)
        chosen = [c for c in chosen if all(c[i:] in have for i in range(len(c)))]
        at = {c: i for i, c in enumerate(chosen)}
        S, L = len(chosen), len(langs)
        bits = np.zeros((S, 256, 8), dtype=np.float32)
        nxt = np.zeros((S, 256), dtype=np.int32)
        for i, c in enumerate(chosen):
            up = at[c[1:]] if c else -1
            base = bits[up] if c else np.full((256, 8), 8.0, dtype=np.float32)
            bits[i] = base
            for li, own in enumerate(grams):
                got = own.get(c)
                if got is None:
                    continue
                sym, n = (got[0].astype(np.int64), got[1]) if c else (np.flatnonzero(got), got[got > 0])
                d, s = len(sym), n.sum()
                bits[i, :, li] += np.float32(np.log2((s + d) / d))
                bits[i, sym, li] = np.log2((s + d) / n)
            if c:
                nxt[i] = nxt[up]
        for c, i in at.items():
            if c and c[:-1] in at:
                nxt[at[c[:-1]], c[-1]] = i
        # a context that extends another one inherits its steps unless it has a longer one
        size = np.array([len(c) for c in chosen])
        for i, c in enumerate(chosen):
            if c:
                nxt[i] = np.where(size[nxt[i]] > len(c), nxt[i], nxt[at[c[1:]]])
        q = np.minimum(np.rint(bits * QUANT), 180).astype(np.uint16)
        q[:, :, L:] = 0
        return Trees(nxt.reshape(-1), q.reshape(S * 256, 8).view(np.uint64), langs, S)

    def __getstate__(self) -> dict:
        """Compressed: a state repeats most of its suffix's table, and the model goes to every executor."""
        return {"nxt": zlib.compress(self.nxt, 1), "cost": zlib.compress(self.cost, 1), "langs": self.langs, "states": self.states}

    def __setstate__(self, s: dict) -> None:
        self.nxt = np.frombuffer(zlib.decompress(s["nxt"]), dtype=np.int32)
        self.cost = np.frombuffer(zlib.decompress(s["cost"]), dtype=np.uint64).reshape(-1, 2)
        self.langs, self.states = s["langs"], s["states"]

    def bits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code length in bits of every data[start:end] under every language."""
        out = np.zeros((len(start), 8), dtype=np.float64)
        length = end - start
        parts = np.maximum(1, -(-length // SPAN))
        who = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
        a = start[who] + nth * SPAN
        n = np.minimum(end[who] - a, SPAN)
        order = np.argsort(-n, kind="stable")
        a, n = a[order], n[order]
        acc = np.zeros((len(a), 2), dtype=np.uint64)
        state = np.zeros(len(a), dtype=np.int32)
        live = np.searchsorted(-n, -np.arange(1, SPAN + 1), side="right")
        for t in range(int(n[0]) if len(n) else 0):
            k = live[t]
            key = state[:k]
            key <<= 8
            key |= data[a[:k] + t]
            acc[:k] += self.cost.take(key, axis=0)
            self.nxt.take(key, out=key)
        lanes = acc.view(np.uint16).reshape(len(a), 8)
        np.add.at(out, who[order], lanes / QUANT)
        return out[:, : len(self.langs)]


# ---------------------------------------------------------------- segments


def _ends(data: np.ndarray) -> np.ndarray:
    """Positions after a line feed or a sentence end: 。！？ anywhere, . ! ? before white space or a line's end."""
    nx = np.append(data[1:], 10).astype(np.uint8)
    space = (nx == 32) | (nx == 10) | (nx == 13) | (nx == 9) | (nx >= 0xE3)
    end = (data == 10) | (((data == 46) | (data == 33) | (data == 63)) & space)
    if len(data) > 2:
        c = data[2:]
        wide = ((c == 0x82) & (data[1:-1] == 0x80) & (data[:-2] == 0xE3)) | (((c == 0x81) | (c == 0x9F)) & (data[1:-1] == 0xBC) & (data[:-2] == 0xEF))
        end[2:] |= wide
    return np.flatnonzero(end) + 1


def _is_sentence(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    last = data[np.maximum(end - 1, 0)]
    ok = (last == 46) | (last == 33) | (last == 63) | (last == 0x82) | (last == 0x81) | (last == 0x9F)
    return ok & (end - start >= 12)


def _viterbi(bits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best language of every segment when a change between neighbours of one document costs SWITCH_BITS. doc: sorted."""
    n = len(doc)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, n])
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
    back = np.zeros(bits.shape, dtype=np.int8)
    best = np.empty(n, dtype=np.int64)
    cost = bits[first].copy()
    own = np.arange(bits.shape[1], dtype=np.int8)
    final = np.zeros(len(first), dtype=np.int64)
    for t in range(1, int(count[0])):
        k = live[t]
        c = cost[:k]
        low = c.argmin(1)
        change = c[np.arange(k), low][:, None] + SWITCH_BITS
        stay = c <= change
        back[first[:k] + t] = np.where(stay, own, low[:, None].astype(np.int8))
        cost[:k] = np.where(stay, c, change) + bits[first[:k] + t]
    final = cost.argmin(1)
    for t in range(int(count[0]) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        best[at] = final[:k]
        if t:
            final[:k] = back[at, final[:k]]
    return best


def analyse(trees: Trees, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[offsets[i]:offsets[i + 1]]: (text index, start, end, language index, confidence, whether it is a full sentence)."""
    n = len(offsets) - 1
    cuts = np.sort(np.concatenate([_ends(data), offsets]))
    cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
    start, end = cuts[:-1], cuts[1:]
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, np.zeros(0), z.astype(bool)
    # without white space at the ends; segments of white space only vanish
    white = (data == 32) | ((data >= 9) & (data <= 13))
    ink = np.r_[0, np.cumsum(~white)]
    keep = ink[end] > ink[start]
    start, end = start[keep], end[keep]
    at = np.flatnonzero(~white)
    start, end = at[ink[start]], at[ink[end] - 1] + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    full = _is_sentence(data, start, end)
    bits = trees.bits(FOLD[data], start, end)
    best = _viterbi(bits, doc)
    rows = np.arange(len(best))
    low = bits[rows, best]
    conf = 1.0 / np.exp2(np.minimum(0, -(bits - low[:, None])).clip(-60)).sum(1)
    conf = np.where(bits.min(1) < low, np.minimum(conf, 0.5), conf)
    return doc, start, end, best, conf, full


#: A batch is worked on in parts of about so many bytes of text.
PART_BYTES = 4_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(len(batch) * PART_BYTES / max(1, batch.column(2).nbytes)))
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentence", pa.bool_())])
ARROW = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("languages", pa.list_(pa.string())), ("n_segments", pa.int32()), ("segments", pa.list_(SEGMENT))])
OUT = "doc_id long, label string, lang string, confidence double, languages array<string>, n_segments int, segments array<struct<start:int,end:int,lang:string,confidence:double,sentence:boolean>>"


def _narrow(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with full-width ASCII written as ASCII, character by character, where any has full-width letters."""
    if len(data) < 3:
        return data, offsets
    c = data[2:]
    at = np.flatnonzero((data[:-2] == 0xEF) & (((data[1:-1] == 0xBC) & (c >= 0xA1) & (c <= 0xBA)) | ((data[1:-1] == 0xBD) & (c >= 0x81) & (c <= 0x9A))))
    if not len(at):
        return data, offsets
    hit = set((np.searchsorted(offsets, at, side="right") - 1).tolist())
    raw = [data[a:b].tobytes().decode("utf-8", "replace").translate(WIDE).encode() if i in hit else data[a:b].tobytes() for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]))]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def _summaries(trees: Trees, data: np.ndarray, offsets: np.ndarray, segments: bool) -> dict[str, list]:
    n, L = len(offsets) - 1, len(trees.langs)
    data, offsets = _narrow(data, offsets)
    doc, start, end, best, conf, full = analyse(trees, data, offsets)
    size = np.bincount(doc * L + best, weights=end - start, minlength=n * L).reshape(n, L)
    sentences = np.bincount(doc * L + best, weights=full, minlength=n * L).reshape(n, L)
    weighted = np.bincount(doc * L + best, weights=conf * (end - start), minlength=n * L).reshape(n, L)
    top = np.where(sentences.max(1) > 0, (sentences * 1e9 + size).argmax(1), size.argmax(1)) if n else np.zeros(0, dtype=int)
    counts = sentences >= 2
    counts[np.arange(n), top] = True
    counts &= (size.sum(1) > 0)[:, None]
    langs = np.array(trees.langs)
    order = np.argsort(langs)
    has = size.sum(1) > 0
    share = weighted[np.arange(n), top] / np.maximum(size[np.arange(n), top], 1)
    out = {
        "lang": [langs[t] if h else None for t, h in zip(top, has)],
        "confidence": [float(s) if h else None for s, h in zip(share, has)],
        "languages": [[str(langs[j]) for j in order if row[j]] for row in counts],
        "n_segments": np.bincount(doc, minlength=n).astype(np.int32),
    }
    if segments:
        # runs of one language, with character offsets
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        seg: list[list[dict]] = [[] for _ in range(n)]
        for d, s, e, b, c, f in zip(doc.tolist(), start.tolist(), end.tolist(), best.tolist(), conf.tolist(), full.tolist()):
            seg[d].append({"start": int(chars[s] - chars[offsets[d]]), "end": int(chars[e] - chars[offsets[d]]), "lang": str(langs[b]), "confidence": c, "sentence": f})
        out["segments"] = seg
    else:
        out["segments"] = [None] * n
    return out


def fit_trees(docs: DataFrame, text: str = "text", label: str = "lang") -> Trees:
    """Trees from labelled rows: at most TRAIN_ROWS different texts a language, drawn by hash of the text, so that a text which many rows repeat counts once.

    The first trees judge their own rows; rows whose text another language codes shorter are mislabelled or mixed and are
    dropped before the final count. Only the sample reaches the driver; it doesn't grow with the collection.
    """
    rows = docs.select(F.col(text).alias("t"), canonical_label(F.col(label)).alias("l"), F.xxhash64(F.lit("fit"), F.col(text)).alias("h"))
    rows = rows.where(F.col("l").isin(*LANGS) & F.col("t").isNotNull() & F.length("t").between(60, TRAIN_CHARS))
    near = rows.groupBy("l").count().collect()  # one row for each language
    pick = F.lit(False)
    for r in near:
        parts = max(1, r["count"] // (TRAIN_ROWS + TRAIN_ROWS // 4))
        pick = pick | ((F.col("l") == r["l"]) & (F.pmod(F.col("h"), F.lit(parts)) == 0))
    sample = rows.where(pick).distinct().limit(len(LANGS) * TRAIN_ROWS * 3).collect()
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["h"], r["t"])):
        if len(by.setdefault(r["l"], [])) < TRAIN_ROWS:
            by[r["l"]].append(r["t"])
    if not by:
        raise ValueError("no row has a known label to fit on")
    rough = Trees.fit(by, 3, 4_000)
    clean: dict[str, list] = {}
    for lang, texts in by.items():
        raw = [t.encode() for t in texts]
        offsets = np.r_[0, np.cumsum([len(x) for x in raw])]
        got = _summaries(rough, np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, False)
        clean[lang] = [t for t, names in zip(texts, got["languages"]) if names == [lang]] or texts
    return Trees.fit(clean)


def identify(docs: DataFrame, trees: Trees, text: str = "text", label: str = "lang", key: str = "doc_id", segments: bool = False) -> DataFrame:
    """One row a document: doc_id, label, lang, confidence, languages, n_segments, segments.

    `languages`: those with at least two full sentences, or the main one; empty for a null or blank text, whose lang and
    confidence are null. `segments` (if asked for): sentences with character offsets, language and confidence, the posterior of
    the code lengths. `label` is the canonical given label. Extra columns are ignored, repeated rows are answered again.
    """
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), canonical_label(F.col(label)).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole)):
            t = b.column(2)
            large = pa.types.is_large_string(t.type)
            off = np.frombuffer(t.buffers()[1], dtype=np.int64 if large else np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
            data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if t.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
            got = _summaries(model.value, data, off - off[0], segments)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), *(pa.array(got[f.name], type=f.type) for f in list(ARROW)[2:])], schema=ARROW)

    return spread(rows).mapInArrow(run, OUT)
