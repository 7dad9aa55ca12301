"""Repair of text from scanned pages: page furniture, cut words, misread characters, paragraphs.

The lines of a result lose their running headers, footers and page numbers first. What is left is one stream of characters
without its lines, decoded into words by a shortest path: a word as it stands, a word behind confusions, one word run over a
line with or without a hyphen, a hyphened word that keeps its hyphen, one split by a stray space, two run together. All compete in one
lattice, and the defects are read off the best path. Prices are logarithms of probabilities: of words from their counts over all pages, of
confusions from how often a frequent word's misreadings occur, of unseen words from their letters. Text without spaces is decoded the
same way, character by character in context. Paragraph boundaries come from a second shortest path.

The counts are a table in the shared folder. Entries with a share of COMMON or more, which are 1 / COMMON at most, go to every task; all
others are joined to the blocks of results that ask for them. Runs of common words are anchors, and the lattice is built between them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.runtime import materialise, spread

# What a scan makes of letters, as (read, meant).
CONFUSED = "c e  f t  0 o  ri n  l i  ii u  1 l  5 s  b h  rn m  o a  m rn  cl d  d cl  vv w  8 B  6 b  I l  1 i  0 O  5 S  1 I  e c  t f  h b  i l  n ri  u ii  a o"
# Characters of Chinese and Japanese text that a scan takes for each other.
WIDE_CONFUSED = "一ー 口ロ 卜ト 工エ 力カ 二ニ 夕タ 八ハ 三ミ 日曰 未末 己已 土士 人入 干千 シツ ソン へヘ べベ ぺペ り リ 問間 大犬 白自 体休 刀力 才オ 木本"

OPS = list(zip(CONFUSED.split()[::2], CONFUSED.split()[1::2]))
_ALIKE: dict[str, str] = {}
for _pair in WIDE_CONFUSED.split():
    if len(_pair) == 2:
        _ALIKE[_pair[0]] = _ALIKE.get(_pair[0], "") + _pair[1]
        _ALIKE[_pair[1]] = _ALIKE.get(_pair[1], "") + _pair[0]

#: Share of a count among its kind from which an entry goes to every task: 1 / COMMON entries of a kind at most.
COMMON = 3e-6
#: Share of the words that are no lexicon words; log price of a stray space, a lost space, a cut with a hyphen, a kept hyphen and a cut without one.
UNSEEN, SPACE, LOST_SPACE, CUT, KEPT_HYPHEN, BARE_CUT = 0.01, 9.0, 8.0, 1.0, 1.5, 9.0
#: Price of a confusion that was never observed, least price of any, and what a misreading costs more in a result without any plain damage.
RARE, LEAST_PRICE, CLEAN = 8.5, 3.0, 2.0
#: How many times as often as on average a word may be misread, since damage isn't spread evenly.
CROWD = 20.0
#: Characters of text that one block of results holds on average.
BLOCK_CHARS = 2_000_000

_LOST = re.compile(r"�|\(cid:\d+\)")
_MARK = "ʘ"  # a letter that stands for what was lost
_TOKEN = re.compile(r"[^\W_⺀-鿿豈-﫿＀-￯]+")
_COMPOUND = re.compile(r"[^\W\d_⺀-鿿]+(?:-[^\W\d_⺀-鿿]+)+")
_CUT = re.compile(r"([^\W\d_⺀-鿿]+)[-‐‑¬­][^\S\n]*\n\s*([^\W\d_⺀-鿿]+)")
_BREAK = re.compile(r"[-‐‑¬­][^\S\n]*\n")
_HYPHEN = re.compile(r"([^\W\d_⺀-鿿]+)[-‐‑¬­]\s*$")
_HEAD = re.compile(r"\s*([^\W\d_⺀-鿿]+)")
_WIDE = re.compile(r"[⺀-鿿豈-﫿]")
_CODE = re.compile(r"[A-Z]{1,3}-\d+")
_ALIKE_RE = re.compile("[" + "".join(sorted(_ALIKE)) + "]")


def _skeletons() -> dict[int, str]:
    """For every letter of a confusion a string that all confusions leave the same: what is read for it where that is longer, and one letter of each class."""
    longer = {meant: read for read, meant in OPS if len(read) == 2}
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for read, meant in OPS:
        if len(read) == len(meant) == 1:
            parent[root(read)] = root(meant)

    def grown(c: str) -> str:
        return "".join(map(grown, longer[c])) if c in longer else root(c)

    return {ord(c): grown(c) for c in {x for pair in OPS for part in pair for x in part}}


_SKELETON = _skeletons()


def skeleton(word: str) -> str:
    """What all misreadings of a word have in common."""
    return word.translate(_SKELETON)


@lru_cache(maxsize=100_000)
def confusions(read: str, meant: str) -> tuple[tuple[int, int], ...] | None:
    """The fewest confusions (number in OPS, place in `read`) that make `read` of `meant`; null where they can't."""
    front: dict[tuple[int, int], tuple] = {(0, 0): ()}
    for _ in range(5):
        for (i, j), path in list(front.items()):
            while i < len(read) and j < len(meant) and read[i] == meant[j]:
                i, j = i + 1, j + 1
                front.setdefault((i, j), path)
        if (len(read), len(meant)) in front:
            return front[len(read), len(meant)]
        step: dict[tuple[int, int], tuple] = {}
        for (i, j), path in front.items():
            for n, (a, b) in enumerate(OPS):
                if read.startswith(a, i) and meant.startswith(b, j):
                    step.setdefault((i + len(a), j + len(b)), (*path, (n, i)))
        front = step
    return None


def variants(w: str) -> list[tuple[str, int, int]]:
    """(word, place, number of the confusion) behind one confusion."""
    out = []
    for n, (read, meant) in enumerate(OPS):
        i = w.find(read)
        while i >= 0:
            out.append((w[:i] + meant + w[i + len(read) :], i, n))
            i = w.find(read, i + 1)
    return out


# ---------------------------------------------------------------- counts over all pages


_CONTEXT = {ord(c): "0" for c in "0123456789０１２３４５６７８９"} | {i: "a" for i in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250))}


def _flat(s: str) -> str:
    """The stream for contexts: no white space, one digit, one Latin letter, one mark for what was lost; two marks for either end."""
    return "^^" + "".join((_LOST.sub("�", s) if "(cid:" in s else s).split()).translate(_CONTEXT) + "$$"


def _marked(s: str) -> str:
    """Lost characters as letters and reference numbers as blanks, every character at its place."""
    if "�" in s or "(cid:" in s:
        s = _LOST.sub(lambda m: _MARK * len(m[0]), s)
    return _CODE.sub(lambda m: " " * len(m[0]), s) if "-" in s else s


def _is_word(w: str) -> bool:
    return _MARK not in w and not w.isdigit()


def _damaged(words: Iterable[str]) -> bool:
    """Whether some word of a result is damaged whatever the vocabulary: a character lost, or a digit among small letters."""
    return any(_MARK in w or not w.isalpha() and not w.isdigit() and any(c.islower() for c in w) for w in words)


def count_pages(results: Iterable[Iterable[str | None] | None]) -> tuple[Counter, Counter]:
    """Counts of words (w), hyphened words (h), contexts of look-alike characters (x, y, z) and shapes of running lines (e); and of the words in results without plain damage."""
    words: list[str] = []
    clean: list[str] = []
    whole: Counter = Counter()
    for pages in results:
        names: Counter = Counter()
        own: list[str] = []
        for page in pages if pages is not None else ():
            if not page:
                continue
            text = _marked(page)
            if "-" in page:
                whole.update("h" + c for x in page.split() if "-" in x for c in _COMPOUND.findall(x))
            if _BREAK.search(text):
                text = _CUT.sub(" ", text)
            own += _TOKEN.findall(text)
            if _WIDE.search(page):
                s = _flat(page)
                at = [m.start() for m in _ALIKE_RE.finditer(s)]
                whole.update("x" + s[i - 1 : i + 2] for i in at)
                whole.update("y" + s[i - 2 : i + 1] for i in at)
                whole.update("z" + s[i : i + 3] for i in at)
            edge = [y for y in page.split("\n") if y.strip()]
            for y in {edge[0], edge[-1]} if edge else ():
                names["".join(map(_word_shape, header_name(y).split()[:NAME_WORDS]))] += 1
        whole.update("e" + k for k, v in names.items() if v >= 2 and len(k) >= 5)
        words += own
        if not _damaged(own):
            clean += own
    whole.update({"w" + w: n for w, n in Counter(words).items() if _is_word(w)})
    return whole, Counter({"w" + w: n for w, n in Counter(clean).items() if _is_word(w)})


def _counted(results: DataFrame, pages: str) -> DataFrame:
    """(k, n, c): every entry with its count, and its count in results without plain damage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        c: Counter = Counter()
        for b in batches:
            for a in range(0, len(b), 200):
                x, y = count_pages(b["p"].iloc[a : a + 200])
                n.update(x)
                c.update(y)
                if len(n) > 400_000:
                    yield pd.DataFrame({"k": list(n), "n": list(n.values()), "c": [c[k] for k in n]})
                    n, c = Counter(), Counter()
        yield pd.DataFrame({"k": list(n), "n": list(n.values()), "c": [c[k] for k in n]})

    return spread(results.select(F.col(pages).alias("p"))).mapInPandas(run, "k string, n long, c long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


# ---------------------------------------------------------------- the model


@dataclass
class Entry:
    """n: how often, less what misreadings of frequent words account for. meant: the likeliest word behind confusions, with its log price and the place of the first."""

    n: float
    meant: str | None = None
    price: float = 0.0
    at: int = 0


@dataclass
class Model:
    """What every task knows: bounded parts of the counts. `seen` takes the entries that a block asked for as well."""

    seen: dict[str, Entry]
    total: float
    prices: list[float]
    letters: dict[str, float] = field(default_factory=dict)
    heads: dict[str, float] = field(default_factory=dict)
    certain: frozenset[str] = frozenset()
    memo: dict[str, tuple[float, str, int] | None] = field(default_factory=dict)

    def n(self, key: str) -> float:
        e = self.seen.get(key)
        return e.n if e else 0.0

    def spelling(self, w: str) -> float:
        """Log probability of the letters of a word."""
        s = "^^" + w + "$"
        return sum(self.letters.get(s[i - 2 : i + 1], None) or math.log(0.02 / (self.heads.get(s[i - 2 : i], 0.0) + 1.2)) for i in range(2, len(s)))

    def price(self, w: str, own: int = 1) -> float:
        """Price of a word as it stands; `own`: occurrences that are its own and don't count."""
        n = max(0.0, self.n("w" + w) - own)
        if n > 50:
            return math.log(self.total / n)
        return -math.log(n / self.total + UNSEEN * math.exp(max(self.spelling(w), -300.0)) + 1e-300)

    def known(self, w: str) -> float | None:
        """Price of a word that stands elsewhere; null if it doesn't."""
        n = self.n("w" + w)
        return math.log(self.total / n) if n >= 2 else None

    def meant(self, w: str) -> tuple[float, str, int] | None:
        """(price, word meant, place of the first wrong character) of the likeliest misreading that gives `w`."""
        if w in self.memo:
            return self.memo[w]
        e = self.seen.get("w" + w)
        got = (e.price, e.meant, e.at) if e and e.meant else None
        if len(w) >= 5 and (e is None or e.n < 4) and any(c.isalpha() for c in w):
            for v, at, op in variants(w):
                if v.isalpha():
                    c = self.prices[op] - math.log(UNSEEN) - self.spelling(v)
                    if got is None or c < got[0]:
                        got = (c, v, at)
        self.memo[w] = got
        return got


@dataclass
class Lexicon:
    """The table (k, n, meant, price, at) of all entries, and the part of it that every task gets."""

    table: DataFrame
    model: Model


LEXICON = "k string, n double, meant string, price double, at int"


def _pairs(words: DataFrame) -> DataFrame:
    """(w, n, a, m, ops, at): a word and a more frequent one of the same skeleton that confusions make it of."""

    def bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(skeleton, w), type=pa.string())], names=["w", "n", "s"])

    s = words.mapInArrow(bones, "w string, n long, s string")
    several = s.groupBy("s").agg(F.count("*").alias("c"), F.max("n").alias("top")).where("c > 1 and top >= 3").select("s")
    s = s.join(several, "s", "left_semi")
    a, b = s.alias("a"), s.alias("b")
    both = a.join(b, F.expr("a.s = b.s and b.n >= 3 and b.n > a.n")).select(F.col("a.w").alias("w"), F.col("a.n").alias("n"), F.col("b.w").alias("a"), F.col("b.n").alias("m"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [confusions(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([bool(f) for f in found], type=pa.bool_())
            found = [f for f in found if f]
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(keep) for i in range(4)), pa.array([[n for n, _ in f] for f in found], type=pa.list_(pa.int32())), pa.array([f[0][1] for f in found], type=pa.int32())], names=["w", "n", "a", "m", "ops", "at"])

    return both.mapInArrow(align, "w string, n long, a string, m long, ops array<int>, at int")


def _prices(words: DataFrame, pairs: DataFrame) -> list[float]:
    """Log price of each confusion: how often the words that have what is meant were read so. One row for each confusion reaches the driver."""
    sure = pairs.where("size(ops) = 1 and m >= 50 and m >= 30 * n and length(w) >= 5").groupBy(F.col("ops")[0].alias("op")).agg(F.sum("n").alias("hits"))
    chances = words.where(F.col("n") >= 50).where(F.length("w") >= 5).agg(*(F.sum(F.col("n") * F.regexp_count("w", F.lit(meant))).alias(str(i)) for i, (_, meant) in enumerate(OPS))).first()
    hits = {r["op"]: r["hits"] for r in sure.collect()}
    return [max(LEAST_PRICE, -math.log((hits.get(i, 0) + 0.5) / ((chances[i] or 0) + 0.5 * math.exp(RARE)))) for i in range(len(OPS))]


def _letters(words: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log probabilities of a letter behind two others, over the words that aren't taken for misreadings; entries below a share of COMMON are left to the price of the unseen."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = "^^" + w + "$"
                for i in range(2, len(s)):
                    n[s[i - 2 : i + 1]] += k
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), type=pa.string()), pa.array(n.values(), type=pa.float64())], names=["g", "n"])

    plain = words.where("n >= 2").where(F.col("w").rlike(r"^\p{L}+$") & (F.upper("w") != F.col("w"))).select("w", F.least(F.col("n"), F.lit(8.0)).cast("double").alias("n"))
    counts = plain.mapInArrow(grams, "g string, n double").groupBy("g").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "letters")
    total = counts.agg(F.sum("n")).first()[0] or 0.0
    rows = counts.where(F.col("n") >= COMMON * total).toPandas()
    heads = rows.assign(h=rows["g"].str[:2]).groupby("h")["n"].sum().to_dict() if len(rows) else {}
    return {g: math.log((n + 0.02) / (heads[g[:2]] + 1.2)) for g, n in zip(rows["g"], rows["n"])}, heads


def fit(results: DataFrame, pages: str = "page_texts") -> Lexicon:
    """Count all pages, learn what confusions cost and tell the misreadings of frequent words from words.

    Nothing but bounded parts reaches the driver: entries of a share of COMMON or more, letters likewise, one row for each confusion.
    """
    counts = materialise(_counted(results, pages), "counts")
    words = counts.where(F.substring("k", 1, 1) == "w").select(F.expr("substring(k, 2)").alias("w"), "n")
    sums = counts.where(F.substring("k", 1, 1) == "w").agg(F.sum("n"), F.sum("c")).first()
    total, clean = float(sums[0] or 1), float(sums[1] or 0)
    pairs = materialise(_pairs(words), "misread")
    prices = _prices(words, pairs)
    cost = F.aggregate("ops", F.lit(0.0), lambda s, o: s + F.element_at(F.array(*map(F.lit, prices)), o + 1))
    read = pairs.select("w", "a", "at", (F.log(F.lit(total) / F.col("m")) + cost).alias("price"), (F.col("m") * F.exp(-cost)).alias("due"))
    best = read.groupBy("w").agg(F.min_by(F.struct(F.col("a").alias("meant"), "price", "at"), F.struct("price", "a")).alias("b"), F.sum("due").alias("due"))
    x = counts.withColumn("w", F.when(F.substring("k", 1, 1) == "w", F.expr("substring(k, 2)"))).join(best, "w", "left")
    # misreadings crowd in damaged results, so words that clean ones hold count, and of the others what goes beyond all that could be misread
    real = F.greatest(F.lit(0.0), F.col("n") - CROWD * F.col("due"), (F.col("c") - 1) * (total / max(clean, 1.0)) - F.col("due"))
    n = F.when(F.col("due").isNull(), F.col("n").cast("double")).otherwise(real)
    table = materialise(x.select("k", n.alias("n"), "b.meant", "b.price", "b.at"), "lexicon")
    letters, heads = _letters(table.where(F.substring("k", 1, 1) == "w").select(F.expr("substring(k, 2)").alias("w"), "n"))
    sums = {r["kind"]: r["n"] for r in table.groupBy(F.substring("k", 1, 1).alias("kind")).agg(F.sum("n").alias("n")).collect()}  # six kinds
    least = F.create_map(*(F.lit(v) for k, s in (sums or {"w": 1.0}).items() for v in (k, max(2.0, COMMON * s))))
    common = table.where(F.col("n") >= least[F.substring("k", 1, 1)]).toPandas()
    return Lexicon(table, model_of(common, total, prices, letters, heads))


def model_of(rows: pd.DataFrame, total: float, prices: list[float], letters: dict[str, float], heads: dict[str, float]) -> Model:
    seen = _entries(rows)
    # a word is an anchor if no repair of it or its neighbours can be cheaper
    certain = {k[1:] for k, e in seen.items() if k[0] == "w" and (e.meant is None or e.price > math.log(total / max(e.n, 1e-9)) + CLEAN)}
    return Model(seen, total, prices, letters, heads, frozenset(certain))


def _entries(rows: pd.DataFrame) -> dict[str, Entry]:
    return {k: Entry(n, None if m is None or m != m else m, p, 0 if a != a else int(a)) for k, n, m, p, a in zip(rows["k"], rows["n"], rows["meant"], rows["price"], rows["at"])}


# ---------------------------------------------------------------- page furniture

_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBER = re.compile(r"^[\W_]*(?:(?:page|seite|p|s|pág|pag|página|pagina|folio|f|bl|blatt|no|nr|第)\W*)?([0-9０-９oOlI]{1,4}|[ivxlcdmIVXLCDM]{1,8}|[一二三四五六七八九十百]{1,5})\s*(?:(?:/|of|von|sur|de|\||／|・)\s*([0-9０-９oOlI]{1,4}))?\s*(?:頁|ページ|页)?[\W_]*$", re.I)
_DIGITS = str.maketrans("０１２３４５６７８９oOlI", "01234567890011")


def header_name(line: str) -> str:
    """The first part of a running line, without numbers."""
    name = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "", re.split(r"\s{2,}|\s[|｜/·•–-]\s|　", line.strip())[0]).strip()
    return name if sum(c.isalpha() for c in name) >= 5 and not _NUMBER.match(line.strip()) else ""


def _value(token: str) -> int | None:
    t = token.lower()
    if _ROMAN.match(t) and t:
        values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        n = [values[c] for c in t]
        return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    if all(c in "一二三四五六七八九十百" for c in t):
        total = unit = 0
        for c in t:
            if c in "十百":
                total += (unit or 1) * (10 if c == "十" else 100)
                unit = 0
            else:
                unit = "一二三四五六七八九".index(c) + 1
        return total + unit
    t = token.translate(_DIGITS)
    return int(t) if t.isdigit() else None


def _numbers(text: str) -> list[int]:
    return [int(x.translate(_DIGITS)) for x in re.findall(r"[0-9０-９]{1,4}", text)]


_SHORT_WORDS = re.compile(r"\b[ivx]+\b|(?<![^\W\d_])\d+(?![^\W\d_])")
_FOLD = str.maketrans({"0": "a", "o": "a", "1": "i", "l": "i", "5": "s", "c": "e", "f": "t", "b": "h", "一": "ー", "口": "ロ", "卜": "ト", "エ": "工", "カ": "力", "二": "ニ", "夕": "タ"})


@lru_cache(maxsize=100_000)
def _word_shape(w: str) -> str:
    s = _LOST.sub("", w).replace("rn", "m").replace("ri", "n").replace("ii", "u").lower()
    return re.sub(r"[\W\d_]+", "", _SHORT_WORDS.sub("", s).translate(_FOLD))


def _shape(line: str) -> str:
    """A line for comparison with others: no numbers, white space or marks; what a scan confuses made equal, about as long as it was."""
    return "".join(map(_word_shape, line.split()))


SAME, KEPT = 0.88, 0.4  # likeness of two running lines; share of the pages on which one is kept, if it alternates with another


def _same(a: str, b: str) -> bool:
    if a == b:
        return len(a) >= 2
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= SAME and m.quick_ratio() >= SAME and m.ratio() >= SAME


def _clusters(shapes: list[tuple[str, str]]) -> list[int]:
    """Cluster number of each (side, shape): equal shapes, and shapes that agree in a third of their length and are alike as a whole.

    Of lines that differ in two places a third is left, so damaged copies meet; each shape is compared with the most frequent one of its third only.
    """
    n = Counter(shapes)
    parent = {s: s for s in n}

    def root(s: tuple[str, str]) -> tuple[str, str]:
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    thirds: dict[tuple[str, int, str], list[tuple[str, str]]] = defaultdict(list)
    for side, s in n:
        if len(s) >= 8:
            a = len(s) // 3
            for k, part in enumerate((s[:a], s[-a:])):
                thirds[side, k, part].append((side, s))
            for shift in (-1, 0, 1):  # the middle moves by what is lost before it
                thirds[side, 2, s[a + 1 + shift : 2 * a - 1 + shift]].append((side, s))
    for group in thirds.values():
        if len(group) > 1:
            top = max(group, key=lambda s: (n[s], s))
            for s in group:
                if root(s) != root(top) and _same(s[1], top[1]):
                    parent[root(s)] = root(top)
    number = {r: i for i, r in enumerate(dict.fromkeys(map(root, n)))}
    return [number[root(s)] for s in shapes]


NAME_WORDS = 8  # words of a name in a running line


def _name_keys(line: str) -> list[str]:
    """Shapes of the beginnings of a line up to the ends of its words, as lookups; none for a line that can only be running by its repetition."""
    if len(line) >= 80 or _is_text(line):
        return []
    return [k for k in dict.fromkeys(accumulate(map(_word_shape, line.split()[:NAME_WORDS]))) if len(k) >= 5]


def _is_text(line: str) -> bool:
    """Whether a line reads as the middle of a text."""
    return line.rstrip().endswith((".", "。", ",", "，", "、", "／", "/")) or line[:1].islower()


def furniture(pages: list[list[str]], model: Model) -> dict[tuple[int, int], str]:
    """(page, line) -> `running` or `page_number`. Two lines at each edge are looked at, and one more while all of them are furniture on two pages."""
    depth = 2
    while True:
        out = _furniture(pages, model, depth)
        full = Counter()
        for p, lines in enumerate(pages):
            ink = [i for i, x in enumerate(lines) if x.strip()]
            full["top"] += len(ink) > 2 * depth and all((p, i) in out for i in ink[:depth])
            full["bottom"] += len(ink) > 2 * depth and all((p, i) in out for i in ink[-depth:])
        if max(full.values(), default=0) < 2:
            return out
        depth += 1


def _furniture(pages: list[list[str]], model: Model, depth: int) -> dict[tuple[int, int], str]:
    edges: list[list[tuple[int, str]]] = []
    for lines in pages:
        ink = [i for i, x in enumerate(lines) if x.strip()]
        edges.append([(i, "top") for i in ink[:depth]] + [(i, "bottom") for i in ink[-depth:]])
    out: dict[tuple[int, int], str] = {}
    # page numbers: the difference to the page's place must hold for the result
    found: list[tuple[int, int, int, bool]] = []
    for p, e in enumerate(edges):
        for i in sorted({i for i, _ in e}):
            line = pages[p][i].strip()
            closes = line.endswith((".", "。", ",", ";")) or line.endswith((")", "）")) and not line.startswith(("(", "（"))
            m = None if closes else _NUMBER.match(line)
            v = _value(m[1]) if m else None
            if v is not None:
                found.append((p, i, v - p, bool(re.search(r"[^\s\doOlIivxlcIVXLC]", pages[p][i].strip()))))
    votes = Counter(d for _, _, d, _ in {(p, 0, d, False) for p, _, d, _ in found})
    if votes:
        shift, n = max(votes.items(), key=lambda x: (x[1], -abs(x[0] - 1)))
        outer = any(i in (edges[p][0][0], edges[p][-1][0]) and d + p < 1000 for p, i, d, _ in found if d == shift)
        if n >= 2 or shift == 1 or outer or any(styled for _, _, d, styled in found if d == shift):
            for p, i, d, _ in found:
                if d == shift:
                    out[p, i] = "page_number"
    else:
        shift = None
    # running lines: like lines at the same edge of other pages
    lines = [(p, i, side) for p, e in enumerate(edges) for i, side in e if (p, i) not in out]
    number = _clusters([(side, _shape(pages[p][i])) for p, i, side in lines])
    on: dict[int, set[int]] = defaultdict(set)
    for c, (p, _, _) in zip(number, lines):
        on[c].add(p)
    many: dict[tuple[int, int], int] = {}
    for c, (p, i, _) in zip(number, lines):
        many[p, i] = max(many.get((p, i), 0), len(on[c]))
    for (p, i), together in sorted(many.items()):
        line = pages[p][i]
        s = _shape(line)
        if len(s) < 2:
            together = 1
        ending = re.search(r"\s{2,}\W?(\d+)\W?$", line.rstrip())
        numbered = shift is not None and ending is not None and int(ending[1]) - p == shift
        if together < 0.6 * len(pages) and _is_text(line):
            continue
        known = any(model.n("e" + k) >= 3 for k in _name_keys(line))
        often = together >= max(2, KEPT * len(pages)) and len(s) >= (2 if together >= 0.6 * len(pages) else 4)
        first = bool(edges[p]) and i in (edges[p][0][0], edges[p][1][0] if len(edges[p]) > 1 and (p, edges[p][0][0]) in out else -1)
        if often or together >= 2 and (known or numbered) or numbered and s or known and first:
            out[p, i] = "running"
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Repaired:
    defects: list[tuple[int, int, str]]
    paragraphs: list[str]


@dataclass
class Change:
    """`size` characters at `at` of the stream that mean `text`; misread: a character was wrong."""

    at: int
    size: int
    text: str
    misread: bool


@dataclass
class Stream:
    """The body of a result as one string of its lines, its words, and how each hangs together with the next."""

    text: str
    at: list[int]
    words: list[str]

    def link(self, i: int) -> str:
        """`-` cut by a hyphen at a line's end, `/` one line's end and the next one's beginning, ` ` one space, else nothing; between word i and the next."""
        if i + 1 >= len(self.words):
            return ""
        gap = self.text[self.at[i] + len(self.words[i]) : self.at[i + 1]]
        if gap == " ":
            return " "
        if "\n" in gap and gap.count("\n") == 1:
            left = gap.strip()
            return "/" if not left else "-" if left in _HYPHENS and gap[0] == left and self.words[i][-1].isalpha() and self.words[i + 1][0].isalpha() else ""
        return ""


_HYPHENS = ("-", "‐", "‑", "¬", "\u00ad")


def stream_of(lines: Iterable[str]) -> Stream:
    text = _marked("\n".join(lines))
    found = [(m.start(), m[0]) for m in _TOKEN.finditer(text)]
    return Stream(text, [a for a, _ in found], [w for _, w in found])


def _islands(s: Stream, model: Model) -> Iterator[tuple[int, int]]:
    """Ranges of words between anchors: what isn't certain, with the word before and behind that it may run into."""
    sure, at = model.certain, s.at
    a = b = -1
    doubtful = {i for i, w in enumerate(s.words) if w not in sure and _is_word(w)}
    cut = {bisect_right(at, m.start()) - 1 for m in _BREAK.finditer(s.text)} - {-1}
    for i in sorted(doubtful | cut):
        w = s.words[i]
        if i not in doubtful:
            if s.link(i) != "-":
                continue
            end = i + 2
        else:
            end = i + 2 if s.link(i) else i + 1
        start = i - 1 if i and w not in sure and s.link(i - 1) else i
        if start <= b - 1 or start < b:
            b = max(b, end)
        else:
            if b > a:
                yield a, b
            a, b = start, end
    if b > a:
        yield a, b


def _case(left: str, right: str) -> float:
    """What speaks against one word: a capital behind the hyphen, an abbreviation before it."""
    shout = left.isupper()
    return 25.0 if (right[0].isupper() and not (shout and len(left) > 3)) or (shout and len(left) <= 3) else 0.0


def decode(s: Stream, model: Model, margin: float) -> tuple[list[Change], list[int]]:
    """Changes, and the words that were cut with a hyphen, on the shortest paths through all islands."""
    changes: list[Change] = []
    cuts: list[int] = []
    own = Counter(w for w in s.words if w not in model.certain)  # what a result holds itself is no evidence for it
    for a, b in _islands(s, model):
        n = b - a
        best: list[tuple[float, int, list[Change], int]] = [(math.inf, 0, [], -1)] * (n + 1)
        best[0] = (0.0, 0, [], -1)

        def offer(j: int, i: int, price: float, made: list[Change], cut: int = -1) -> None:
            c = best[i][0] + price
            if c < best[j][0]:
                best[j] = (c, i, made, cut)

        for k in range(n):
            i = a + k
            w, at = s.words[i], s.at[i]
            link = s.link(i) if k + 1 < n else ""
            lost = _MARK in w
            plain = 12.0 if lost else 10.0 if w.isdigit() else model.price(w, own[w])
            known = model.known(w)
            offer(k + 1, k, plain + (KEPT_HYPHEN + 6.0 if link == "-" else 0.0), [])
            if not lost and w not in model.certain and (got := model.meant(w)):
                offer(k + 1, k, got[0] + margin, [Change(at, len(w), got[1], True)])
            if known is None and not lost and len(w) >= 8:
                for c in range(3, len(w) - 2):
                    x, y = model.known(w[:c]), model.known(w[c:])
                    if x is not None and y is not None:
                        offer(k + 1, k, x + y + LOST_SPACE, [Change(at, len(w), w[:c] + " " + w[c:], False)])
            if not link or lost or _MARK in s.words[i + 1]:
                continue
            right, there = s.words[i + 1], s.at[i + 1]
            whole = w + right
            price = model.known(whole)
            if link == "-":
                c = model.n(f"h{w}-{right}")
                if c:
                    offer(k + 2, k, math.log(model.total / c) + KEPT_HYPHEN, [])
                extra = CUT + _case(w, right)
                offer(k + 2, k, (price if price is not None else model.price(whole, 0)) + extra, [], i)
                if price is None or price > 9.0:
                    if got := model.meant(whole):
                        if got[2] >= len(w):
                            made = Change(there, len(right), got[1][len(w) :], True)
                        elif got[1].endswith(right):
                            made = Change(at, len(w), got[1][: -len(right)], True)
                        else:
                            made = Change(at, len(w), w, True)
                        offer(k + 2, k, got[0] + margin + extra, [made], i)
            elif price is not None and len(whole) > 5 and known is None:
                if link == " " and model.known(right) is None:
                    offer(k + 2, k, price + SPACE, [Change(at, there + len(right) - at, whole, True)])
                elif link == "/":
                    offer(k + 2, k, price + BARE_CUT, [Change(there, 0, "", False)])
        k = n
        while k:
            _, i, made, cut = best[k]
            changes += made
            if cut >= 0:
                cuts.append(cut)
            k = i
    return changes, cuts


def _gram(flat: str, i: int, kind: str) -> str:
    return kind + (flat[i - 1 : i + 2] if kind == "x" else flat[i - 2 : i + 1] if kind == "y" else flat[i : i + 3])


def _doubtful(flat: str, model: Model) -> list[int]:
    """Places of look-alike characters whose nearest context doesn't settle them."""
    n = model.n
    out = []
    for m in _ALIKE_RE.finditer(flat):
        i = m.start()
        own = n("x" + flat[i - 1 : i + 2])
        if not own or any(n(f"x{flat[i - 1]}{d}{flat[i + 1]}") > 2 * own for d in _ALIKE[flat[i]]):
            out.append(i)
    return out


def _runs(at: list[int]) -> Iterator[list[int]]:
    run: list[int] = []
    for i in at:
        if run and i - run[-1] > 2:
            yield run
            run = []
        run.append(i)
    if run:
        yield run


WIDE_PRICE = 5.0  # log price of a misread character of a text without spaces


def decode_wide(flat: str, model: Model, doubtful: list[int], margin: float) -> list[tuple[int, str]]:
    """(place, character meant) on the best path: every look-alike character of a run is chosen together with its neighbours.

    A state holds the characters chosen for the last four places; the three contexts of a place count once all of their
    characters are chosen. A change stands only if two of its contexts speak for it and none against it.
    """
    n, out = model.n, []
    for run in _runs(doubtful):
        lo, hi = run[0], run[-1] + 2
        open_ = set(run)
        states: dict[str, tuple[float, tuple]] = {flat[lo - 4 : lo] if lo >= 4 else flat[:lo].rjust(4, "^"): (0.0, ())}
        for i in range(lo, min(hi + 1, len(flat))):
            nxt: dict[str, tuple[float, tuple]] = {}
            for tail, (score, path) in states.items():
                for c in (flat[i], *_ALIKE[flat[i]]) if i in open_ else (flat[i],):
                    t = tail + c
                    got = score - (WIDE_PRICE + margin if c != flat[i] else 0.0)
                    if i - 2 >= lo and t[2] in _ALIKE:
                        got += math.log(n("x" + t[1:4]) + 0.2) + math.log(n("y" + t[0:3]) + 0.2) + math.log(n("z" + t[2:5]) + 0.2)
                    key = t[1:]
                    if key not in nxt or got > nxt[key][0]:
                        nxt[key] = (got, (*path, (i, c)) if c != flat[i] else path)
            states = nxt
        _, path = max(states.values(), key=lambda s: s[0])
        if not path:
            continue
        new = list(flat[lo - 2 : hi + 1])
        for i, c in path:
            new[i - lo + 2] = c
        fixed = flat[: lo - 2] + "".join(new) + flat[hi + 1 :]
        for i, c in path:
            was = fixed[:i] + flat[i] + fixed[i + 1 :]
            gain = [math.log((n(_gram(fixed, i, k)) + 0.2) / (n(_gram(was, i, k)) + 0.2)) for k in "xyz"]
            if min(gain) > -0.5 and sum(g > 1.0 for g in gain) >= 2:
                out.append((i - 2, c))
    return out


def _place(lines: list[str], at: int) -> tuple[int, int]:
    """Line and column of a character of the stream without white space."""
    for n, line in enumerate(lines):
        bare = _LOST.sub("�", line) if "(cid:" in line else line
        size = len("".join(bare.split()))
        if at < size:
            at_mark = [k for k, c in enumerate(_LOST.sub(lambda m: "�" + "\0" * (len(m[0]) - 1), line)) if c != "\0" and not c.isspace()]
            return n, at_mark[at]
        at -= size
    raise IndexError(at)


_ENDS = (".", "。", "!", "?", "！", "？", ":", "：", "」", "”", ")")
LONG, MORE = 25, 0.02  # lines of a paragraph that cost nothing, and the price of each further one


def _break_prices(lines: list[str], gaps: list[int], width: int) -> list[float]:
    """What it costs that a paragraph begins at each line."""
    price = []
    for i in range(len(lines)):
        if i == 0:
            price.append(0.0)
            continue
        prev = lines[i - 1].rstrip()
        done, short = prev.endswith(_ENDS), len(prev) < 0.75 * width
        c = 3.0 if gaps[i] == 0 else -6.0 if gaps[i] == 1 else 2.0 if gaps[i] == 2 else 0.0
        c += (-2.5 if done and short else 0.0 if done else 3.0 if gaps[i] != 1 else 0.5) + (-1.0 if short and gaps[i] else 0.0)
        if re.match(r"\s*(#{1,6} |[-*•・] |\d+[.)] |第\d+条)", lines[i]):
            c -= 6.0
        if re.match(r"\s*#{1,6} ", lines[i - 1]):
            c -= 6.0
        price.append(c)
    return price


def _paragraph_breaks(lines: list[str], gaps: list[int], width: int) -> list[bool]:
    """Whether a paragraph begins at each line. gaps: 0 none, 1 blank line, 2 page break, 3 both. Shortest path over paragraph ends."""
    n = len(lines)
    if not n:
        return []
    price = _break_prices(lines, gaps, width)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    near: deque[int] = deque()  # starts 2 to LONG lines back, the best first
    far = -1  # the best of those further back, where every line more has its price
    at = [0.0] * n
    for j in range(1, n + 1):
        at[j - 1] = best[j - 1] + price[j - 1]
        best[j], back[j] = at[j - 1] + 0.4, j - 1
        if j >= 2:
            while near and at[near[-1]] >= at[j - 2]:
                near.pop()
            near.append(j - 2)
        if near and near[0] < j - LONG:
            near.popleft()
        if j > LONG and (far < 0 or at[j - LONG - 1] - MORE * (j - LONG - 1) < at[far] - MORE * far):
            far = j - LONG - 1
        for i, c in [(i, at[i]) for i in list(near)[:1]] + ([(far, at[far] + MORE * (j - far - LONG))] if far >= 0 else []):
            if c < best[j]:
                best[j], back[j] = c, i
    out, j = [False] * n, n
    while j:
        out[back[j]] = True
        j = back[j]
    return out


def repair(pages: list[str | None] | None, model: Model, paragraphs: bool = True) -> Repaired:
    """Defects as (page, line, defect), counted from 1, and the text in paragraphs. Null pages count as blank; no pages give nothing."""
    split = [(p or "").split("\n") for p in (pages if pages is not None else [])]
    marks = furniture(split, model)
    defects = [(p + 1, i + 1, d) for (p, i), d in marks.items()]
    body: list[tuple[int, int, str]] = []
    gaps: list[int] = []
    gap = 0
    for p, lines in enumerate(split):
        if p:
            gap |= 2
        for i, line in enumerate(lines):
            if (p, i) in marks:
                continue
            if not line.strip():
                gap |= 1 if body and body[-1][0] == p else 0
                continue
            body.append((p, i, line.replace("\r", " ")))
            gaps.append(gap)
            gap = 0
    texts = [x[2] for x in body]
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t) + 1)
    s = stream_of(texts)
    wrong = {n for n, t in enumerate(texts) if _LOST.search(t)}
    margin = 0.0 if wrong or _damaged(s.words) else CLEAN
    line_of = lambda at: bisect_right(starts, at) - 1
    changes, cuts = decode(s, model, margin)
    cut = {line_of(s.at[i]) for i in cuts}
    edits: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    bare: set[int] = set()
    for c in changes:
        n = line_of(c.at)
        if c.misread:
            wrong.add(n)
        if c.size:
            edits[n].append((c.at - starts[n], c.size, c.text))
        else:
            bare.add(n - 1)
    # text without spaces
    if any(_WIDE.search(t) for t in texts):
        flat = _flat("\n".join(texts))
        for at, c in decode_wide(flat, model, _doubtful(flat, model), 0.0):
            n, col = _place(texts, at)
            wrong.add(n)
            edits[n].append((col, 1, c))
    defects += [(body[n][0] + 1, body[n][1] + 1, "misread") for n in wrong]
    defects += [(body[n][0] + 1, body[n][1] + 1, "broken_word") for n in cut]
    return Repaired(sorted(set(defects)), _joined(texts, gaps, edits, cut, bare, model) if paragraphs else [])


def _joined(texts: list[str], gaps: list[int], edits: dict[int, list[tuple[int, int, str]]], cut: set[int], bare: set[int], model: Model) -> list[str]:
    """The repaired lines as paragraphs."""
    fixed = []
    for n, line in enumerate(texts):
        for col, size, meant in sorted(edits[n], reverse=True):
            line = line[:col] + meant + line[col + size :]
        fixed.append(line)
    fresh = _paragraph_breaks(fixed, gaps, max((len(x) for x in fixed), default=0))
    out: list[list[str]] = []
    for n, line in enumerate(fixed):
        text = line.strip()
        if fresh[n] or not out:
            out.append([text])
        elif n - 1 in cut:
            out[-1][-1] = re.sub(r"[-‐‑¬­]\s*$", "", out[-1][-1])
            out[-1].append(text)
        else:
            last = out[-1][-1]
            out[-1] += ["" if n - 1 in bare or last and text and (_HYPHEN.search(last) or _WIDE.match(text[0]) or _WIDE.match(last[-1])) else " ", text]
    return [_GAP.sub(lambda m: _restored(m[0], model), "".join(p)) for p in out]


_GAP = re.compile(r"[^\W\d_⺀-鿿]*(?:�|\(cid:\d+\))[^\W\d_⺀-鿿]*")
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâçèéêëîïôùûñáíóúãõABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _restored(w: str, model: Model) -> str:
    """A word with one lost letter as the most frequent word that it can be; else as it stands."""
    m = _LOST.search(w)
    head, tail = w[: m.start()], w[m.end() :]
    if len(head) + len(tail) < 3:
        return w
    best = max((head + c + tail for c in _LETTERS), key=lambda x: model.n("w" + x))
    return best if model.n("w" + best) >= 3 else w


# ---------------------------------------------------------------- in Spark


def asked(results: Iterable[Iterable[str | None] | None], model: Model, paragraphs: bool = True) -> set[str]:
    """The entries that the pages of some results may need beside those that every task has."""
    keys: set[str] = set()
    add = keys.add
    for pages in results:
        inked = [[x for x in (page or "").split("\n") if x.strip()] for page in (pages if pages is not None else ())]
        lines = [x for ink in inked for x in ink]
        for p, ink in enumerate(inked):
            for y in {*ink[:4], *ink[-4:]}:
                keys.update("e" + k for k in _name_keys(y))
            for i, line in enumerate(ink):
                if (end := line.rstrip())[-1:] in _HYPHENS and (m := _HYPHEN.search(end)):
                    behind = ink[i + 1 : i + 2] if i + 4 < len(ink) else [*ink[i + 1 :], *(x for more in inked[p + 1 : p + 3] for x in more[:4])]  # running lines may stand between
                    for following in behind:
                        if h := _HEAD.match(following):
                            add("w" + m[1] + h[1])
                            add(f"h{m[1]}-{h[1]}")
        s = stream_of(lines)
        words = s.words
        sure = model.certain
        for i in [i for i, w in enumerate(words) if w not in sure]:
            w = words[i]
            if not _is_word(w):
                continue
            add("w" + w)
            for k in (i - 1, i):
                if k >= 0 and s.link(k) in (" ", "/"):
                    add("w" + words[k] + words[k + 1])
        if any(_WIDE.search(x) for x in lines):
            flat = _flat("\n".join(lines))
            for i in _doubtful(flat, model):
                for c in (flat[i], *_ALIKE[flat[i]]):
                    for before in _options(flat, i - 1):
                        for behind in _options(flat, i + 1):
                            add("x" + before + c + behind)
                    for x in _options(flat, i - 2):
                        for y in _options(flat, i - 1):
                            add("y" + x + y + c)
                    for x in _options(flat, i + 1):
                        for y in _options(flat, i + 2):
                            add("z" + c + x + y)
        if paragraphs and any("�" in x or "(cid:" in x for x in lines):
            for line in lines:
                for m in _GAP.finditer(line) if _LOST.search(line) else ():
                    x = _LOST.search(m[0])
                    if len(m[0]) - len(x[0]) >= 3:
                        keys.update("w" + m[0][: x.start()] + c + m[0][x.end() :] for c in _LETTERS)
    return {k for k in keys if k not in model.seen}


def _options(flat: str, i: int) -> tuple[str, ...]:
    return (flat[i], *_ALIKE.get(flat[i], ())) if 0 <= i < len(flat) else ("",)


OUT = "version_id string, defects array<struct<page_no:int,line_no:int,defect:string>>, paragraphs array<string>"


def repair_results(results: DataFrame, lexicon: Lexicon, key: str = "version_id", pages: str = "page_texts", paragraphs: bool = True) -> DataFrame:
    """One row for each result: its defects by page and line, and its text as paragraphs (none if they aren't wanted).

    A null or empty list of pages gives empty lists; a null page counts as blank. Extra columns are ignored; repeated rows are answered again.
    Results are dealt into blocks of about BLOCK_CHARS; a block asks the table for the entries that it may need and gets those alone.
    """
    spark = results.sparkSession
    shared = spark.sparkContext.broadcast(lexicon.model)
    rows = results.select(F.col(key).cast("string").alias("key"), F.col(pages).alias("pages"))
    size = rows.agg(F.coalesce(F.sum(F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.length(p), F.lit(0)))), F.lit(0))).first()[0]
    blocks = max(spark.sparkContext.defaultParallelism, -(-int(size) // BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[int, set[str]] = defaultdict(set)
        for b in batches:
            for block, part in b.groupby("block"):
                wanted[block] |= asked(part["pages"], shared.value, paragraphs)
        for block, keys in wanted.items():
            if keys:
                yield pd.DataFrame({"block": block, "k": list(keys)})

    wanted = dealt.mapInPandas(ask, "block int, k string")
    facts = wanted.join(lexicon.table, "k").select("block", "k", "n", "meant", "price", "at")

    def run(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        base = shared.value
        model = replace(base, seen=base.seen | _entries(found), memo={})
        done = [repair(p, model, paragraphs) for p in part["pages"]]
        return pd.DataFrame({"version_id": part["key"].to_numpy(), "defects": [[{"page_no": p, "line_no": i, "defect": d} for p, i, d in r.defects] for r in done], "paragraphs": [r.paragraphs for r in done]})

    return dealt.groupBy("block").cogroup(facts.groupBy("block")).applyInPandas(run, OUT)
