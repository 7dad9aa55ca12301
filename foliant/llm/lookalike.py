"""One form for texts that look the same: look-alike mapping, then accent-sensitive Unicode collation.

Every text is mapped to a comparison value (compatibility forms folded, invisible characters dropped, spaces, hyphens and
look-alike letters replaced by one representative each). Values are grouped in SQL under the UNICODE collation, which tells
accents, voicing marks and letter case apart but not the ways of composing them; each class gets one member as its
canonical text, which is joined back to all of its rows.
"""

from __future__ import annotations

import os
import struct
import sys
import unicodedata
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, functions as F

from foliant.runtime import discard, materialise, spread

# Letters, kana and kanji that look alike, each pair as (drawn like, representative).
LOOKALIKES = """
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  Х X  У Y  І I  Ј J  Ѕ S  а a  с c  е e  о o  р p  х x  у y  і i  ј j  ѕ s  ԁ d  һ h  ԛ q  ԝ w  ӏ l
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  α a  ν v  ο o  ρ p  ι i  υ u
Ա U  Օ O  օ o  ո n  ս u  ց g  Ⴝ S  ı i  ɑ a  ɡ g  ℓ l
ニ 二  ハ 八  ミ 三  ー 一  ― 一  — 一  カ 力  タ 夕  ト 卜  ロ 口  エ 工  ヘ へ  リ り  チ 千  ヌ 又  ム 厶  才 オ  〇 ○
⺀ 冫  ⺅ 亻  ⺈ ク  ⺊ 卜  ⺡ 氵  ⺣ 灬  ⺨ 犭  ⺮ 竹  ⺼ 月  ⻌ 辶  髙 高  﨑 崎
"""
# Characters that are one hyphen to a reader, and spaces beyond the space category.
HYPHENS = "‐ ‑ ‒ – − ⁃ ﹣ － ˗ ۔ ➖ ⁻ ₋"
BLANKS = "⠀ ㅤ ﾠ"


def published() -> dict[str, str]:
    """Look-alike letters by the confusables data of Unicode, as the ICU library among Spark's jars holds them: (drawn like, representative).

    Taken are pairs of single letters that agree in case, where the first has one, and carry no accent or voicing mark of their own, as those differences count here; letters of ASCII stand for themselves.
    Without the library at hand, the table above stands alone.
    """
    home = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent)
    jar = next(iter(sorted((home / "jars").glob("icu4j-*.jar"))), None)
    if jar is None:
        return {}
    with zipfile.ZipFile(jar) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    body = raw[struct.unpack(">H", raw[:2])[0] :]  # big-endian: keys of 24 bits with a length above, and values of 16 bits, which are characters or places in a pool
    _, _, _, keys, n, values, m, _, _ = struct.unpack(">9i", body[:36])
    out = {}
    for k, v in zip(struct.unpack(f">{n}i", body[keys : keys + 4 * n]), struct.unpack(f">{m}H", body[values : values + 2 * m])):
        a, b = chr(k & 0xFFFFFF), chr(v)
        if k >> 24 or a.isascii() or not (a.isalpha() and b.isalpha()) or unicodedata.category(a)[0] != "L":
            continue
        if any(len(unicodedata.normalize("NFD", c)) > 1 for c in (a, b)) or (a.isupper() or a.islower()) and (a.isupper(), a.islower()) != (b.isupper(), b.islower()):
            continue
        out[a] = b
    return out


def _table(extra: dict[str, str]) -> dict[int, str | None]:
    """Replacement for each code point after compatibility folding: look-alikes, hyphens, spaces; invisible characters vanish."""
    table: dict[int, str | None] = {}
    for o in range(sys.maxunicode + 1):
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat == "Zs":
            table[o] = " "
        elif cat == "Cf" or (cat == "Cc" and ch not in "\t\n\r\x0b\x0c\x85") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D):
            table[o] = None
    words = LOOKALIKES.split()
    pairs = dict(zip(words[::2], words[1::2]))
    for a, b in extra.items():
        b = pairs.get(b, b)
        if a not in pairs and a not in pairs.values() and a != b:
            pairs[a] = b
    table.update({ord(a): b for a, b in pairs.items()})
    table.update({ord(h): "-" for h in HYPHENS.split()})
    table.update({ord(b): " " for b in BLANKS.split()})
    return table


class Mapper:
    """Text to comparison value. The tables are built once a process.

    `one` maps a code point whose value doesn't depend on its neighbours; texts that hold any other one take the slow way.
    """

    _table: dict[int, str | None] | None = None
    one: np.ndarray
    slow: np.ndarray
    letter: np.ndarray

    @classmethod
    def load(cls, extra: dict[str, str] | None = None) -> None:
        if cls._table is not None:
            return
        cls._table = _table(published() if extra is None else extra)
        n = sys.maxunicode + 1
        cls.one, cls.slow, cls.letter = np.arange(n, dtype=np.uint32), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for o in range(n):
            ch = chr(o)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co") or 0x20000 <= o < 0x2F800 or 0xAC00 <= o <= 0xD7A3:
                continue
            if cat == "Cs" or cat[0] == "M" and o in cls._table and cls._table[o] is None:
                cls.one[o] = 0
                continue
            value = cls.value(ch)
            if len(value) > 1 or cat[0] == "M" or 0x1100 <= o <= 0x11FF or unicodedata.combining(ch) or o in (0xFF9E, 0xFF9F):
                cls.slow[o] = True
            else:
                cls.one[o] = ord(value) if value else 0
        cls.letter = np.fromiter((chr(i).isalnum() for i in range(n)), dtype=bool, count=n)

    @classmethod
    def value(cls, text: str) -> str:
        """The slow way, for any text."""
        cls.load()
        t = cls._table
        once = unicodedata.normalize("NFKC", text).translate(t)
        # a representative may itself fold further, and marks may compose only after the mapping
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once).translate(t)).replace("\0", "")

    @classmethod
    def values(cls, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Values of all texts, and a 64-bit hash of each value's letters and digits."""
        cls.load()
        code, off = _codes(texts)
        odd = np.flatnonzero(cls.slow[code])
        if len(odd):
            texts = list(texts)
            for i in np.unique(np.searchsorted(off, odd, side="right") - 1):
                texts[i] = cls.value(texts[i])
            code, off = _codes(texts)
            again = np.where(cls.slow[code], code, cls.one[code])
        else:
            again = cls.one[code]
        keep = again != 0
        off = np.r_[0, np.cumsum(keep)][off]
        code = again[keep]
        whole = code.tobytes().decode("utf-32-le", "surrogatepass")
        ink = cls.letter[code]
        at = np.flatnonzero(ink)
        coff = np.r_[0, np.cumsum(ink)][off]
        size = np.diff(coff)
        hashes = np.zeros(len(texts), dtype=np.uint64)
        if len(at):
            power = np.cumprod(np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64))
            full = np.flatnonzero(size)
            nth = np.arange(len(at)) - np.repeat(coff[:-1], size)
            hashes[full] = np.add.reduceat((code[at].astype(np.uint64) + np.uint64(1)) * power[nth], coff[:-1][full])
        hashes ^= hashes >> np.uint64(32)
        return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], hashes.view(np.int64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]


def comparison_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, coarse, value) of the rows that have a text: the stored text's hash, a hash of its letters and digits, its comparison value."""

    extra = published()  # read once, so that all tasks map alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Mapper.load(extra)
        for b in batches:
            for a in range(0, len(b), 2_000):
                part = b.slice(a, 2_000)
                value, coarse = Mapper.values(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(coarse), pa.array(value)], names=["key", "stored", "coarse", "value"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("stored"), F.col(text).alias("text")).where("key is not null and text is not null")
    return spread(rows).mapInArrow(run, "key long, stored long, coarse long, value string")


def lookalike_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, class_id): rows of the classes that hold more than one stored text.

    A first pass over hashes finds the texts that agree with a differently stored one in letters and digits; the
    collation can't hold two values equal that differ there. Only those values are grouped under the collation, one row
    for each stored text, so that a text which holds a third of all rows weighs one row. Nulls take no part, repeated rows count once.
    """
    spark = df.sparkSession
    rows = materialise(comparison_values(df, key, text), "values")
    several = rows.groupBy("coarse").agg((F.min("stored") != F.max("stored")).alias("several")).where("several").select("coarse")
    kept = materialise(rows.join(several, "coarse", "left_semi"), "kept")
    discard(rows)
    once = spark.sql("SELECT stored, first(value) COLLATE UNICODE AS value FROM {k} GROUP BY stored", k=kept)
    classes = spark.sql("SELECT value, min(stored) AS class_id FROM {m} GROUP BY value HAVING count(*) > 1", m=once)
    ids = spark.sql("SELECT m.stored, c.class_id FROM {m} m JOIN {c} c ON m.value = c.value", m=once, c=classes)
    return kept.select("key", "stored").distinct().join(ids, "stored").select("key", "stored", "class_id")


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical, changed) for every row that has a key and a text: the canonical text of all texts that look like it.

    The canonical member of a class is the stored text that comes first by code point; a text that no other one looks like is its own.
    Repeated rows count once. An empty text is its own class with all texts that show nothing.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("stored")).where("key is not null and text is not null")
    ids = materialise(lookalike_members(df, key, text).select("stored", "class_id").distinct(), "classes")
    members = rows.join(ids, "stored").groupBy("class_id").agg(F.min("text").alias("canonical"))
    chosen = ids.join(members, "class_id").select("stored", "canonical")
    out = rows.join(chosen, "stored", "left").select("key", F.coalesce("canonical", "text").alias("canonical"), F.coalesce(F.col("canonical") != F.col("text"), F.lit(False)).alias("changed"))
    return out.dropDuplicates(["key", "canonical"])
