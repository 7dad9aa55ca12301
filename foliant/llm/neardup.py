"""Near-duplicate texts by Golay-code fuzzy hashing.

A text (lower case, letters and digits only) is a set of runs of five characters. 96 minimum hashes of that set make its
fingerprint; groups of four give 23-bit segments, six bits from each. At a likeness of 0.6 the errors of a pair are spread over
the segments, and some segment has few: a segment is decoded to the codewords of the Golay code nearby, whose messages are its keys. Two words that
differ in two bits or less always share one. A message alone has 12 bits, far too few for a large collection, so a key
joins it with two whole minimum hashes from elsewhere in the fingerprint; with that the pigeonhole bound holds for the segment only, and a pair is found with a
probability that depends on its likeness (measured: `recall_by_likeness` in the tests). Pairs in a bucket pass a 64-bit sketch and are then verified on
the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm import golay
from foliant.llm.hot import group_pairs
from foliant.runtime import materialise, spread

RUN, LEAST_CHARS, ALIKE = 5, 200, 0.6
HASHES, SEGMENTS, PER_SEGMENT, SEGMENT_BITS = 96, 24, 4, 6
SKETCH_BITS = 64
#: Bits of 64 in which the sketches of a pair may differ: at likeness 0.6 the mean is 13 with a deviation of 3.2.
SKETCH_ERRORS = 22

_rng = np.random.default_rng(23)
_MULT = (_rng.integers(0, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class Alnum:
    """Whether a code point is a letter or digit; built once a process."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            cls._table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
        return cls._table


def bare_texts(texts: list[str]) -> list[str]:
    """Lower case, letters and digits only."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = Alnum.table()[code]
    ends = np.r_[0, np.cumsum(keep)][np.cumsum([len(t) for t in low], dtype=np.int64)] if low else []
    whole = code[keep].tobytes().decode("utf-32-le", "surrogatepass")
    out, a = [], 0
    for b in ends:
        out.append(whole[a:b])
        a = int(b)
    return out


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of RUN characters, text after text, and where each text's begin. Texts have RUN characters or more."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    h = code[: len(code) - RUN + 1].copy()
    for j in range(1, RUN):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += code[j : len(code) - RUN + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ok = np.ones(len(h), dtype=bool)
    stops = np.cumsum(size)[:-1]
    for j in range(1, RUN):
        ok[stops - j] = False
    return h[ok], np.r_[0, np.cumsum(size - RUN + 1)][:-1]


def _bits(h: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return (h.astype(np.uint64) * np.uint64(multiplier) & np.uint64(0xFFFFFFFF)) >> np.uint64(16) & np.uint64((1 << bits) - 1)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sketch of each text, its bucket keys: texts x (SEGMENTS * 6), 0 where there is none)."""
    h, start = _runs(texts)
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.empty((HASHES, len(texts)), dtype=np.uint32)
    for i in range(HASHES):
        low[i] = np.minimum.reduceat(x * _MULT[i] + _PLUS[i], start)
    sketch = np.zeros(len(texts), dtype=np.uint64)
    for i in range(SKETCH_BITS):
        sketch = sketch << np.uint64(1) | _bits(low[i], 0xC2B2AE35, 1)
    keys = np.zeros((len(texts), SEGMENTS * golay.KEYS), dtype=np.int64)
    for s in range(SEGMENTS):
        word = np.zeros(len(texts), dtype=np.int64)
        for j in range(PER_SEGMENT):
            word = word << SEGMENT_BITS | _bits(low[s * PER_SEGMENT + j], 0x85EBCA6B, SEGMENT_BITS).astype(np.int64)
        near = golay.keys(word & ((1 << 23) - 1))
        whole = low[((s + 1) * PER_SEGMENT + 7) % HASHES].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low[((s + 1) * PER_SEGMENT + 12) % HASHES].astype(np.uint64)
        mixed = (near.astype(np.uint64) + np.uint64(s << 12)) * np.uint64(0xD6E8FEB86659FD93) ^ (whole * np.uint64(0xA0761D6478BD642F))[:, None]
        keys[:, s * golay.KEYS : (s + 1) * golay.KEYS] = np.where(near >= 0, (mixed ^ mixed >> np.uint64(31)).view(np.int64) | 1, 0)
    return sketch.view(np.int64), keys


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Shared over all members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def _sets(texts: dict[int, bytes]) -> dict[int, np.ndarray]:
    """The run set of each compressed text, sorted; all texts hashed in one go."""
    if not texts:
        return {}
    h, start = _runs([zlib.decompress(z).decode("utf-8", "surrogatepass") for z in texts.values()])
    out = {}
    for c, x, y in zip(texts, start.tolist(), [*start[1:].tolist(), len(h)]):
        own = np.sort(h[x:y])
        out[c] = own[np.r_[True, own[1:] != own[:-1]]]
    return out


def _prepared(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, owner, c, z): class of the bare text (64 bits of its BLAKE2 hash) and the bare text itself, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 1_000) for whole in batches for a in range(0, len(whole), 1_000)):
            bare = bare_texts(batch.column(2).to_pylist())
            at = [i for i, t in enumerate(bare) if len(t) >= LEAST_CHARS]
            raw = [bare[i].encode("utf-8", "surrogatepass") for i in at]
            c = np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=8).digest() for r in raw), dtype=np.int64)
            pick = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick).cast(pa.string()), batch.column(1).take(pick).cast(pa.string()), pa.array(c), pa.array([zlib.compress(r, 1) for r in raw], type=pa.binary())], names=["key", "owner", "c", "z"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text")).where("key is not null and text is not null")
    return spread(rows).mapInArrow(run, "key string, owner string, c long, z binary")


def similar_classes(df: DataFrame, key: str, owner: str, text: str, cross_owner: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership (key, owner, c) and the pairs (a, b, likeness), a < b, of different classes at ALIKE or more.

    A class holds the rows whose bare texts are equal. Null keys, null texts and texts under LEAST_CHARS letters and
    digits belong to none; repeated rows count once; a null owner is an owner of its own kind. No pair of classes is left out
    for the size of a bucket. The likeness is exact. With cross_owner, pairs of classes within one and the same owner are left out.
    """
    prepared = materialise(_prepared(df, key, owner, text), "texts")
    members = prepared.select("key", "owner", "c").distinct()
    texts = prepared.groupBy("c").agg(F.first("z").alias("z"))

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 1_000) for whole in batches for a in range(0, len(whole), 1_000)):
            sketch, keys = fingerprints([zlib.decompress(z).decode("utf-8", "surrogatepass") for z in batch.column(1).to_pylist()])
            who, at = np.nonzero(keys)
            c = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[who, at]), pa.array(c[who]), pa.array(sketch[who])], names=["k", "c", "s"])

    buckets = texts.mapInArrow(fingerprint, "k long, c long, s long")
    a, b = buckets.alias("a"), buckets.alias("b")
    met = a.join(b, F.expr(f"a.k = b.k and a.c < b.c and bit_count(a.s ^ b.s) <= {SKETCH_ERRORS}"))
    pairs = met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()
    if cross_owner:  # classes that lie within one owner together hold no pair of two
        own = members.groupBy("c").agg(F.when(F.coalesce(F.min("owner") == F.max("owner"), F.lit(False)) & (F.count("owner") == F.count("*")), F.min("owner")).alias("own"))
        pairs = pairs.join(own.select(F.col("c").alias("a"), F.col("own").alias("oa")), "a").join(own.select(F.col("c").alias("b"), F.col("own").alias("ob")), "b")
        pairs = pairs.where("oa is null or ob is null or oa <> ob").select("a", "b")
    pairs = materialise(pairs, "pairs")
    texts = prepared.groupBy("c").agg(F.first("z").alias("z"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, len(whole), 500)):
            a, b, za, zb = (batch.column(i).to_pylist() for i in range(4))
            texts = dict(zip(a, za)) | dict(zip(b, zb))
            sets = {c: x for c, x in sets.items() if c in texts}  # what the part before had as well
            sets |= _sets({c: z for c, z in texts.items() if c not in sets})
            like = np.array([_likeness(sets[i], sets[j]) for i, j in zip(a, b)], dtype=np.float64)
            keep = pa.array(like >= ALIKE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like).filter(keep)], names=["a", "b", "likeness"])

    both = pairs.join(texts.select(F.col("c").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("c").alias("b"), F.col("z").alias("zb")), "b")
    return members, both.select("a", "b", "za", "zb").mapInArrow(verify, "a long, b long, likeness double")


def similar_pairs(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(a, b), a < b: all pairs of rows of different owners whose texts are alike, members of one class included."""
    members, links = similar_classes(df, key, owner, text, cross_owner=True)
    members = materialise(members, "members")
    equal = group_pairs(members, "c", "key", "a.key < b.key and not (a.owner <=> b.owner)").select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    x, y = members.select(F.col("key").alias("x"), F.col("owner").alias("ox"), F.col("c").alias("a")), members.select(F.col("key").alias("y"), F.col("owner").alias("oy"), F.col("c").alias("b"))
    rows = links.select("a", "b").join(x, "a").join(y, "b").where(F.expr("not (ox <=> oy) and x <> y"))
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(equal).distinct()


def classes_with_links(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, class_id, copies, links): every row that takes part, with the smallest key of its class, the class's size and its number of similar classes."""
    members, links = similar_classes(df, key, owner, text)
    members = materialise(members, "members")
    ends = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    sizes = members.groupBy("c").agg(F.min("key").alias("class_id"), F.countDistinct("key").alias("copies")).join(ends, "c", "left")
    return members.select("key", "c").distinct().join(sizes, "c").select("key", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
