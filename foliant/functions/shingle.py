"""Shingles, 48-bit similarity hashes and set likeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SHINGLE, BITS = 3, 48
MASK = (1 << BITS) - 1
# FNV-1a for 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Runs of n words joined by spaces, repeats kept; all words as one where there are fewer; empty for none."""
    size = F.size(words)
    # neighbours side by side: a lambda that reached back into `words` would evaluate it for every element
    room = F.greatest(F.lit(0), size - (n - 1))
    runs = F.transform(F.arrays_zip(*(F.slice(words, i, room).alias(f"w{i}") for i in range(1, n + 1))), lambda x: F.concat_ws(" ", *(x[f"w{i}"] for i in range(1, n + 1))))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(words, " "))).otherwise(runs)


def _fnv48(items: list[str]) -> np.ndarray:
    """Low 48 bits of FNV-1a over the UTF-16 units of each string, all strings in lockstep."""
    raw = [s.encode("utf-16-le", "surrogatepass") for s in items]
    size = np.array([len(r) // 2 for r in raw])
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), dtype=np.uint16).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    sorted_size = size[order]
    h = np.full(len(items), FNV_OFFSET, dtype=np.uint64)
    for k in range(int(sorted_size[0]) if len(items) else 0):
        live = int(np.searchsorted(-sorted_size, -k, side="left"))
        h[:live] = (h[:live] ^ data[start[:live] + k]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out & np.uint64(MASK)


def simhash_of(groups: list[list[str]]) -> np.ndarray:
    """Similarity hash of each list of shingles: a bit is set where more of the hashes have it than lack it; 0 for none."""
    flat = [s for g in groups for s in g]
    h = _fnv48(flat)
    n = np.array([len(g) for g in groups])
    who = np.repeat(np.arange(len(groups)), n)
    out = np.zeros(len(groups), dtype=np.int64)
    for b in range(BITS):
        ones = np.bincount(who, weights=(h >> np.uint64(b)) & np.uint64(1), minlength=len(groups))
        out |= (ones * 2 > n).astype(np.int64) << b
    return out


@F.pandas_udf(T.LongType())
def simhash48(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """48-bit similarity hash of arrays of shingles; null for null."""
    for s in batches:
        has = s.notna()
        out = pd.Series([None] * len(s), dtype="Int64")
        if has.any():
            out[has.to_numpy()] = simhash_of([list(x) for x in s[has]])
        yield out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays as sets; 0 if both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(both / all_)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)
