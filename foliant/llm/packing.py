"""Filling containers of fixed capacity: minimum bin slack.

A container opens with the longest text left; the fullest feasible combination of the remaining lengths for the rest of its room is
found by subset-sum dynamic programming over a bitset (bit i: a sum of i can be reached) and taken out. Texts longer than a
container are cut into full pieces and a remainder, the only texts that are divided. The collection is dealt by hash
into groups that one task packs; what a group can't close tightly goes on to a further round among the rest of all groups.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.runtime import materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items a task packs at once; a container leaves its group only while it has more free room than SLACK of its capacity.
GROUP_ITEMS, SLACK, ROUNDS, MAX_BUDGETS = 20_000, 0.004, 8, 1_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, tokens): tokens of each whole text. Null keys and texts are left out, an empty text has none; repeated keys count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64())], names=["item", "tokens"])

    rows = docs.select(F.col(key).cast("long").alias("item"), F.col(text).alias("t")).where("item is not null and t is not null")
    return spread(rows).mapInArrow(run, "item long, tokens long").dropDuplicates(["item"])


def fullest(room: int, lengths: np.ndarray, counts: dict[int, int]) -> list[int]:
    """A combination of the available lengths (descending) whose sum is the largest that fits the room."""
    if room <= 0:
        return []
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for v in lengths[np.searchsorted(-lengths, -room) :].tolist():
        c = counts[v]
        have, left, power = reach, min(c, room // v), 1
        while left > 0 and have:  # binary splitting of the copies
            k = min(power, left)
            before = have
            have |= (have << (k * v)) & mask
            steps.append((v, k, before))
            left -= k
            power *= 2
        reach = have
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: list[int] = []
    for v, k, before in reversed(steps):
        if not before >> total & 1:
            out += [v] * k
            total -= k * v
    return out


def minimum_slack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item (sizes 1..capacity), by minimum bin slack with the longest item left as the seed."""
    order = np.argsort(-sizes, kind="stable")
    by: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        by.setdefault(int(sizes[i]), []).append(i)
    counts = {v: len(x) for v, x in by.items()}
    lengths = np.array(sorted(by, reverse=True), dtype=np.int64)
    bins = np.zeros(len(sizes), dtype=np.int64)
    number = top = 0
    while len(lengths):
        while top < len(lengths) and not counts[int(lengths[top])]:
            top += 1
        if top >= len(lengths):
            break
        if top > 64:
            lengths = np.array([v for v in lengths.tolist() if counts[v]], dtype=np.int64)
            top = 0
            if not len(lengths):
                break
        seed = int(lengths[top])
        counts[seed] -= 1
        live = lengths[top:]
        taken = [seed, *fullest(capacity - seed, live, counts)]
        for v in taken[1:]:
            counts[v] -= 1
        for v in taken:
            bins[by[v].pop()] = number
        number += 1
        if number % 256 == 0:
            lengths = np.array([v for v in lengths.tolist() if counts[v]], dtype=np.int64)
            top = 0
    return bins


def _pack(items: DataFrame) -> DataFrame:
    """One round: (budget_id, capacity, item, piece, tokens, container string, fill)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["tokens", "item", "piece"], ascending=[False, True, True], ignore_index=True)
        b = minimum_slack(pdf["tokens"].to_numpy(dtype=np.int64), cap)
        fill = np.bincount(b, weights=pdf["tokens"]).astype(np.int64)
        first = np.zeros(int(b.max()) + 1, dtype=np.int64)
        first[b[::-1]] = np.arange(len(b))[::-1]
        name = pdf["item"].astype(str) + "-" + pdf["piece"].astype(str)
        return pdf.assign(container=name.to_numpy()[first[b]], fill=fill[b])[["budget_id", "capacity", "item", "piece", "tokens", "container", "fill"]]

    return items.groupBy("budget_id", "grp").applyInPandas(run, "budget_id long, capacity long, item long, piece int, tokens long, container string, fill long")


def fill_containers(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, container, item, piece, pieces, tokens, capacity): every item in one container of each capacity.

    `sizes`: (item, tokens); `budgets`: (budget_id, capacity_tokens), a small fixed table. An item that alone exceeds the capacity comes as
    full pieces and a remainder; no other is divided. Items without tokens take part in no container. `container` is the key of its
    first item. Budgets without a positive capacity are left out. Nothing is dropped: loose containers are packed again with
    each other over all groups, until few are left.
    """
    caps = budgets.select(F.col("budget_id").cast("long").alias("budget_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("budget_id is not null and capacity > 0")
    rows = caps.groupBy("budget_id").agg(F.min("capacity").alias("capacity")).orderBy("budget_id").limit(MAX_BUDGETS + 1).collect()
    if len(rows) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets; fill them in several calls")
    none = F.array().cast("array<struct<budget_id:bigint,capacity:bigint>>")
    wanted = F.array(*(F.struct(F.lit(r[0]).cast("long").alias("budget_id"), F.lit(r[1]).cast("long").alias("capacity")) for r in rows)) if rows else none
    base = materialise(sizes.where("tokens > 0"), "sizes")
    n = base.count()
    groups = max(1, -(-n // GROUP_ITEMS))
    each = base.select("item", "tokens", F.explode(wanted).alias("w")).select("item", "tokens", "w.budget_id", "w.capacity")
    cut = each.withColumn("pieces", F.expr("cast(ceil(tokens / capacity) as int)"))
    pieces = cut.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).withColumn("tokens", F.expr("least(tokens - piece * capacity, capacity)"))
    pieces = pieces.select("budget_id", "capacity", "item", "piece", "tokens")
    full = pieces.where("tokens = capacity").select("budget_id", "capacity", "item", "piece", "tokens", F.concat_ws("-", F.col("item").cast("string"), F.col("piece").cast("string")).alias("container"), F.col("tokens").alias("fill"))
    open_items = pieces.where("tokens < capacity")
    done = [full]
    for turn in range(ROUNDS):
        dealt = open_items.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "item", "piece"), F.lit(groups)))
        packed = materialise(_pack(dealt), "packed")
        if groups == 1 or turn == ROUNDS - 1:
            done.append(packed)
            break
        tight = F.col("fill") >= F.col("capacity") * (1 - SLACK)
        done.append(packed.where(tight))
        open_items = packed.where(~tight).select("budget_id", "capacity", "item", "piece", "tokens")
        left = open_items.groupBy("budget_id").count().agg(F.max("count")).first()[0] or 0
        if not left:
            break
        groups = max(1, min(groups // 2, -(-left // GROUP_ITEMS)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    total = base.select("item", F.col("tokens").alias("whole"))
    out = out.join(total, "item").withColumn("pieces", F.expr("cast(ceil(whole / capacity) as int)"))
    return out.select("budget_id", "container", "item", "piece", "pieces", "tokens", "capacity")
