import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from foliant.llm import packing


@given(st.lists(st.integers(1, 30), max_size=12), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_fullest_against_all_subsets(items, room):
    counts = {v: items.count(v) for v in set(items)}
    got = packing.fullest(room, np.array(sorted(counts, reverse=True), dtype=np.int64), counts)
    sums = {0}
    for v in items:
        sums |= {s + v for s in sums}
    assert sum(got) == max(s for s in sums if s <= room)
    assert all(got.count(v) <= counts[v] for v in set(got))


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=150, deadline=None)
def test_bins_hold_everything_once(sizes):
    b = packing.minimum_slack(np.array(sizes, dtype=np.int64), 50)
    fill = np.bincount(b, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 50).all() and fill.sum() == sum(sizes) and len(b) == len(sizes)


def test_containers_in_spark(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 60)
    r = random.Random(4)
    sizes = [(i, r.choice([r.randint(1, 99), 40, 250])) for i in range(300)] + [(900, 0), (901, 100), (902, 200)]
    df = spark.createDataFrame([(a, b, "x") for a, b in sizes], "item long, tokens long, container string")
    caps = spark.createDataFrame([(1, "p", 100), (2, "q", 64), (3, "r", None), (1, "again", 100), (4, "z", 0)], "budget_id long, purpose string, capacity_tokens int")
    rows = packing.fill_containers(df.select("item", "tokens"), caps).collect()
    for budget, cap in ((1, 100), (2, 64)):
        mine = [x for x in rows if x["budget_id"] == budget]
        per, fill = {}, {}
        for x in mine:
            per.setdefault(x["item"], []).append(x)
            fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
        assert max(fill.values()) <= cap and {k: sum(x["tokens"] for x in v) for k, v in per.items()} == {i: t for i, t in sizes if t}
        assert all(len(v) == -(-sum(x["tokens"] for x in v) // cap) == v[0]["pieces"] for v in per.values())
        rest = np.array([t % cap for _, t in sizes if t % cap])
        whole = sum(t // cap for _, t in sizes)
        assert len(fill) <= 1.05 * (whole + int(packing.minimum_slack(rest, cap).max()) + 1) + 1
    assert {x["budget_id"] for x in rows} == {1, 2}
    assert packing.fill_containers(df.select("item", "tokens").where("false"), caps).count() == 0
    assert packing.fill_containers(df.select("item", "tokens"), caps.where("false")).count() == 0


def test_token_counts(spark):
    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (None, "x"), (3, ""), (1, "hello world"), (4, "長い" * 5000)], "doc_id long, text string")
    got = {r["item"]: r["tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}
    enc = packing._encoding(packing.TOKENIZER)
    assert got == {1: len(enc.encode_ordinary("hello world")), 3: 0, 4: len(enc.encode_ordinary("長い" * 5000))}
