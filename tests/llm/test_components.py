import random

import pytest

from foliant.llm import components


def union_find(pairs):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            p[find(a)] = find(b)
    groups = {}
    for x in list(p):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("salts", [1, 4])
def test_groups_equal_union_find(spark, salts):
    r = random.Random(salts)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)] + [(f"r{r.randint(0, 80)}", f"r{r.randint(0, 80)}") for _ in range(50)]
    pairs += [(None, "a"), ("a", None), ("z", "z"), ("c1", "c0"), ("c0", "c1")]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, member string")
    got = {x["member"]: x["group_id"] for x in components.connected_groups(df, "a", "b", salts, hub=3).collect()}
    assert got == union_find(pairs)


def test_no_links(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "b")], "a string, b string")
    assert components.connected_groups(df, "a", "b").count() == 0
    assert components.connected_groups(df.where("false"), "a", "b").columns == ["member", "group_id"]


def test_counting_links(spark):
    rows = [("a", "b", " Near-Dup ", "open"), ("a", "c", "similar", "open"), ("a", "d", "exact_dup", "dismissed"), ("a", "a", "exact_dup", "open"), (None, "a", "exact_dup", "open"), ("a", "e", None, "open"), ("a", "f", "REVISION_OF", None)]
    df = spark.createDataFrame(rows, "a_version_id string, b_version_id string, kind string, status string")
    assert sorted(r["b_version_id"] for r in components.counting_links(df).collect()) == ["b", "f"]
