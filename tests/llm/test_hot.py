from foliant.llm import hot


def test_pairs_of_hot_groups_are_whole(spark):
    rows = [(i, "g" if i < 25 else f"h{i % 7}") for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "key long, grp string")
    want = {(a, b) for a, g in rows for b, h in rows if a < b and g == h and g is not None}
    for size in (hot.HOT, 4):
        hot.HOT, kept = size, hot.HOT
        got = [(r["a"]["key"], r["b"]["key"]) for r in hot.group_pairs(df, "grp", "key", "a.key < b.key").collect()]
        hot.HOT = kept
        assert sorted(got) == sorted(want)
    assert hot.group_pairs(df.where("false"), "grp", "key", "a.key < b.key").count() == 0
