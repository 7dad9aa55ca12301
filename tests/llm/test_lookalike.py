import unicodedata

from foliant.llm import lookalike
from foliant.llm.lookalike import Mapper

SAME = [
    ("ABC 123", "ＡＢＣ　１２３"),
    ("ガイド", "ｶﾞｲﾄﾞ"),
    ("ガイド", unicodedata.normalize("NFD", "ガイド")),
    ("déjà", unicodedata.normalize("NFD", "déjà")),
    ("file", "ﬁle"),
    ("a b", "a b"),
    ("ab", "a​b﻿"),
    ("co-op", "co‐op"),
    ("paper", "рареr"),
    ("ロボット", "口ボット"),
    ("日本", "⽇本"),
    ("二", "ニ"),
    ("soft", "so­ft"),
    ("AAo", "Ꭺꓮσ"),
    ("oivG", "ⲟɩѵԌ"),
]
DIFFERENT = [("abc", "ABC"), ("resume", "résumé"), ("か", "が"), ("1", "2"), ("a.b", "a,b"), ("ab", "a b"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("", "a"), ("は", "ぱ")]


def test_values():
    for a, b in SAME:
        assert Mapper.value(a) == Mapper.value(b), (a, b)
    for a, b in DIFFERENT:
        assert Mapper.value(a) != Mapper.value(b), (a, b)
    texts = [x for p in SAME + DIFFERENT for x in p]
    assert Mapper.values(texts)[0] == [Mapper.value(t) for t in texts]


def test_classes_in_spark(spark):
    rows = [(2 * i + j, t, 9) for i, p in enumerate(SAME + DIFFERENT) for j, t in enumerate(p)] + [(900, None, 1), (0, SAME[0][0], 9), (901, SAME[0][0], 1), (902, "", 1), (903, "​", 1)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, value int")
    m = lookalike.lookalike_members(df, "chunk_id", "text").collect()
    by = {}
    for r in m:
        by.setdefault(r["class_id"], set()).add(r["key"])
    classes = {frozenset(v) for v in by.values()}
    for i in range(len(SAME)):
        mates = next(c for c in classes if 2 * i in c)
        assert 2 * i + 1 in mates
    assert any({0, 1, 901} <= c for c in classes) and not any(900 in c for c in classes) and any({902, 903} <= c for c in classes)
    got = {(r["key"], r["canonical"]) for r in lookalike.canonical_texts(df, "chunk_id", "text").collect()}
    one = dict(got)
    assert len(got) == len(one) and one[0] == one[1] == one[901] and 900 not in one
    for i, (a, b) in enumerate(DIFFERENT):
        if "" not in (a, b):
            assert one[2 * (len(SAME) + i)] != one[2 * (len(SAME) + i) + 1], (a, b)
    assert lookalike.lookalike_members(df.where("false"), "chunk_id", "text").count() == 0
