import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid


def model_bits(trees_text, order, text):
    """Code length by walking one context tree as the definition says."""
    data = langid.FOLD[np.frombuffer(trees_text.encode(), dtype=np.uint8)].tolist()
    counts = {}
    for i in range(len(data)):
        for k in range(0, order + 1):
            if i >= k:
                c = tuple(data[i - k : i])
                counts.setdefault(c, {})
                counts[c][data[i]] = counts[c].get(data[i], 0) + 1
    x = langid.FOLD[np.frombuffer(text.encode(), dtype=np.uint8)].tolist()
    known = {c for c in counts if not c or sum(counts[c].values()) >= 3}
    total = 0.0
    for i, b in enumerate(x):
        k = next(k for k in range(min(order, i), -1, -1) if tuple(x[i - k : i]) in known)
        while True:
            c = counts[tuple(x[i - k : i])]
            n, d = sum(c.values()), len(c)
            if b in c:
                total += np.log2((n + d) / c[b])
                break
            total += np.log2((n + d) / d)
            if k == 0:
                total += 8
                break
            k -= 1
    return total


def test_code_length_follows_the_definition():
    text = "the cat sat on the mat and the dog sat on the cat " * 4
    t = langid.Trees.fit({"en": [text]}, max_order=3)
    for probe in ("the cat sat", "dogs and cats", "zebra", "x" * 500):
        data = langid.FOLD[np.frombuffer(probe.encode(), dtype=np.uint8)]
        got = t.bits(data, np.array([0]), np.array([len(data)]))[0, 0]
        if len(data) <= langid.SPAN:
            assert got == pytest.approx(model_bits(text, 3, probe), abs=len(data) / langid.QUANT)
        assert got > 0


def test_labels(spark):
    rows = [(x,) for x in ("EN", "ja-JP", "deu", "Español", " pt_BR ", "日本語", "und", "", "??", None, "n/a", "nl", "xx", "-")]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(langid.canonical_label(F.col("l"))).collect()]
    assert got == ["en", "ja", "de", "es", "pt", "ja", None, None, None, None, None, "nl", None, None]


@pytest.fixture(scope="module")
def trees(spark, sf):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test data")
    return langid.fit_trees(spark.read.parquet(f"{d}/documents.parquet"))


def test_mixed_missing_and_odd_documents(spark, trees):
    en, ja, es = "The supply desk must reach Logistics within five working days. ", "夜間に届いた台帳は翌朝に開封し、受付時刻を転記する。", "Las cifras erróneas se tachan y el motivo se apunta al margen. "
    rows = [(1, en * 3 + ja * 3, "en"), (2, en * 4 + "“チェック”", "en"), (3, es, None), (4, "", "en"), (5, None, "en"), (6, " \n", ""), (7, en * 3 + ja, "en"), (8, "Ｔｈｅ ｓｕｐｐｌｙ ｄｅｓｋ ｉｓ ｏｐｅｎ ｔｏｄａｙ．", "EN"), (9, ja * 3000, "zh"), (10, "12345", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, label string")
    got = {r["doc_id"]: r for r in langid.identify(df, trees, segments=True).collect()}
    assert got[1]["languages"] == ["en", "ja"] and got[2]["languages"] == ["en"] and got[3]["languages"] == ["es"] and got[7]["languages"] == ["en"]
    assert got[4]["languages"] == got[5]["languages"] == got[6]["languages"] == [] and got[4]["lang"] is None
    assert got[8]["languages"] == ["en"] and got[9]["lang"] == "ja" and got[9]["label"] == "zh" and len(got[10]["languages"]) == 1
    s = got[1]["segments"]
    assert (en * 3 + ja * 3)[s[0]["start"] : s[0]["end"]] == en.strip() and s[-1]["lang"] == "ja" and all(0 <= x["confidence"] <= 1 for x in s)
    assert langid.identify(df.where("false"), trees).count() == 0
    with pytest.raises(ValueError):
        langid.fit_trees(df.where("false"))


def test_held_out_accuracy(trees):
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"]).to_pylist()
    raw, lab = [], []
    for r in t[::7]:
        if r["lang"] in langid.LANGS:
            raw.append(r["text"].encode())
            lab.append(r["lang"])
    got = langid._summaries(trees, np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], False)
    same = [a in n for a, n in zip(lab, got["languages"])]
    assert np.mean(same) > 0.88  # the rest are wrong labels
