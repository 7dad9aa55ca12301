import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foliant.functions import freshness as fr
from foliant.functions import segment, shingle
from foliant.functions.highlight import excerpts, find_hits, fold_with_map, highlight
from foliant.functions.quality import needs_fallback, quality
from foliant.functions.text import accepted, extension, human_bytes, mime_type, nfkc, slug, strip_anchors, title_from_filename, trim, utf16_length


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_words_keep_order_repeats_and_drop_stopwords(spark):
    assert one(spark, segment.words(F.lit("The fire desk, THE Fire desk 2024"))) == ["the", "fire", "desk", "the", "fire", "desk", "2024"]
    assert one(spark, segment.words(F.lit("残業 の 申請"))) == ["残業", "申請"]
    assert one(spark, segment.words(F.lit("!?"))) == [] and one(spark, segment.words(F.lit(None).cast("string"))) is None


def test_match_expression():
    assert segment.match_expression(["インジェクション", "or", "1", "1"]) == '"インジェクション" AND "or" AND "1" AND "1"'
    assert segment.match_expression(['a"b']) == '"a""b"' and segment.match_expression([]) is None


def test_icu_profile(spark):
    assert segment.query_terms(spark, "残業申請", "icu") == ["残業", "申請"]
    assert segment.check_segmenter(spark) >= segment.DIAGNOSTIC_WORDS
    assert "iso27001" in segment.query_terms(spark, "ISO27001を京都で", "icu")
    with pytest.raises(RuntimeError):
        segment.check_segmenter(spark, "simple")


def fnv48(s):
    h = shingle.FNV_OFFSET
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * shingle.FNV_PRIME % 2**64
    return h & shingle.MASK


@given(st.lists(st.text(max_size=12), max_size=8))
@settings(max_examples=60, deadline=None)
def test_fnv_and_simhash_against_plain_model(items):
    assert shingle._fnv48(items).tolist() == [fnv48(s) for s in items]
    h = [fnv48(s) for s in items]
    want = sum(1 << b for b in range(48) if sum(1 if x >> b & 1 else -1 for x in h) > 0) if h else 0
    assert shingle.simhash_of([items]).tolist() == [want]


def test_shingles_and_likeness(spark):
    a = F.array(*map(F.lit, "a b c d".split()))
    assert one(spark, shingle.shingles(a)) == ["a b c", "b c d"]
    assert one(spark, shingle.shingles(F.array(F.lit("a"), F.lit("b")))) == ["a b"]
    none = F.array().cast("array<string>")
    assert one(spark, shingle.shingles(none)) == [] and one(spark, shingle.jaccard(none, none)) == 0 and one(spark, shingle.containment(none, a)) == 0
    assert one(spark, shingle.jaccard(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")))) == pytest.approx(1 / 3)
    assert one(spark, shingle.containment(F.array(F.lit("y")), F.array(F.lit("y"), F.lit("z")))) == 1
    assert one(spark, shingle.hamming(F.lit(5), F.lit(6))) == 2
    rows = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "i int, s array<string>").select("i", shingle.simhash48("s").alias("h")).orderBy("i").collect()
    assert [r["h"] for r in rows] == [fnv48("a"), None, 0]


def test_text_columns(spark):
    assert one(spark, utf16_length(F.lit("a𠮷b"))) == 4
    assert one(spark, trim(F.lit("　 a b \n"))) == "a b"
    assert one(spark, strip_anchors(F.lit("<!-- page:1 -->\nA\n<!-- sheet:x -->\nB"))) == "A\n\nB"
    assert one(spark, title_from_filename(F.lit("a.b.docx"))) == "a.b" and one(spark, extension(F.lit("x"))) == ""
    assert one(spark, accepted(F.lit("X.PDF"))) and not one(spark, accepted(F.lit("x.constructor")))
    assert one(spark, mime_type(F.lit("x.pdf"))) == "application/pdf" and one(spark, mime_type(F.lit("x.txt"))) is None
    assert [one(spark, human_bytes(F.lit(n))) for n in (1023, 1024, 1048576, None)] == ["1023 B", "1.0 KB", "1.0 MB", None]
    assert one(spark, slug(F.lit(3), F.lit("3.1 交通費!"))) == "h-3-3-1-交通費" and one(spark, slug(F.lit(0), F.lit("!!"))) == "h-0-section"
    assert one(spark, nfkc(F.lit("Ａ㍿"))) == "A株式会社"


def test_quality(spark):
    good = "これは正常に抽出された本文です。" * 30
    q = lambda pages: one(spark, quality(pages))
    assert q(F.array(F.lit(good)))["confidence"] >= 0.6
    scan = q(F.array(F.lit(""), F.lit(" "), F.lit("")))
    assert scan["confidence"] < 0.6 and scan["blank_page_ratio"] == 1 and one(spark, needs_fallback(F.lit(scan["confidence"])))
    bad = q(F.array(F.lit(good + "�(cid:12)" * 20)))
    assert bad["garbled_ratio"] > 0.005 and bad["confidence"] < q(F.array(F.lit(good)))["confidence"]
    for pages in (F.lit(None).cast("array<string>"), F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))):
        assert q(pages)["garbled_ratio"] == 1 and q(pages)["text_length"] == 0
    assert q(F.array(F.lit("あ" * 3001)))["has_structure"] is False


def test_freshness(spark):
    def score(kind, age, overdue=None, owner=True, superseded=False, low=False):
        return one(spark, fr.freshness(F.lit(kind), F.lit(age), F.lit(overdue).cast("long"), F.lit(owner), F.lit(superseded), F.lit(low)))

    assert score("regulation", 0) == 100 and score("regulation", 730) == pytest.approx(50) and score("minutes", 9999) == 100
    assert score("regulation", 0, 200, False, True, True) == 30 and score("manual", 99999, 200, False, True, True) == 0
    assert score(None, 540) == pytest.approx(50)
    assert [one(spark, fr.band(F.lit(s))) for s in (100.0, 80.0, 79.9, 50.0, 49.9)] == ["healthy", "healthy", "review", "review", "action"]
    none = F.lit(None).cast("long")
    assert one(spark, fr.review_due(F.lit("manual"), none, none, none, F.lit(0))) == 180 * fr.DAY
    assert one(spark, fr.review_due(F.lit("manual"), F.lit(10), F.lit(5), F.lit(7), F.lit(0))) == 5 + 10 * fr.DAY
    assert one(spark, fr.review_due(F.lit("slide"), none, none, none, F.lit(0))) is None
    assert one(spark, fr.days_between(F.lit(fr.DAY * 3), F.lit(0))) == 0


def spans(text, terms):
    h = find_hits(text, terms)
    return list(zip(h.start.tolist(), h.end.tolist(), h.term.tolist()))


def test_highlight(spark):
    flat, at = fold_with_map("Ｐａｓｓｗｏｒｄは禁止")
    assert flat == "passwordは禁止" and at[8] == 8
    flat, at = fold_with_map("㍿Alpha")
    assert flat == "株式会社alpha" and at[flat.index("alpha")] == 1
    text = "出張時の日当は2,500円とする。宿泊費は実費精算。"
    assert [text[s:e] for s, e, _ in spans(text, ["日当", "精算"])] == ["日当", "精算"]
    assert spans("abcd", ["ab", "cd"]) == [(0, 4, 0)] and spans("ab cd", ["cd", "ab"]) == [(0, 2, 1), (3, 5, 0)]
    assert spans("㍿", ["会社"]) == [(0, 1, 0)]
    got = excerpts("前文。" * 50, find_hits("", []))
    assert len(got) == 1 and got[0]["offset"] == 0 and len(got[0]["segments"][0]["text"]) == 150
    text = "x" * 300 + "申請" + "y" * 300 + "提出 申請"
    got = excerpts(text, find_hits(text, ["申請", "提出"]), 50, 1)
    assert got[0]["offset"] > 500 and {s["text"] for s in got[0]["segments"] if s["hit"]} == {"提出", "申請"}
    assert "".join(s["text"] for s in got[0]["segments"]) == text[got[0]["offset"] : got[0]["offset"] + 50]
    df = spark.createDataFrame([("残業の申請", ["申請"]), (None, ["a"]), ("abc", None)], "t string, q array<string>")
    rows = df.select(highlight(F.col("t"), F.col("q")).alias("h")).collect()
    assert rows[0]["h"][0]["segments"][-1]["hit"] and rows[1]["h"] is None and rows[2]["h"][0]["offset"] == 0


def test_simhash_distances():
    words = lambda s: [" ".join(s.split()[i : i + 3]) for i in range(max(1, len(s.split()) - 2))]
    base = " ".join(f"w{random.Random(i).randint(0, 500)}" for i in range(400))
    near = base.replace("w7 ", "w8 ", 2)
    far = " ".join(f"v{i}" for i in range(400))
    a, b, c = shingle.simhash_of([words(base), words(near), words(far)]).tolist()
    assert (a ^ b).bit_count() < 15 < (a ^ c).bit_count() + 10 and math.isfinite(a) and np.all(np.array([a, b, c]) < 2**48)
