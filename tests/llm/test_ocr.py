import math
import os
import random
import re
from collections import Counter
from itertools import islice, product

import pytest

from foliant.llm import ocr

WORDS = "the annual report shows how every department handles training equipment and archive material before the internal audit closes its warehouse inventory review".split()


def book(seed, pages=6, lines=12):
    r = random.Random(seed)
    return [[" ".join(r.choices(WORDS, k=7)) + "." for _ in range(lines)] for _ in range(pages)]


def model_from(pages, **extra):
    """A model of plain Python: every entry known, each confusion at one price, words that confusions make of frequent ones told from their counts."""
    n, _ = ocr.count_pages([pages])
    n.update(extra.get("more", {}))
    words = {k[1:]: c for k, c in n.items() if k[0] == "w"}
    total = sum(words.values()) or 1
    seen = {k: ocr.Entry(float(c)) for k, c in n.items()}
    for w, c in words.items():
        same = [(math.log(total / m) + 6.0 * len(ops), a, ops[0][1], m) for a, m in words.items() if m > c and m >= 3 and ocr.skeleton(a) == ocr.skeleton(w) and (ops := ocr.confusions(w, a))]
        if same:
            price, meant, at, m = min(same)
            seen["w" + w] = ocr.Entry(max(0.0, c - 20 * m * math.exp(-6.0)), meant, price, at)
    grams, heads = Counter(), Counter()
    for w, c in words.items():
        if w.isalpha() and seen["w" + w].meant is None:
            s = "^^" + w + "$"
            for i in range(2, len(s)):
                grams[s[i - 2 : i + 1]] += min(c, 8)
                heads[s[i - 2 : i]] += min(c, 8)
    letters = {g: math.log((c + 0.02) / (heads[g[:2]] + 1.2)) for g, c in grams.items()}
    certain = frozenset(w for w in words if seen["w" + w].meant is None)
    return ocr.Model(seen, total, [6.0] * len(ocr.OPS), letters, dict(heads), certain)


@pytest.fixture(scope="module")
def model():
    return model_from(["\n".join(p) for s in range(40) for p in book(s)], more={"hwell-known": 50, "eacmeworks": 9, "e" + ocr._shape("Acme Works"): 9})


def defects(pages, model):
    return {(p, i, d) for p, i, d in ocr.repair(["\n".join(p) for p in pages], model).defects}


def test_clean_pages_have_no_defects(model):
    assert defects(book(99), model) == set()


def test_furniture_alternating_misread_and_numbered(model):
    pages = book(1)
    for k, p in enumerate(pages):
        p.insert(0, ["Acme Works  Annual survey", "Acrne Works  Annual survey", "Internal only   3"][0 if k % 3 else 1])
        p.append(f"- {k + 7} -")
    got = defects(pages, model)
    assert {(k + 1, 1, "running") for k in range(6)} <= got and {(k + 1, len(pages[k]), "page_number") for k in range(6)} <= got
    roman = book(2)
    for k, p in enumerate(roman):
        p.append("i ii iii iv v vi".split()[k])
    assert {(k + 1, 13, "page_number") for k in range(6)} == defects(roman, model)
    body = book(3)
    body[2].insert(5, "2279")
    assert defects(body, model) == set()


def test_cut_words_and_compounds(model):
    pages = [["the annual rep-", "ort shows how every department", "handles well-", "known equipment and train-"], ["ing material before the audit."]]
    got = defects(pages, model)
    assert got == {(1, 1, "broken_word"), (1, 4, "broken_word")}
    assert "annual report shows" in ocr.repair(["\n".join(p) for p in pages], model).paragraphs[0]
    assert "training material" in " ".join(ocr.repair(["\n".join(p) for p in pages], model).paragraphs)


def test_misread_words(model):
    pages = [["the annual rep0rt shows how every departrnent", "handles trairiing equipment and archive", "mate�ial before the internal audit (cid:12)loses", "its warehouse inventory"]]
    got = defects(pages, model)
    assert got == {(1, 1, "misread"), (1, 2, "misread"), (1, 3, "misread")}
    assert ocr.repair(["\n".join(pages[0])], model).paragraphs[0].startswith("the annual report shows how every department handles training equipment and archive material")


def test_wide_text_is_decoded_in_context():
    m = model_from(["情報システムのスケジュールをサーバーで管理する。二人で確認する。"] * 60)
    r = ocr.repair(["情報システムのスケジュ一ルをサ一バ\nーで管理する。二人で確認する。"], m)
    assert r.defects == [(1, 1, "misread")] and r.paragraphs == ["情報システムのスケジュールをサーバーで管理する。二人で確認する。"]


def test_paragraphs_cross_pages(model):
    a = ["the annual report shows how every", "department handles training", "", "equipment and archive material."]
    r = ocr.repair(["\n".join(a) + "\nbefore the internal", "audit closes its warehouse."], model)
    assert len(r.paragraphs) == 2 and r.paragraphs[1].endswith("before the internal audit closes its warehouse.")


@pytest.mark.parametrize("pages", [None, [], [None], ["", None, " \n"], ["�"], ["7"]])
def test_odd_pages(model, pages):
    r = ocr.repair(pages, model)
    assert isinstance(r.defects, list) and isinstance(r.paragraphs, list)


def test_fit_and_repair_in_spark(spark):
    rows = [(f"r{s}", ["\n".join(p) for p in book(s)], 1) for s in range(12)] + [("n", None, 1), ("e", [], 1), ("x", [None, "the annual rep0rt shows how every"], 1)]
    df = spark.createDataFrame(rows, "version_id string, page_texts array<string>, key int")
    got = {r["version_id"]: r for r in ocr.repair_results(df, ocr.fit(df)).collect()}
    assert len(got) == 15 and got["n"]["defects"] == [] and [(d["page_no"], d["line_no"], d["defect"]) for d in got["x"]["defects"]] == [(2, 1, "misread")]
    empty = df.where("false")
    assert ocr.repair_results(empty, ocr.fit(empty)).count() == 0


def planted(pages, marked, r, pairs):
    """Pages with characters of body lines replaced, and the lines where that happened."""
    split, where = [p.split("\n") for p in pages], set()
    for p, lines in enumerate(split):
        for i, line in enumerate(lines):
            found = [(w.start() + w[0].index(a), a, b) for w in re.finditer(r"[^\W\d_]{4,}", line) for a, b in pairs if a in w[0]]
            if found and (p + 1, i + 1) not in marked and r.random() < 0.1:
                k, a, b = r.choice(found)
                lines[i] = line[:k] + b + line[k + 1 :]
                where.add((p + 1, i + 1))
    return ["\n".join(x) for x in split], where


def test_planted_misreadings_are_found(spark):
    path = "/root/testdata/sf0.1/conversion_results.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    df = spark.read.parquet(path).select("version_id", "page_texts")
    marks = {r["version_id"]: r["defects"] for r in ocr.repair_results(df, ocr.fit(df), paragraphs=False).collect()}
    r = random.Random(11)
    pairs = [p.split() for p in ("e c", "t f", "o 0", "n ri", "i l", "u ii", "l 1", "s 5", "h b", "m rn", "ー 一", "ロ 口", "タ 夕")]
    rows, truth = [], {}
    for row in df.orderBy("version_id").collect():
        d, pages = marks[row["version_id"]], [p or "" for p in row["page_texts"]]
        if not any(x["defect"] == "misread" for x in d) and r.random() < 0.3:
            pages, truth[row["version_id"]] = planted(pages, {(x["page_no"], x["line_no"]) for x in d}, r, pairs)
        rows.append((row["version_id"], pages))
    new = spark.createDataFrame(rows, "version_id string, page_texts array<string>")
    got = {x["version_id"]: {(y["page_no"], y["line_no"]) for y in x["defects"] if y["defect"] == "misread"} for x in ocr.repair_results(new, ocr.fit(new), paragraphs=False).collect()}
    hit, missed, extra = (sum(len(f(got[v], t)) for v, t in truth.items()) for f in (set.intersection, lambda g, t: t - g, set.difference))
    assert hit > 500 and hit / (hit + missed) >= 0.96 and hit / (hit + extra) >= 0.99, (hit, missed, extra)


def test_real_words_stay_beside_frequent_ones_like_them(spark):
    rows = [(f"r{i}", ["the cat sat on the mat and the cat ran", "where people eat"] if i % 40 == 0 else ["the cat sat on the mat and the cat ran"]) for i in range(400)]
    df = spark.createDataFrame([*rows, ("x", ["the eat sat on the mat"])], "version_id string, page_texts array<string>")
    out = {r["version_id"]: r for r in ocr.repair_results(df, ocr.fit(df)).collect()}
    assert out["x"]["defects"] == [] and out["x"]["paragraphs"] == ["the eat sat on the mat"] and not any(r["defects"] for r in out.values())


def test_no_word_is_left_out_of_a_large_lexicon(spark):
    words = ["".join(w) for w in islice(product("gkpqvxyz", repeat=6), 200_500)]
    rows = [([" ".join(words[a::8])] * 3 + ["harvest"],) for a in range(8)]
    lexicon = ocr.fit(spark.createDataFrame(rows, "page_texts array<string>"))
    got = {r["k"]: r["n"] for r in lexicon.table.where("k like 'w%'").collect()}
    assert got["wharvest"] == 8 and all(got["w" + w] == 3 for w in words) and len(lexicon.model.seen) <= 1 / ocr.COMMON


def test_skeletons_survive_confusions():
    for word in ("modernclaim", "Illumination", "cornflower", "8Burnish"):
        for v, at, op in ocr.variants(word):
            assert ocr.skeleton(v) == ocr.skeleton(word) and ocr.confusions(word, v) == ((op, at),) or len(ocr.confusions(word, v)) == 1
    assert ocr.confusions("rnodcrn", "modern") is not None and ocr.confusions("abc", "xyz") is None


def test_words_cut_without_a_hyphen_and_kept_hyphens(model):
    r = ocr.repair(["the annual report shows how every depart\nment handles training equipment and archive material."], model)
    assert r.defects == [] and "every department handles" in r.paragraphs[0]
    r = ocr.repair(["the annual report shows well-\nknown equipment and archive material."], model)
    assert r.defects == [] and "well-known" in r.paragraphs[0]


def test_running_lines_deeper_than_two_and_damaged_copies(model):
    pages = book(7, pages=5)
    for k, p in enumerate(pages):
        p[:0] = ["First heading of house", "Second heading of house" if k != 3 else "Second h\ufffdading of house", "Third heading of house"]
    got = defects(pages, model)
    assert {(p, i, "running") for p in range(1, 6) for i in (1, 2, 3)} <= got and not any(i > 3 for _, i, _ in got)


def test_long_paragraphs_stay_whole():
    for n in (24, 25, 26, 60, 61, 90):
        assert ocr._paragraph_breaks(["one line of many"] * n, [0] * n, 16) == [True] + [False] * (n - 1)


def brute_breaks(price, n):
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j):
            c = best[i] + price[i] + (0.4 if j - i == 1 else 0.0) + ocr.MORE * max(0, j - i - ocr.LONG)
            if c < best[j] - 1e-12:
                best[j], back[j] = c, i
    return best[n]


def test_paragraph_search_is_exact():
    r = random.Random(5)
    for n in (1, 2, 30, 90):
        lines = [r.choice(["a line", "it ends.", "short", "# head", "a much longer line of words"]) for _ in range(n)]
        gaps = [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        price = ocr._break_prices(lines, gaps, 27)
        got = ocr._paragraph_breaks(lines, gaps, 27)
        starts = [i for i, x in enumerate(got) if x]
        cost = sum(price[a] + (0.4 if b - a == 1 else 0.0) + ocr.MORE * max(0, b - a - ocr.LONG) for a, b in zip(starts, [*starts[1:], n]))
        assert starts[0] == 0 and abs(cost - brute_breaks(price, n)) < 1e-9
