import random
import re
import unicodedata
from collections import Counter, defaultdict

from foliant.llm import leaks


def fold(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return "".join(c for c in t if unicodedata.category(c) != "Cf")


def sequences(t):
    f = fold(t)
    return re.findall(r"[^\W_⺀-鿿]+|[⺀-鿿]+", f), [c for c in f if c.isalnum()]


def brute(docs, items):
    out = {}
    for d, t in docs:
        w, c = sequences(t)
        for i, x in items:
            iw, ic = sequences(x)
            wide = sum("⺀" <= z <= "鿿" for z in ic) > len(ic) / 2
            a, b, k = (c, ic, 20) if wide else (w, iw, 8)
            grams = defaultdict(list)
            for q in range(len(b) - k + 1):
                grams[tuple(b[q : q + k])].append(q)
            cov = set()
            for p in range(len(a) - k + 1):
                for q in grams.get(tuple(a[p : p + k]), ()):
                    cov |= set(range(q, q + k))
            if cov:
                out[d, i] = (len(cov), len(b))
    return out


def terms(t):
    w, c = sequences(t)
    return w, ["".join(c[i : i + 3]) for i in range(len(c) - 2)]


def brute_near(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            ic = sequences(x)[1]
            wide = sum("⺀" <= z <= "鿿" for z in ic) > len(ic) / 2
            a, b = terms(t)[wide], terms(x)[wide]
            if len(b) < (18 if wide else 8):
                continue
            room = len(b) + len(b) // 4
            best = max((sum((Counter(a[p : p + room]) & Counter(b)).values()) for p in range(len(a))), default=0)
            if best >= 0.8 * len(b) - 1e-9:
                out[d, i] = best
    return out


def test_items_changed_in_every_seventh_word_are_near(spark):
    r = random.Random(4)
    item = [f"w{i}" for i in range(35)]
    changed = [f"x{i}" if i % 7 == 3 else w for i, w in enumerate(item)]
    swapped = item[:]
    for i in range(0, 34, 2):
        swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
    far = [w for x in item for w in (x, f"y{r.random()}")]
    long_words = ["x" * 70 + "abcdef" + str(i) for i in range(9)]
    docs = [(1, " ".join(["a", "b", *changed, "c"])), (2, " ".join(swapped)), (3, " ".join(far)), (4, " ".join(w[:70] + "fedcba" + w[76:] for w in long_words)), (5, " ".join(r.sample(item, 35)))]
    items = [(1, " ".join(item)), (2, " ".join(long_words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaks.find_leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert sorted((x["doc_id"], x["item_id"], x["kind"], x["covered"]) for x in got) == [(1, 1, "near", 30), (2, 1, "near", 35), (5, 1, "near", 35)]
    assert {(x["doc_id"], x["item_id"]): x["covered"] for x in got} == brute_near(docs, items)


def test_matches_equal_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    kana = "あいうえおかきくけこさしすせそたちつてと漢字計画書類"
    items = [(i, " ".join(r.choices(vocab, k=20))) for i in range(6)] + [(10 + i, "".join(r.choices(kana, k=45))) for i in range(4)]
    items += [(20, "too short"), (21, "短い文"), (22, "a b " * 10)]
    docs = []
    for k in range(60):
        _, x = r.choice(items[:10])
        unit = x.split() if " " in x else list(x)
        glue = " " if " " in x else ""
        a = r.randint(0, len(unit) - 5)
        piece = glue.join(unit[a : a + r.randint(5, len(unit))])
        piece = r.choice([piece, piece.upper(), piece.replace(" ", "\n"), piece.replace(" ", ", "), "​".join(piece)[:4000], unicodedata.normalize("NFKC", piece)])
        docs.append((k, " ".join(r.choices(vocab, k=30)) + " ... " + piece + " ! " + "".join(r.choices(kana, k=40))))
    docs += [(100, ""), (102, "a b a b a b a b a b a b a b"), (103, items[0][1].replace("w", "Ｗ") + " " + items[0][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in [*docs, (101, None), (None, "x")]], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([*items, (30, None), (None, "x")], "item_id long, text string")
    for block, together in ((leaks.BLOCK_CHARS, leaks.INDEX_CHARS), (150, 300)):
        (leaks.BLOCK_CHARS, leaks.INDEX_CHARS), kept = (block, together), (leaks.BLOCK_CHARS, leaks.INDEX_CHARS)
        rows = leaks.find_leaks(df, "doc_id", "text", tests, "item_id", "text").collect()
        leaks.BLOCK_CHARS, leaks.INDEX_CHARS = kept
        assert {(x["doc_id"], x["item_id"]): (x["covered"], x["item_words"]) for x in rows if x["kind"] == "phrase"} == brute(docs, items)
        assert {(x["doc_id"], x["item_id"]): x["covered"] for x in rows if x["kind"] == "near"} == brute_near(docs, items)
    assert leaks.find_leaks(df.where("false"), "doc_id", "text", tests, "item_id", "text").count() == 0
    assert leaks.find_leaks(df, "doc_id", "text", tests.where("false"), "item_id", "text").count() == 0
