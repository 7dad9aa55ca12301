import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunk, contradiction, dedupe, diff, fts, hybrid, ingest, taxonomy, vector
from foliant.providers import HashingEmbedder, ProviderError, RuleJudge, TextProvider


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


# ---- chunks


def chunks_of(spark, md, target=10_000, overlap=100):
    df = spark.createDataFrame([("k", md)], "id string, md string")
    return [r.asDict() for r in chunk.chunk_markdown(df, "id", "md", target, overlap).orderBy("ordinal").collect()]


def test_chunks_follow_headings_pages_and_sheets(spark):
    md = "\n".join(["# 規程", "<!-- page:1 -->", "本規程", "## 3.1 交通費", "<!-- page:1 -->", "実費", "<!-- page:2 -->", "## 3.2 旅費", "日当"])
    c = chunks_of(spark, md)
    assert [x["heading_path"] for x in c] == ["規程", "規程 > 3.1 交通費", "規程 > 3.2 旅費"]
    assert [x["heading_anchor"] for x in c] == ["h-1-規程", "h-2-3-1-交通費", "h-3-3-2-旅費"]
    assert [(x["page_from"], x["page_to"]) for x in c] == [(1, 1), (1, 1), (2, 2)]
    assert chunks_of(spark, "# a\n<!-- sheet:見積 -->\n## b\nc")[-1]["sheet_name"] == "見積"
    assert chunks_of(spark, "") == [] and chunks_of(spark, "\n \n") == []


def test_chunks_overlap_within_a_heading_only(spark):
    c = chunks_of(spark, "# 規程\n" + "あ" * 300, 100, 20)
    assert len(c) > 2 and c[0]["text"][-20:] == c[1]["text"][:20]
    assert all(x["heading_path"] == "規程" for x in c)
    assert chunks_of(spark, "a" * 10 + "\n# h\nb", 10, 3)[1]["text"].startswith("aaa\n# h")
    assert chunks_of(spark, "a" * 10 + "\nb", 10, 0)[1]["text"] == "b"
    assert [x["text"] for x in chunks_of(spark, "あ。い。" + "う" * 7 + "。えお。か。", 5, 0)] == ["あ。い。", "ううううう", "うう。\nえお。か。"]


def test_anchors_number_headings_and_take_one_form(spark):
    md = "x\n<!-- page: 3 -->\n# One\n\n <!-- page:4 -->\n<!--page:5-->\ny\n##　Two\n#no\n# Three\r"
    df = spark.createDataFrame([("k", md)], "id string, md string")
    got = rows(chunk.annotate_lines(df, "id", "md").select("line_no", "heading_anchor", "page", "heading_path"))
    assert [r[0] for r in got] == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert [r[1] for r in got] == [None, None, "h-1-one", "h-1-one", "h-1-one", "h-1-one", "h-2-two", "h-2-two", "h-2-two"]
    assert [r[2] for r in got] == [None] * 5 + [5] * 4 and got[-1][3] == "One > Two"


def test_annotated_lines_and_chunks_agree(spark):
    md = "x\n# A\n<!-- page:3 -->\ntext\n### C\nt\n## B\nu\n# D\nv"
    df = spark.createDataFrame([("k", md, 1), ("n", None, 2)], "id string, md string, key int")
    got = rows(chunk.annotate_lines(df, "id", "md").select("line_no", "text", "heading_path", "page"))
    assert [(r[1], r[2], r[3]) for r in got] == [("x", None, None), ("# A", "A", None), ("text", "A", 3), ("### C", "A > C", 3), ("t", "A > C", 3), ("## B", "A > B", 3), ("u", "A > B", 3), ("# D", "D", 3), ("v", "D", 3)]
    out = chunk.chunk_markdown(df, "id", "md", 10_000)
    assert out.where("key = 'n'").count() == 0 and out.count() == 5
    assert chunk.chunk_markdown(df.where("false"), "id", "md").count() == 0


# ---- diff


def test_diff_is_least_and_rebuilds(spark):
    r = diff.line_diff("a\nb\nc\nd", "a\nc\nx\nd")
    assert [(k, n) for k, n, _ in r] == [("same", 1), ("removed", 1), ("same", 1), ("added", 1), ("same", 1)]
    df = spark.createDataFrame([("a", "b"), (None, "b"), (None, None), ("", "")], "o string, n string")
    got = [x[0] for x in df.select(diff.diff_runs(F.col("o"), F.col("n"))).collect()]
    assert [k["kind"] for k in got[0]] == ["removed", "added"] and [k["kind"] for k in got[1]] == ["added"] and got[2] is None and got[3] == []


# ---- search

CHUNKS = [
    (1, "d1", "残業規程", "申請", "残業 申請 は 前日 まで"),
    (2, "d1", "残業規程", None, "日当 精算 の 提出 期限"),
    (3, "d2", "経費規程", "提出", "経費 申請 提出 提出 foo"),
    (4, "d3", "旧規程", "申請", "申請"),
]


def _index(spark):
    c = spark.createDataFrame(CHUNKS, "id long, document_id string, title string, heading string, body string")
    return c, fts.build_index(c.unionByName(c.where("id = 1")), "id", "title", "heading", "body")


def test_bm25_equals_sqlite(spark):
    c, ix = _index(spark)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, heading, body, content='', tokenize='unicode61 remove_diacritics 0')")
    for r in c.collect():
        toks = [" ".join(spark.range(1).select(fts.words(F.lit(x or ""))).first()[0]) for x in (r["title"], r["heading"], r["body"])]
        con.execute("insert into f(rowid, title, heading, body) values (?,?,?,?)", (r["id"], *toks))
    for q in (["申請"], ["提出"], ["申請", "提出"], ["申請", "申請"], ["foo"]):
        want = dict(con.execute("select rowid, bm25(f, 5.0, 3.0, 1.0) from f where f match ?", (" AND ".join(f'"{t}"' for t in q),)).fetchall())
        got = {r["id"]: r["score"] for r in fts.bm25(ix, q).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), (q, got, want)


def test_phrases_and_empty_queries(spark):
    c = spark.createDataFrame([(1, "2 500 yen", None, None), (2, "500 2", None, None)], "id long, t string, h string, b string")
    ix = fts.build_index(c, "id", "t", "h", "b")
    assert [r["id"] for r in fts.bm25(ix, ["2,500"]).collect()] == [1]
    assert fts.bm25(ix, []).count() == 0 and fts.bm25(ix, ["!"]).count() == 0 and fts.bm25(ix, ["zz"]).count() == 0
    empty = fts.build_index(c.where("false"), "id", "t", "h", "b")
    assert fts.bm25(empty, ["500"]).count() == 0


def test_index_survives_writing_and_prunes(spark, tmp_path):
    c, ix = _index(spark)
    ix.write(str(tmp_path))
    back = fts.Index.read(spark, str(tmp_path))
    assert dict(rows(fts.bm25(back, ["申請"]))) == pytest.approx(dict(rows(fts.bm25(ix, ["申請"]))))


def test_search_filters_and_groups(spark):
    c, ix = _index(spark)
    docs = spark.createDataFrame([("d1", "active", "manual"), ("d2", "active", "report"), ("d3", "archived", "manual")], "document_id string, status string, doc_type string")
    visible = c.select("id", "document_id").join(docs.where(fts.filters()), "document_id")
    assert {r["id"] for r in fts.search(ix, ["申請"], visible).collect()} == {1, 3}
    only = c.select("id", "document_id").join(docs.where(fts.filters(doc_types=["report"])), "document_id")
    assert {r["id"] for r in fts.search(ix, ["申請"], only).collect()} == {3}
    hits = spark.createDataFrame([(i, "d", float(-i)) for i in range(5)], "id long, document_id string, score double")
    g = rows(fts.group_by_document(hits, "document_id").select("id", "hit_no", "best_score", "extra_hits"), "hit_no")
    assert g == [(4, 1, -4.0, 3), (3, 2, -4.0, 3)]


def test_cosine_and_topk(spark):
    v = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(v, "k long, e array<float>")
    assert rows(vector.nearest_to(df, "k", "e", [1.0, 0.0]), F.desc("score"), "id") == [(1, 1.0), (7, 1.0), (2, 0.0), (6, -1.0)]
    assert rows(vector.nearest_to(df, "k", "e", [1.0, 0.0], 1)) == [(1, 1.0)]
    chunks = spark.createDataFrame([(4, "d", "a"), (8, "d", "b"), (1, "d", "c"), (8, "d", "b"), (9, "gone", "e")], "chunk_id long, document_id string, text string")
    docs = spark.createDataFrame([("d", "active"), ("gone", "archived")], "document_id string, status string")
    todo = vector.missing(chunks, df.select(F.col("k").alias("chunk_id"), F.col("e").alias("embedding")), docs)
    assert rows(todo.select("chunk_id")) == [(4,), (8,)]
    filled = vector.backfill(todo, HashingEmbedder(8)).collect()
    assert len(filled) == 2 and all(len(r["embedding"]) == 8 for r in filled)


def test_fusion(spark):
    k = spark.createDataFrame([(1, -3.0), (2, -2.0)], "id long, score double")
    s = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id long, score double")
    vis = spark.createDataFrame([(1,), (2,)], "id long")
    got = hybrid.hybrid(k, s, vis).collect()
    assert [(r["id"], r["matched_by"]) for r in got] == [(2, "keyword,semantic"), (1, "keyword")] and got[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)
    assert [r["id"] for r in hybrid.hybrid(k, None, vis).collect()] == [1, 2]
    assert hybrid.hybrid(k.where("false"), s.where("false"), vis).count() == 0


# ---- duplicates


def test_near_pairs_equal_brute_force(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(48) for _ in range(12)]
    hs = [b ^ sum(1 << x for x in r.sample(range(48), k)) for b in base for k in (0, 0, 3, 8, 9)]
    data = [(f"v{i:03}", f"d{i % 7}", h) for i, h in enumerate(hs)]
    reps = spark.createDataFrame(data, "version_id string, document_id string, simhash long")
    want = {(a[0], b[0], (a[2] ^ b[2]).bit_count()) for a in data for b in data if a[0] < b[0] and a[1] != b[1] and (a[2] ^ b[2]).bit_count() <= 8}
    assert {tuple(x) for x in dedupe.near_pairs(reps).collect()} == want
    assert {tuple(x) for x in dedupe.near_pairs(reps, free=3).collect()} == want


def test_dedupe_cascade(spark):
    text = " ".join(f"word{i}" for i in range(60))
    v = spark.createDataFrame([("a", "d1", text, 1), ("a", "d1", text, 1), ("b", "d2", text, 2), ("c", "d3", text + " more words here", 3), ("e", "d4", "nothing in common at all", 4), ("f", "d5", None, 5), ("g", "d6", "", 6), ("h", "d7", text, 7)], "version_id string, document_id string, markdown string, created_at long")
    d = spark.createDataFrame([(x, y, s) for x, y, s in [("d1", "a", "active"), ("d2", "b", "active"), ("d3", "c", "active"), ("d4", "e", "active"), ("d5", "f", "active"), ("d6", "g", "active"), ("d7", "h", "archived")]], "document_id string, current_version_id string, status string")
    cur = dedupe.current_versions(d, v)
    assert {r["version_id"] for r in cur.collect()} == {"a", "b", "c", "e"}
    assert rows(dedupe.exact_classes(cur).select("version_id", "first_version_id", "copies")) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("e", "e", 1)]
    reps = dedupe.representatives(cur)
    got = dedupe.classify(dedupe.near_pairs(reps), reps).collect()
    assert [(r["a"], r["b"], r["kind"], r["score"]) for r in got] == [("a", "c", "contained_in", 1.0)]
    none = dedupe.representatives(cur.where("false"))
    assert dedupe.near_pairs(none).count() == 0


def test_relation_upsert_keeps_id_and_status(spark):
    old = spark.createDataFrame([("r1", "a", "b", "near_dup", 0.1, "e", "dismissed", 1)], "relation_id string, a string, b string, kind string, score double, evidence string, status string, detected_at long")
    found = spark.createDataFrame([("b", "a", "near_dup", 0.9, "f"), ("a", "c", "exact_dup", 1.0, None), ("c", "a", "exact_dup", 1.0, None)], "a string, b string, kind string, score double, evidence string")
    once = dedupe.upsert_relations(old, found, 5)
    assert [r[1:] for r in rows(once, "b")] == [("a", "b", "near_dup", 0.9, "f", "dismissed", 5), ("a", "c", "exact_dup", 1.0, None, "open", 5)]
    assert rows(dedupe.upsert_relations(once, found, 5)) == rows(once)


# ---- contradictions


def test_candidates_equal_brute_force(spark):
    import random

    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(vocab, k=12)) for _ in range(40)]
    texts += [" ".join([*t.split()[:9], "zz", "yy"]) for t in texts[:20]]
    data = [(i, f"d{i % 9}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, document_id string, text string")
    sh = {i: frozenset(" ".join(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)) for i, _, t in data}
    want = sorted(((-len(sh[a] & sh[b]) / len(sh[a] | sh[b]), a, b) for a, da, _ in data for b, db, _ in data if a < b and da != db and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.12))[:15]
    got = [(-x["jaccard"], x["a"], x["b"]) for x in contradiction.candidates(df, most=15).collect()]
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert contradiction.candidates(df.where("false")).count() == 0


def test_candidates_of_a_class_in_several_documents(spark):
    x, y = "a b c d e f g h", "a b c d e f g z"
    df = spark.createDataFrame([(1, "d1", x), (2, "d1", y), (3, "d2", x)], "id long, document_id string, text string")
    assert [(r["a"], r["b"]) for r in contradiction.candidates(df).collect()] == [(1, 2)]
    assert contradiction.candidates(df.where("document_id = 'd1'")).count() == 0


def test_candidates_take_every_signal_and_no_archived_document(spark, tmp_path):
    from foliant.plans.catalog import QUERIES

    text = "alpha beta gamma delta epsilon zeta eta theta %s"
    chunks = [(1, "d1", text % "３週間以内"), (2, "d2", text % "必須"), (3, "d3", text % "禁止"), (4, "gone", text % "以下"), (5, "d2", text % "per cent"), (6, "nowhere", text % "未満")]
    spark.createDataFrame(chunks, "chunk_id long, document_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    docs = [("d1", "active"), ("d2", "active"), ("d3", "active"), ("gone", "archived")]
    spark.createDataFrame(docs, "document_id string, status string").write.parquet(f"{tmp_path}/managed_documents.parquet")
    assert {(r["a"], r["b"]) for r in QUERIES["contradiction_candidates"](spark, str(tmp_path)).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_signals_memo_and_judgement(spark):
    t = spark.createDataFrame([("上限は3,000円",), ("10日以内",), ("hello",), ("令和6年4月1日",)], "t string").select(contradiction.has_signal(F.col("t"))).collect()
    assert [x[0] for x in t] == [True, True, False, True]
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    memo = spark.createDataFrame([(2, 1, "none", 1)], "a_chunk_id long, b_chunk_id long, verdict string, checked_at long")
    left = contradiction.unchecked(pairs, memo)
    assert rows(left) == [(3, 4)]
    chunks = spark.createDataFrame([(3, "limit 10"), (4, "limit 20")], "id long, text string")
    v = contradiction.judge(left, chunks, RuleJudge(), 7)
    assert [(r["kind"], r["failed"]) for r in contradiction.findings(v).collect()] == [("numeric", False)]

    class Broken(TextProvider):
        def complete(self, prompt, max_tokens=4000):
            raise ProviderError("down")

    assert [r["failed"] for r in contradiction.judge(left, chunks, Broken(), 7).collect()] == [True]
    more = spark.createDataFrame([(1, 2, "numeric", 9)], memo.schema)
    assert rows(contradiction.merge_memo(memo, more)) == [(1, 2, "numeric", 9)]
    with pytest.raises(ProviderError):
        RuleJudge().complete_json("a\n---\nb", ("missing",))


# ---- ingest and taxonomy


def test_ingest_new_documents_and_versions(spark):
    files = spark.createDataFrame([("/x/a.docx", b"1"), ("/x/b.docx", b"1"), ("/x/c.txt", b"2"), ("/x/d.pdf", b"3")], "path string, content binary")
    up = ingest.check_uploads(files)
    assert {r["path"]: r["error"] for r in up.collect()}["/x/c.txt"] == "unsupported: txt"
    sha3 = up.where("path = '/x/d.pdf'").first()["sha256"]
    have = spark.createDataFrame([("v9", "d9", 2, sha3)], "version_id string, document_id string, version_no int, original_sha256 string")
    fresh, old = ingest.new_documents(up, have, 1)
    assert [r["original_filename"] for r in fresh.collect()] == ["a.docx"]
    assert {(r["path"], r["document_id"]) for r in old.collect()} == {("/x/b.docx", fresh.first()["document_id"]), ("/x/d.pdf", "d9")}
    again = fresh.select("version_id", "document_id", "version_no", "original_sha256").unionByName(have)
    assert ingest.new_documents(up, again, 1)[0].count() == 0
    nv = ingest.new_versions(up.withColumn("document_id", F.lit("d9")), have, 2)
    assert [r["version_no"] for r in nv.orderBy("version_no").collect()] == [3]
    docs = spark.createDataFrame([("d9", "v9", "archived", 0)], "document_id string, current_version_id string, status string, updated_at long")
    moved = ingest.with_current(docs, nv, 5).first()
    assert moved["status"] == "active" and moved["current_version_id"] != "v9"


def test_replace_partition_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([("v1", 1), ("v1", 2), ("v2", 3)], "version_id string, x int")
    ingest.replace_partition(a, p, "version_id")
    ingest.replace_partition(spark.createDataFrame([("v1", 9)], a.schema), p, "version_id")
    ingest.replace_partition(spark.createDataFrame([("v1", 9)], a.schema), p, "version_id")
    assert sorted((r["version_id"], r["x"]) for r in spark.read.parquet(p).collect()) == [("v1", 9), ("v2", 3)]


def test_people_states_and_status(spark):
    people = spark.createDataFrame([("P1", "Ann", None)], "person_id string, display_name string, department string")
    names = spark.createDataFrame([(" Ann ",), ("Bo",), ("Bo",), (" ",), (None,)], "display_name string")
    assert sorted(r["display_name"] for r in ingest.merge_people(people, names).collect()) == ["Ann", "Bo"]
    ev = spark.createDataFrame([("d", "reviewed", 1), ("d", "reviewed", 3), ("d", "extended", 2)], "document_id string, action string, at long")
    assert rows(ingest.latest_state(ev, ["reviewed", "extended", "archived"])) == [("d", 3, 2, None)]
    rel = spark.createDataFrame([("r", "open")], "relation_id string, status string")
    assert ingest.set_status(rel, "relation_id", ["r"], "merged", ("open", "merged")).first()["status"] == "merged"
    with pytest.raises(ValueError):
        ingest.set_status(rel, "relation_id", ["r"], "x", ("open",))


def test_taxonomy(spark):
    cats = spark.createDataFrame([("1", None, "A", 0), ("2", "1", "B", 1), ("3", "9", "C", 2)], "id string, parent_id string, name string, sort_order int")
    counts = spark.createDataFrame([("2", 4)], "id string, n long")
    assert rows(taxonomy.tree(cats, counts).select("root_name", "documents", "children")) == [("A", 4, "B:4"), ("C", 0, "")]
    have = spark.createDataFrame([("k", None, "Kept", "Kept", 0, False), ("o", None, "Old", "Old", 0, True)], "id string, parent_id string, name string, path string, sort_order int, is_ai_proposed boolean")
    prop = spark.createDataFrame([("Top", "Kid"), ("Top", None)], "top string, child string")
    new = taxonomy.replace_proposals(have, prop)
    assert sorted(r["path"] for r in new.collect()) == sorted(["Kept", "Top", "Top > Kid", taxonomy.FALLBACK])
    assert rows(taxonomy.replace_proposals(new, prop), "path") == rows(new, "path")
    ans = spark.createDataFrame([("d1", "Top > Kid"), ("d2", "nope")], "document_id string, path string")
    got = {r["document_id"]: r["category_id"] for r in taxonomy.classify(ans, new).collect()}
    assert got["d1"] and got["d2"] is None


def test_proposals_from_a_provider(spark):
    class P(TextProvider):
        def complete(self, prompt, max_tokens=4000):
            return '{"categories": [{"name": "Rules", "children": ["Travel"]}]}' if "A > B" in prompt else "no"

    docs = spark.createDataFrame([(f"d{i}", "T", None, "A > B", 1) for i in range(5)], "document_id string, title string, doc_type string, outline string, headings long")
    for lines in (2, 100):
        assert sorted(rows(taxonomy.propose(docs, P(), lines), "child"), key=str) == [("Rules", "Travel"), ("Rules", None)]
    with pytest.raises(Exception, match="ProviderError"):
        taxonomy.propose(docs.withColumn("outline", F.lit("x")), P()).collect()
    d = spark.createDataFrame([("a", "active", None), ("b", "archived", None), ("c", "active", "k")], "document_id string, status string, category_id string")
    assert [r["document_id"] for r in taxonomy.unclassified(d).collect()] == ["a"]


def test_outlines_and_classification_of_all(spark):
    class P(TextProvider):
        def complete(self, prompt, max_tokens=4000):
            if "broken" in prompt:
                raise ProviderError("down")
            return '{"categoryPath": " Top "}' if "A | B" in prompt else '{"categoryPath": "else"}'

    d = spark.createDataFrame([("a", "one", "t", "v", "active", None, 1), ("b", "two", "t", None, "active", "Old", 1), ("c", "broken", None, "v", "active", None, 1), ("e", "gone", "t", "v", "archived", None, 1), ("f", "plain", "t", "v", "active", None, 1)], "document_id string, title string, doc_type string, current_version_id string, status string, category_id string, updated_at long")
    c = spark.createDataFrame([("a", "B"), ("a", "A"), ("a", "A"), ("a", None), ("e", "Z")], "document_id string, heading_path string")
    o = taxonomy.outlines(d, c)
    assert rows(o.select("document_id", "outline", "headings")) == [("a", "A | B", 2), ("c", "", 0), ("f", "", 0)]
    cats = spark.createDataFrame([("k1", "Top", True), ("k2", "Other", False)], "id string, path string, is_ai_proposed boolean")
    told = []
    got = {r["document_id"]: (r["category_id"], r["updated_at"]) for r in taxonomy.classify_all(d, o, cats, P(), 9, lambda a, b: told.append((a, b))).collect()}
    assert got == {"a": ("k1", 9), "b": ("Old", 1), "c": (None, 9), "e": (None, 1), "f": (None, 9)} and told == [(3, 3)]
    held = d.withColumn("category_id", F.when(F.col("document_id") == "a", "k1").otherwise("k2"))
    assert {r["document_id"]: r["category_id"] for r in taxonomy.without_proposed(held, cats).collect()} == {"a": None, "b": "k2", "c": "k2", "e": "k2", "f": "k2"}


def test_materialised_stages_are_released(spark):
    from foliant import runtime
    from foliant.streaming.jobs import any_recent

    df = runtime.materialise(spark.range(3))
    assert df.count() == 3 and runtime.release(spark) >= 1
    j = spark.createDataFrame([("1", "a", "queued", 1), ("2", "b", "done", 2)], "id string, kind string, status string, created_at long")
    assert any_recent(j, "a") and not any_recent(j, "b") and not any_recent(j.where("false"), "a") and not any_recent(j, "a", among=1)


def test_review_changes_and_events(spark):
    from foliant.functions.freshness import DAY
    from foliant.operators import review
    from foliant.schemas import evolve

    docs = evolve(spark.createDataFrame([("a", "t", "manual", "P1", "active", 1, 5), ("b", "t", None, None, "active", 1, 5), ("c", "t", None, None, "active", 1, 5)], "document_id string, title string, doc_type string, owner_person_id string, status string, created_at long, review_due_at long"), "managed_documents")
    people = spark.createDataFrame([("P1", "Ann", None)], "person_id string, display_name string, department string")
    changes = [("a", "reviewed", None, 10), ("a", "extended", "3", 20), ("a", "owner_assigned", " Bo ", 11), ("b", "extended", "9", 10), ("b", "reviewed", "fine", 30), ("b", "archived", None, 31), ("b", "type_set", "report", 7), ("b", "effective_set", "77", 8), ("x", "reviewed", None, 1), ("a", "other", None, 1), (None, "reviewed", None, 1)]
    out, everybody, events = review.apply(docs, people, spark.createDataFrame(changes, "document_id string, action string, value string, at long"))
    got = {r["document_id"]: r for r in out.collect()}
    bo = {r["display_name"]: r["person_id"] for r in everybody.collect()}["Bo"]
    assert (got["a"]["last_reviewed_at"], got["a"]["review_due_at"], got["a"]["owner_person_id"], got["a"]["updated_at"]) == (10, 20 + 3 * DAY, bo, 20)
    assert (got["b"]["last_reviewed_at"], got["b"]["review_due_at"], got["b"]["doc_type"], got["b"]["effective_date"], got["b"]["status"]) == (30, None, "report", 77, "archived")
    assert (got["c"]["review_due_at"], got["c"]["status"], got["c"]["updated_at"]) == (5, "active", None)
    assert sorted((r["document_id"], r["action"]) for r in events.collect()) == [("a", "extended"), ("a", "owner_assigned"), ("a", "reviewed"), ("b", "archived"), ("b", "extended"), ("b", "reviewed")]
    assert review.lookup(out, "document_id", "a").count() == 1 and review.lookup(out, "document_id", "q").count() == 0
    f = spark.createDataFrame([("1", "open", None)], "id string, status string, resolved_at long")
    assert tuple(review.resolve_findings(f, ["1"], "resolved", 4).first()) == ("1", "resolved", 4)
    assert tuple(review.resolve_findings(review.resolve_findings(f, ["1"], "resolved", 4), ["1"], "open", 5).first()) == ("1", "open", None)
    with pytest.raises(ValueError):
        review.resolve_findings(f, [], "gone", 1)


def test_contradiction_scan_saves_findings_once(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta %s円"
    rows_ = [(1, "d1", "v1", "H > I", 3, text % "100"), (2, "d2", "v2", None, None, text % "200"), (3, "d3", "v3", "x", 1, text % "100"), (4, "gone", "v4", "x", 1, text % "300")]
    chunks = spark.createDataFrame(rows_, "id long, document_id string, version_id string, heading_path string, page_from int, text string")
    docs = spark.createDataFrame([("d1", "One", "active"), ("d2", "Two", "active"), ("d3", "Three", "active"), ("gone", "G", "archived")], "document_id string, title string, status string")
    memo = spark.createDataFrame([], "a_chunk_id long, b_chunk_id long, verdict string, checked_at long")
    found, memo2, counts = contradiction.scan(chunks, docs, memo, RuleJudge(), 7)
    assert tuple(counts.first()) == (1, 1, 1) and rows(memo2) == [(1, 2, "contradiction", 7)]
    f = found.first()
    assert f["title"] == "One / Two" and f["document_ids"] == ["d1", "d2"] and f["citations"][0]["page"] == 3 and f["citations"][0]["heading_path"] == "H > I" and f["status"] == "open" and "claimA" in f["detail"]
    again, memo3, counts = contradiction.scan(chunks, docs, memo2, RuleJudge(), 8)
    assert again.count() == 0 and tuple(counts.first()) == (0, 0, 0) and rows(memo3) == rows(memo2)


def test_index_removal_update_and_japanese(spark, tmp_path):
    df = spark.createDataFrame([(1, "残業申請の手引き", None, "残業申請は上長に提出する。"), (2, None, "規程", "休暇の申請書を提出"), (3, "plain", None, "overtime request")], "id long, t string, h string, b string")
    ix = fts.build_index(df, "id", "t", "h", "b")
    ids = lambda i, *terms: sorted(r["id"] for r in fts.bm25(i, list(terms)).collect())
    assert ids(ix, "残業") == [1] and 1 in ids(ix, "申請") and ids(ix, "休暇") == [2] and ids(ix, "overtime") == [3]
    ix.write(str(tmp_path / "ix"), parts=2)
    kept = fts.Index.read(spark, str(tmp_path / "ix"))
    less = kept.without(spark.createDataFrame([(1,), (9,)], "id long"))
    assert ids(less, "残業") == [] and less.lengths.count() == 2
    more = kept.updated(fts.build_index(spark.createDataFrame([(3, "残業", None, ""), (4, "残業", None, "")], "id long, t string, h string, b string"), "id", "t", "h", "b"))
    assert ids(more, "残業") == [1, 3, 4] and ids(more, "overtime") == []


def test_near_pairs_of_a_content_in_several_documents(spark):
    cur = spark.createDataFrame([("v1", "d1", "x", 1), ("v2", "d1", "y", 2), ("v3", "d2", "x", 3)], "version_id string, document_id string, markdown string, created_at long")
    reps = dedupe.representatives(cur).withColumn("simhash", F.lit(5).cast("long"))
    assert rows(dedupe.near_pairs(reps)) == [("v1", "v2", 0)]
    assert rows(dedupe.contents(cur).select("version_id", "content_id")) == [("v1", "v1"), ("v2", "v2"), ("v3", "v1")]
    assert dedupe.free_bands(100) == 1 and dedupe.free_bands(10_000_000) > 2
