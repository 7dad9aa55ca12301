import io
import os
import shutil
import zipfile
import zlib

from pyspark.sql import functions as F

from foliant import schemas
from foliant.providers import HashingEmbedder, VisionProvider
from foliant.runtime import materialise
from foliant.sources import files
from foliant.sources.connectors import FolderConnector
from foliant.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def pack(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return b.getvalue()


def docx():
    body = '<w:p><w:pPr><w:pStyle w:val="1"/></w:pPr><w:r><w:t>規程</w:t></w:r></w:p><w:p><w:r><w:t>本文 </w:t></w:r><w:r><w:rPr><w:strike/></w:rPr><w:t>旧</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>一</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>二</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    return pack(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", word__styles_dot_xml=f'<w:styles {W}><w:style w:styleId="1"><w:name w:val="見出し 1"/></w:style></w:styles>')


def xlsx():
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x|y</t></is></c></row><row r="2"/><row r="3"><c r="A3"><v>45000</v></c><c r="B3" t="e"><v>#N/A</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>'
    wb = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="見積" r:id="r1"/><sheet name="空" r:id="r2"/></sheets></workbook>'
    return pack(xl__workbook_dot_xml=wb, xl___rels__workbook_dot_xml_dot_rels=rel, xl__sharedStrings_dot_xml=f"<sst {S}><si><t>品名\n行</t></si></sst>", xl__worksheets__s1_dot_xml=sheet, xl__worksheets__s2_dot_xml=f"<worksheet {S}><sheetData/></worksheet>")


def pdf():
    s = zlib.compress(b"BT (Hello \\(x\\)) Tj T* (world) Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode /Length " + str(len(s)).encode() + b" >> stream\n" + s + b"\nendstream endobj\n"


def test_docx():
    md, pages = files.docx_markdown(docx())
    assert md == "# 規程\n\n本文 ~~旧~~\n\n- 一\n- 二\n\n| a\\|b |\n| --- |" and len(pages) == 1 and "本文 旧" in pages[0]


def test_xlsx():
    md, texts, names = files.xlsx_markdown(xlsx())
    assert names == ["見積", "空"] and files.NO_DATA in md and "<!-- sheet:見積 -->\n\n## 見積\n\n| 品名<br>行 |  | x\\|y |" in md
    assert "| 45000 | #ERROR(#N/A) | true |" in md and texts[1] == ""


def test_pdf_and_pages():
    assert files.pdf_pages(pdf()) == ["Hello (x)\nworld"]
    assert files.pages_markdown(["a ", ""]) == "<!-- page:1 -->\n\na\n\n<!-- page:2 -->\n\n"

    class V(VisionProvider):
        def transcribe(self, images, prompt):
            return images[0].decode()

    texts, n = files.transcribe_pages([b"1", b"2", b"3"], V(), 2)
    assert texts[:2] == ["1", "2"] and "unreadable" in texts[2] and n == 3


def test_html():
    src = "<html><head><title>t</title></head><body><h2>A &amp; B</h2><p>x <del>y</del> <a href='u'>l</a></p><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table><pre>k\n  m</pre></body></html>"
    assert files.html_markdown(src) == "## A & B\n\nx ~~y~~ [l](u)\n\n- one\n    - in\n- two\n\n| h | i |\n| --- | --- |\n| 1\\|2 |  |\n\n```\nk\n  m\n```"
    assert files.html_markdown("") == ""


def test_upload_store_and_convert(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for name, data in {"a.docx": docx(), "copy.docx": docx(), "b.xlsx": xlsx(), "c.pdf": pdf(), "bad.docx": b"no zip", "d.txt": b"t"}.items():
        (src / name).write_bytes(data)
    up = files.read_uploads(spark, str(src))
    assert up.where("error is not null").count() == 1
    assert files.store_blobs(up, store).where("is_new").count() == 4
    assert files.store_blobs(up, store).where("is_new").count() == 0
    sha = up.where("filename = 'c.pdf'").first()["sha256"]
    assert bytes(files.read_blob(spark, store, sha).first()["content"]) == pdf() and files.read_blob(spark, store, "ff" * 32).count() == 0
    got = {r["engine"]: r for r in files.convert(up.dropDuplicates(["sha256"])).collect()}
    assert got["local:pdf"]["page_count"] == 1 and got["local:xlsx"]["sheet_names"] == ["見積", "空"] and got[None]["error"].startswith("BadZipFile")
    v = spark.createDataFrame([("v", "d", 1, "f", "e", "# x"), ("w", "d", 2, "f", "e", None)], "version_id string, document_id string, version_no int, original_filename string, conversion_engine string, markdown string")
    files.write_mirror(v, str(tmp_path / "md"))
    assert [r["file"].endswith("---\n# x") for r in spark.read.parquet(str(tmp_path / "md")).collect()] == [True]


def test_folder_connector(tmp_path):
    (tmp_path / "a").write_text("1")
    c = FolderConnector()
    pages = list(c.changes(str(tmp_path), None))
    assert [i.name for p in pages for i in p.items] == ["a"] and c.fetch(pages[0].items[0]) == b"1"
    assert list(c.changes(str(tmp_path), pages[-1].cursor)) == []
    (tmp_path / "b").write_text("2")
    os.utime(tmp_path / "b", ns=(pages[0].items[0].modified_at,) * 2)  # same time as the last one seen
    assert [i.name for p in c.changes(str(tmp_path), pages[-1].cursor) for i in p.items] == ["b"]
    (tmp_path / "a").unlink()
    gone = next(FolderConnector([pages[0].items[0].external_id]).changes(str(tmp_path), pages[-1].cursor)).items
    assert [(i.name, i.deleted) for i in gone] == [("a", True)]


def test_pdf_pages_follow_the_page_tree():
    page = lambda n, c: b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n%d 0 obj << /Length 20 >> stream\nBT (%s) Tj ET\nendstream endobj\n" % (n, n + 1, n + 1, c)
    tree = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [6 0 R 8 0 R] >> endobj\n8 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n"
    assert files.pdf_pages(b"%PDF\n" + tree + page(3, b"second") + page(6, b"first")) == ["first", "second"]
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [6 0 R 3 0 R] >>")]
    at, head, body = 0, b"", b""
    for n, o in inner:
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(head + body)
    stream = b"9 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >> stream\n" % len(head) + packed + b"\nendstream endobj\n"
    assert files.pdf_pages(b"%PDF\n" + stream + page(3, b"second") + page(6, b"first")) == ["first", "second"]


def test_schemas(spark):
    df = spark.createDataFrame([("p", 1)], "person_id string, x int")
    assert schemas.evolve(df, "people").columns == ["person_id", "display_name", "department"]
    assert [f.name for f in schemas.schema("people")] == ["person_id", "display_name", "department"]


def test_job_stream_retries_and_counts(spark, tmp_path):
    q, r, c = (str(tmp_path / x) for x in "qrc")
    js = spark.createDataFrame([("1", "ok", "", 1), ("2", "flaky", "", 2), ("3", "bad", "", 3), ("4", "what", "", 4), ("1", "ok", "", 1)], "id string, kind string, payload string, created_at long")
    jobs.enqueue(js, q)
    tries = []

    def flaky(df):
        tries.append(1)
        return df.selectExpr("id", "'again' error" if len(tries) < 2 else "cast(null as string) error")

    def bad(df):
        raise ValueError("broken")

    jobs.run_jobs(spark, q, r, c, {"ok": lambda df: df.selectExpr("id", "cast(null as string) error"), "flaky": flaky, "bad": bad}).awaitTermination()
    got = {x["id"]: (x["status"], x["attempts"]) for x in spark.read.parquet(r).collect()}
    assert got == {"1": ("succeeded", 1), "2": ("succeeded", 2), "3": ("failed", 3), "4": ("failed", 1)}
    jobs.run_jobs(spark, q, r, c, {}).awaitTermination()
    assert spark.read.parquet(r).count() == 4
    assert tuple(jobs.counts(spark.read.parquet(r)).first()) == (0, 0, 2, 2)


def test_embedder_is_deterministic():
    e = HashingEmbedder(16)
    a, b = e.embed(["abc", "abc"])
    assert a == b and len(a) == 16 and e.embed([""])[0] != a


def test_landing_folder_to_archive(spark, tmp_path):
    from foliant.streaming import ingest as stream

    land, arc = tmp_path / "land", str(tmp_path / "arc")
    land.mkdir()
    for name, data in {"a.docx": docx(), "again.docx": docx(), "b.xlsx": xlsx(), "bad.docx": b"no zip", "n.txt": b"t"}.items():
        (land / name).write_bytes(data)
    run = lambda: stream.watch(spark, str(land), arc, str(tmp_path / "cp"), lambda: 7, HashingEmbedder(8)).awaitTermination()
    run()
    v = spark.read.parquet(f"{arc}/versions")
    got = {r["original_filename"]: r for r in v.collect()}
    assert set(got) == {"a.docx", "b.xlsx", "bad.docx"} and got["bad.docx"]["error"].startswith("BadZipFile") and got["a.docx"]["markdown"].startswith("# 規程")
    c = spark.read.parquet(f"{arc}/chunks")
    assert c.count() == spark.read.parquet(f"{arc}/embeddings").count() > 2
    (land / "late.docx").write_bytes(docx() + b" ")
    run()
    assert spark.read.parquet(f"{arc}/versions").count() == 4
    rel = stream.relations(spark, arc).collect()
    assert [(r["kind"], r["status"]) for r in rel] == [("exact_dup", "open")]
    n = spark.read.parquet(f"{arc}/chunks").count()
    stream.ingest_batch(files.read_uploads(spark, str(land)), arc, 8)
    assert spark.read.parquet(f"{arc}/versions").count() == 4 and spark.read.parquet(f"{arc}/chunks").count() == n
    # the next version of a document
    d = got["b.xlsx"]["document_id"]
    up = files.check_uploads(spark.createDataFrame([("/x/b2.docx", docx() + b"  ")], "path string, content binary")).withColumn("document_id", F.lit(d))
    stream.ingest_batch(up, arc, 9)
    v2 = spark.read.parquet(f"{arc}/versions").where(F.col("document_id") == d).orderBy("version_no").collect()
    assert [r["version_no"] for r in v2] == [1, 2] and v2[1]["title"] == "b2"
    doc = {r["document_id"]: r for r in stream.documents(spark, arc).collect()}
    assert len(doc) == 4 and doc[d]["current_version_id"] == v2[1]["version_id"] and doc[d]["updated_at"] == 9 and all(x["current_version_id"] for x in doc.values())
    assert any("document_id: " in r["file"] for r in spark.read.parquet(f"{arc}/markdown").collect())
    # a batch that broke off before its versions were written is done again, and statuses stay
    before = stream.relations(spark, arc)
    count = before.count()
    stream.publish(materialise(before.withColumn("status", F.lit("confirmed"))), f"{arc}/relations")
    shutil.rmtree(next(p for p in (tmp_path / "arc" / "versions").iterdir() if v2[1]["version_id"] in str(spark.read.parquet(str(p)).select("version_id").collect())))
    stream.ingest_batch(up, arc, 9)
    again = stream.relations(spark, arc).collect()
    assert spark.read.parquet(f"{arc}/versions").count() == 5 and len(again) == count and {r["status"] for r in again} == {"confirmed"}
