"""Files in: uploads, a content-addressed store, conversion to Markdown."""

from __future__ import annotations

import base64
import html.parser
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.operators.ingest import check_uploads
from foliant.providers import VisionProvider

# Paragraph styles that are headings.
HEADING_STYLES = {f"{name} {n}": n for name in ("heading", "見出し") for n in range(1, 5)} | {"title": 1, "表題": 1}
NO_DATA = "*（データなし）*"
MAX_VISION_PAGES = 60


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with name, hash, type and error."""
    return check_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def store_blobs(uploads: DataFrame, path: str) -> DataFrame:
    """Add the contents that the store lacks, one row for each SHA-256; (sha256, is_new) of all accepted uploads."""
    spark = uploads.sparkSession
    ok = uploads.where("error is null").select("sha256", "content").dropDuplicates(["sha256"])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    has = spark.read.parquet(path).select("sha256") if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else spark.createDataFrame([], "sha256 string")
    from foliant.runtime import materialise

    state = materialise(ok.select("sha256").join(has.distinct().withColumn("old", F.lit(True)), "sha256", "left").select("sha256", F.col("old").isNull().alias("is_new")), "blobs")
    ok.join(state.where("is_new"), "sha256", "left_semi").withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
    return state


def read_blob(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The content with a hash: one row or none."""
    return spark.read.parquet(path).where((F.col("prefix") == sha256[:2]) & (F.col("sha256") == sha256)).limit(1)


# ---------------------------------------------------------------- converters


class _Markdown(html.parser.HTMLParser):
    """HTML to Markdown: headings, paragraphs, lists, tables, code, links, strike-through; other formatting is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text = ""
        self.lists: list[list] = []
        self.rows: list[list[str]] = []
        self.cell: str | None = None
        self.pre = self.skip = 0
        self.head = 0
        self.href: list[str] = []

    def _flush(self, prefix: str = "") -> None:
        t = self.text if self.pre else re.sub(r"[ \t\r\n]+", " ", self.text).strip()
        if t.strip():
            self.blocks.append(prefix + t)
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag) or tag in ("p", "div", "section", "article", "blockquote"):
            self._flush("- " if self.lists and self.text.strip() else "")
        elif tag == "pre":
            self._flush()
            self.pre = 1
        elif tag in ("ul", "ol"):
            if self.lists and self.text.strip():
                self._item()
            self._flush() if not self.lists else None
            self.lists.append([tag, 0])
        elif tag == "li":
            self._flush() if not self.lists else None
            self.text = ""
        elif tag == "table":
            self._flush()
            self.rows = []
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.text, self.cell = "", tag
        elif tag == "br":
            self.text += "<br>" if self.cell else "\n" if self.pre else " "
        elif tag in ("del", "s", "strike"):
            self.text += "~~"
        elif tag == "code" and not self.pre:
            self.text += "`"
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.text += "[" if self.href[-1] else ""
        elif tag == "hr":
            self._flush()
            self.blocks.append("---")

    def _item(self) -> None:
        t = re.sub(r"\s+", " ", self.text).strip()
        kind = self.lists[-1]
        kind[1] += 1
        if t:
            line = "    " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ") + t
            if self.blocks and re.match(r"\s*(- |\d+\. )", self.blocks[-1]):
                self.blocks[-1] += "\n" + line
            else:
                self.blocks.append(line)
        self.text = ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif m := re.fullmatch(r"h([1-6])", tag):
            self._flush("#" * int(m[1]) + " ")
        elif tag in ("p", "div", "section", "article") and self.cell is None and not self.lists:
            self._flush()
        elif tag == "blockquote":
            self._flush("> ")
        elif tag == "pre":
            self.blocks.append("```\n" + self.text.strip("\n") + "\n```")
            self.text, self.pre = "", 0
        elif tag == "li" and self.lists:
            self._item() if self.text.strip() else None
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("td", "th"):
            if self.rows:
                self.rows[-1].append(re.sub(r"\s+", " ", self.text).strip().replace("|", "\\|"))
            self.text, self.cell = "", None
        elif tag == "table":
            rows = [r for r in self.rows if r]
            if rows:
                self.blocks.append(table_markdown(rows, escaped=True))
            self.text, self.rows = "", []
        elif tag in ("del", "s", "strike"):
            self.text += "~~"
        elif tag == "code" and not self.pre:
            self.text += "`"
        elif tag == "a" and self.href:
            url = self.href.pop()
            self.text += f"]({url})" if url else ""

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text += data


def html_markdown(source: str) -> str:
    p = _Markdown()
    p.feed(source)
    p.close()
    p._flush()
    return "\n\n".join(p.blocks)


def table_markdown(rows: list[list[str]], escaped: bool = False) -> str:
    """A table whose first row is the header, all rows as wide as the widest."""
    width = max(len(r) for r in rows)
    line = lambda r: "| " + " | ".join((x if escaped else x.replace("|", "\\|")) for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_markdown(content: bytes) -> tuple[str, list[str]]:
    """(Markdown, page texts): paragraphs by style, lists, tables, struck text. The text is one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                n = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else ""

    def inline(p: ElementTree.Element) -> tuple[str, str]:
        md, raw = "", ""
        for r in p.iter(f"{_W}r"):
            t = "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in r)
            raw += t
            strike = r.find(f"{_W}rPr/{_W}strike")
            md += f"~~{t}~~" if t and strike is not None and strike.get(f"{_W}val") not in ("0", "false") else t
        return md, raw

    blocks, texts = [], []

    def flat(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
        """Paragraphs and tables, those in content controls included."""
        for x in e:
            if x.tag == f"{_W}sdt":
                inner = x.find(f"{_W}sdtContent")
                yield from flat(inner) if inner is not None else ()
            else:
                yield x

    for e in flat(body) if body is not None else ():
        if e.tag == f"{_W}p":
            md, raw = inline(e)
            style = e.find(f"{_W}pPr/{_W}pStyle")
            sid = style.get(f"{_W}val") if style is not None else ""
            level = HEADING_STYLES.get((names.get(sid) or sid or "").lower())
            texts.append(raw)
            if md.strip():
                item = e.find(f"{_W}pPr/{_W}numPr") is not None
                line = "#" * level + " " + md.strip() if level else "- " + md.strip() if item else md.strip()
                if item and blocks and blocks[-1].startswith("- ") and not level:
                    blocks[-1] += "\n" + line
                else:
                    blocks.append(line)
        elif e.tag == f"{_W}tbl":
            rows = [["<br>".join(filter(None, (inline(p)[0].strip() for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            texts += [" ".join(r) for r in rows]
            if rows:
                blocks.append(table_markdown(rows))
    return "\n\n".join(blocks), ["\n\n".join(texts)]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_markdown(content: bytes) -> tuple[str, list[str], list[str]]:
    """(Markdown, text of each sheet, sheet names): a table for each sheet, its first row the header; trailing empty cells are cut."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = z.namelist()
        rich = lambda e: "".join(t.text or "" for t in e.iter(f"{_S}t"))
        shared = [rich(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in files else []
        dates = set()
        if "xl/styles.xml" in files:
            st = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {f.get("numFmtId") for f in st.iter(f"{_S}numFmt") if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
            xfs = st.find(f"{_S}cellXfs")
            dates = {str(i) for i, x in enumerate(xfs if xfs is not None else ()) if x.get("numFmtId") in custom or 14 <= int(x.get("numFmtId") or 0) <= 22}
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        parts, texts, sheets = [], [], []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            name, target = sheet.get("name") or "", rels.get(sheet.get(f"{_R}id")) or ""
            rows = []
            for r in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{_S}row"):
                cells: list[str] = []
                for c in r.iter(f"{_S}c"):
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    raw = v.text or "" if v is not None else ""
                    if kind == "s":
                        raw = shared[int(raw)] if raw else ""
                    elif kind == "inlineStr":
                        raw = rich(c)
                    elif kind == "b":
                        raw = "true" if raw == "1" else "false"
                    elif kind == "e":
                        raw = f"#ERROR({raw})"
                    elif raw and c.get("s") in dates:
                        raw = (pd.Timestamp("1899-12-30") + pd.Timedelta(days=float(raw))).strftime("%Y-%m-%d")
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [re.sub(r"\r?\n", "<br>", raw)]
                while cells and cells[-1] == "":
                    cells.pop()
                if cells:
                    rows.append(cells)
            sheets.append(name)
            parts += [f"<!-- sheet:{name} -->", f"## {name}", table_markdown(rows) if rows else NO_DATA]
            texts.append("\n".join(" ".join(r) for r in rows))
    return "\n\n".join(parts), texts, sheets


def pages_markdown(pages: list[str]) -> str:
    """Page texts behind their anchors."""
    return "\n\n".join(f"<!-- page:{i} -->\n\n{p.strip()}" for i, p in enumerate(pages, 1))


def pdf_pages(content: bytes) -> list[str]:
    """The text that simply coded PDF files show, page by page: literal and hexadecimal strings of flate-coded or plain content streams.

    Fonts with their own character codes need a provider; such pages come out garbled or blank and fail the quality gate.
    """
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", content, re.S)}

    def stream(n: int) -> bytes:
        o = objects.get(n, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", o, re.S)
        if not m:
            return b""
        try:
            return zlib.decompress(m[1]) if b"FlateDecode" in o.split(b"stream")[0] else m[1]
        except zlib.error:
            return b""

    for n in [n for n, o in objects.items() if re.search(rb"/Type\s*/ObjStm\b", o)]:  # objects packed into streams
        raw, head = stream(n), objects[n].split(b"stream")[0]
        count, first = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", head)) else 0 for k in (b"N", b"First"))
        numbers = [int(x) for x in raw[:first].split()[: 2 * count]]
        for k in range(0, len(numbers) - 1, 2):
            end = numbers[k + 3] if k + 3 < len(numbers) else len(raw) - first
            objects.setdefault(numbers[k], raw[first + numbers[k + 1] : first + end])

    def kids(n: int, seen: set[int]) -> Iterator[int]:
        """Pages below a node of the page tree, in reading order."""
        if n in seen or n not in objects:
            return
        seen.add(n)
        m = re.search(rb"/Kids\s*\[([^\]]*)\]", objects[n])
        if m:
            for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1]):
                yield from kids(int(x), seen)
        else:
            yield n

    is_page = {n for n, o in objects.items() if re.search(rb"/Type\s*/Page\b", o)}
    roots = [int(m[1]) for o in objects.values() if re.search(rb"/Type\s*/Catalog\b", o) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", o))]
    order = [n for n in kids(roots[-1], set()) if n in is_page] if roots else []
    pages = []
    for n in order or sorted(is_page):
        o = objects[n]
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", o)
        data = b"\n".join(stream(int(x)) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])) if m else b""
        text = ""
        for t in re.finditer(rb"\((?P<s>(?:\\.|[^\\()])*)\)|<(?P<h>[0-9A-Fa-f\s]+)>|(?P<nl>T\*|\bTd\b|\bTD\b|'|\bET\b)", data, re.S):
            if t["nl"]:
                text += "\n"
            else:
                raw = re.sub(rb"\\([()\\])", rb"\1", t["s"]) if t["s"] is not None else bytes.fromhex(re.sub(rb"\s", b"", t["h"]).decode().ljust(len(t["h"]) + len(t["h"]) % 2, "0")[: len(t["h"]) // 2 * 2])
                text += raw.decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
        pages.append(re.sub(r"\n+", "\n", text).strip())
    return pages


def data_url(image: bytes, mime: str = "image/png") -> str:
    return f"data:{mime};base64,{base64.b64encode(image).decode()}"


def transcribe_pages(images: list[bytes], provider: VisionProvider, most: int = MAX_VISION_PAGES) -> tuple[list[str], int]:
    """(page texts, page count): the provider reads at most `most` pages; a note stands for the rest."""
    texts = [provider.transcribe([i], "Transcribe this page as Markdown.") for i in images[:most]]
    if len(images) > most:
        texts.append(f"（{len(images) - most} pages unreadable）")
    return texts, len(images)


CONVERTED = "sha256 string, markdown string, page_texts array<string>, page_count int, sheet_names array<string>, engine string, error string"


def convert(uploads: DataFrame) -> DataFrame:
    """Converted files, one row each; a file that can't be read has an error instead of text."""

    def one(name: str, data: bytes) -> tuple:
        ext = name.rpartition(".")[2].lower()
        try:
            if ext == "docx":
                md, pages = docx_markdown(data)
                return md, pages, None, None, "local:docx", None
            if ext == "xlsx":
                md, pages, sheets = xlsx_markdown(data)
                return md, pages, None, sheets, "local:xlsx", None
            if ext == "pdf":
                pages = pdf_pages(data)
                return pages_markdown(pages), pages, len(pages), None, "local:pdf", None
            return None, None, None, None, None, f"unsupported: {ext}"
        except Exception as e:  # noqa: BLE001 - one broken file mustn't end the batch
            return None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *one(n, bytes(c))) for s, n, c in zip(b["sha256"], b["filename"], b["content"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONVERTED.split(", ")]).astype({"page_count": "Int32"})

    return uploads.where("error is null").select("sha256", "filename", "content").mapInPandas(run, CONVERTED)


def write_mirror(versions: DataFrame, path: str) -> None:
    """Markdown files' content with a YAML head, one row for each version, by hash bucket."""
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c)))) for c in ("document_id", "version_no", "original_filename", "conversion_engine"))), F.lit("\n---\n"))
    versions.where("markdown is not null").dropDuplicates(["version_id"]).select("version_id", F.concat(head, "markdown").alias("file"), F.pmod(F.xxhash64("version_id"), F.lit(64)).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
