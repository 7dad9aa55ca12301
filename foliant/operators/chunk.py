"""Markdown to chunks: lines with their place, then chunks of about a target size. All of it is a plan over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.functions.text import WS, slug, trim

TARGET, OVERLAP = 700, 100
# What counts as a heading and as the anchor of a page, slide or sheet; both are whole lines.
_INK = r"[^\n\r\x{2028}\x{2029}]"
HEADING = rf"^(#{{1,6}}){WS}+({_INK}*)\z"
NUMBERED, SHEET = rf"^<!--{WS}*(?:page|slide):(\d+){WS}*-->\z", rf"^<!--{WS}*sheet:({_INK}+?){WS}*-->\z"


def annotate_lines(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, line_no, text, heading_path, heading_anchor, page, sheet): every line but the anchors, with the headings and anchors it stands under.

    A window within one document: its heading of each level is alive while no shallower heading came later. A heading's anchor carries its
    number among the headings of the document, from 1. Null Markdown gives no line.
    """
    lines = docs.where(F.col(markdown).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(markdown, "\n")).alias("line_no", "text"))
    level, name = F.length(F.regexp_extract("text", HEADING, 1)), trim(F.regexp_extract("text", HEADING, 2))
    number, sheet = F.regexp_extract("text", NUMBERED, 1), F.regexp_extract("text", SHEET, 1)
    w = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({"level": level, "name": name, "mark": (number != "") | (sheet != ""), "pg": F.when(number != "", number.try_cast("int")), "sh": F.when(sheet != "", sheet)})
    x = x.withColumn("nth", F.sum((F.col("level") > 0).cast("int")).over(w))
    x = x.withColumns({f"h{k}": F.last(F.when(F.col("level") == k, F.struct(F.col("nth").alias("at"), "name")), ignorenulls=True).over(w) for k in range(1, 7)})
    x = x.withColumns({"page": F.last("pg", ignorenulls=True).over(w), "sheet": F.last("sh", ignorenulls=True).over(w), "top": F.last(F.when(F.col("level") > 0, F.col("name")), ignorenulls=True).over(w)})
    alive = []
    for k in range(1, 7):
        c = F.col(f"h{k}")
        newer = F.lit(False)
        for s in range(1, k):
            newer = newer | F.coalesce(F.col(f"h{s}.at") > c["at"], F.lit(False))
        alive.append(F.when(c.isNotNull() & ~newer, c["name"]))
    parts = F.array_compact(F.array(*alive))
    path = F.when(F.size(parts) > 0, F.array_join(parts, " > "))
    return x.where("not mark").select("key", "line_no", "text", path.alias("heading_path"), F.when(F.col("top").isNotNull(), slug(F.col("nth"), F.col("top"))).alias("heading_anchor"), "page", "sheet")


def _within(line: Column, target: int) -> Column:
    """A line as an array of strings of at most the target: neighbouring sentences are put together while they fit; a longer sentence is cut by count."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / target).cast("int")), lambda i: F.substring(s, i * target + 1, F.lit(target)))
    sentences = F.filter(F.split(line, "(?<=。)"), lambda s: s != "")
    units = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= target, F.array(F.struct(s.alias("s"), F.lit(False).alias("cut")))).otherwise(F.transform(cut(s), lambda t: F.struct(t.alias("s"), F.lit(True).alias("cut"))))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    closed = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def add(a: Column, u: Column) -> Column:
        fits = F.length(a["open"]) + F.length(u["s"]) <= target
        return F.when(u["cut"], F.struct(F.concat(closed(a), F.array(u["s"])).alias("done"), F.lit("").alias("open"))).when(fits, F.struct(a["done"].alias("done"), F.concat(a["open"], u["s"]).alias("open"))).otherwise(F.struct(closed(a).alias("done"), u["s"].alias("open")))

    return F.when(F.length(line) <= target, F.array(line)).otherwise(F.aggregate(units, start, add, closed))


def chunk_markdown(docs: DataFrame, key: str, markdown: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, heading_path, heading_anchor, page_from, page_to, sheet_name, text): the chunks of every document, in order.

    A chunk ends where the heading path changes and once its lines reach the target. One that ended for its size hands its last `overlap`
    characters on to the next. Null and blank Markdown gives no chunk, an overlap of 0 hands nothing on. Repeated keys should be removed first.
    """
    lines = annotate_lines(docs, key, markdown).select("key", "line_no", "heading_path", "heading_anchor", "page", "sheet", F.posexplode(_within(F.col("text"), target)).alias("part", "text"))
    whole = lines.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("line_no", "part", "text", "heading_path", "heading_anchor", "page", "sheet"))).alias("x"))
    # where chunks end: (last line, whether the size was reached), appended to only at an end
    ends = F.array().cast("array<struct<at:int,full:boolean>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("path"), ends.alias("ends"))

    def step(a: Column, v: Column) -> Column:
        turned = (a["size"] > 0) & ~v["heading_path"].eqNullSafe(a["path"])
        size = F.when(turned, 0).otherwise(a["size"]) + F.length(v["text"]) + 1
        at = a["i"] + 1
        e = F.when(turned, F.concat(a["ends"], F.array(F.struct((at - 1).alias("at"), F.lit(False).alias("full"))))).otherwise(a["ends"])
        full = size >= target
        return F.struct(at.alias("i"), F.when(full, 0).otherwise(size).alias("size"), v["heading_path"].alias("path"), F.when(full, F.concat(e, F.array(F.struct(at.alias("at"), F.lit(True).alias("full"))))).otherwise(e).alias("ends"))

    last = lambda a: F.when(a["size"] > 0, F.concat(a["ends"], F.array(F.struct(a["i"].alias("at"), F.lit(False).alias("full"))))).otherwise(a["ends"])
    cut = whole.select("key", "x", F.aggregate("x", start, step, last).alias("ends"))
    spans = F.transform(F.arrays_zip("ends", F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e["at"])).alias("since")), lambda z: z)
    one = cut.select("key", "x", F.posexplode(spans).alias("n", "z")).where("z.ends is not null").select("key", "n", F.col("z.ends.full").alias("full"), F.slice("x", F.col("z.since") + 1, F.col("z.ends.at") - F.col("z.since")).alias("x"))
    first = lambda f: F.try_element_at(F.filter(F.transform("x", lambda v: v[f]), lambda v: v.isNotNull()), F.lit(1)).alias(f)
    pages = F.transform("x", lambda v: v["page"])
    parts = one.select("key", "n", "full", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("body"), first("heading_path"), first("heading_anchor"), F.array_min(pages).alias("page_from"), F.array_max(pages).alias("page_to"), first("sheet"))
    # what a full chunk hands on is the end of its own text, so texts follow from one another within a document
    texts = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "full", "body", "heading_path", "heading_anchor", "page_from", "page_to", "sheet"))).alias("x"))
    hand = lambda full, t: F.when(full & F.lit(overlap > 0), F.substring(t, -overlap, max(overlap, 1))).otherwise("")
    joined = lambda carry, body: trim(F.when(carry == "", body).otherwise(F.concat(carry, F.lit("\n"), body)))
    begin = F.struct(F.array().cast("array<string>").alias("texts"), F.lit("").alias("carry"))
    grow = lambda a, v: F.struct(F.concat(a["texts"], F.array(joined(a["carry"], v["body"]))).alias("texts"), hand(v["full"], joined(a["carry"], v["body"])).alias("carry"))
    rows = texts.select("key", F.arrays_zip("x", F.aggregate("x", begin, grow, lambda a: a["texts"]).alias("text")).alias("z"))
    rows = rows.select("key", F.filter("z", lambda z: z["text"] != "").alias("z")).select("key", F.posexplode("z").alias("ordinal", "z"))
    return rows.select("key", "ordinal", *(F.col(f"z.x.{c}").alias(c) for c in ("heading_path", "heading_anchor", "page_from", "page_to")), F.col("z.x.sheet").alias("sheet_name"), "z.text")
