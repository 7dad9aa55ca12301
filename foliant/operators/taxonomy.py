"""Category trees: proposals, paths, classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.providers import ProviderError, TextProvider
from foliant.runtime import materialise

# Fixed value: the category that every tree has.
FALLBACK = "その他"
SEPARATOR = " > "


def tree(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """(root_id, root_name, documents, children): two levels; a node whose parent is unknown is a root; children by sort order.

    `categories`: (id, parent_id, name, sort_order); `counts`: (id, n). Nodes without documents count 0.
    """
    c = categories.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = c.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    c = c.join(known, "parent_id", "left")
    roots = c.where("known is null").select(F.col("id").alias("root_id"), F.col("name").alias("root_name"), F.col("n").alias("own"), F.col("sort_order").alias("root_order"))
    kids = c.where("known").groupBy(F.col("parent_id").alias("root_id")).agg(F.sum("n").alias("below"), F.sort_array(F.collect_list(F.struct("sort_order", "name", "n"))).alias("kids"))
    x = roots.join(kids, "root_id", "left")
    children = F.transform(F.coalesce("kids", F.array().cast("array<struct<sort_order:int,name:string,n:bigint>>")), lambda k: F.concat(k["name"], F.lit(":"), k["n"].cast("string")))
    return x.select("root_id", "root_name", (F.col("own") + F.coalesce("below", F.lit(0))).cast("long").alias("documents"), F.array_join(children, ",").alias("children"), "root_order")


def replace_proposals(categories: DataFrame, proposal: DataFrame) -> DataFrame:
    """Categories with all machine-proposed ones replaced by a new two-level proposal (top, child, or child null); the fallback category is always there."""
    spark = categories.sparkSession
    kept = categories.where("not coalesce(is_ai_proposed, false)")
    p = proposal.where("top is not null").select("top", "child").unionByName(spark.createDataFrame([(FALLBACK, None)], "top string, child string")).distinct()
    key = lambda path: F.substring(F.sha2(path, 256), 1, 26)
    tops = p.select(F.col("top").alias("name"), F.col("top").alias("path"), F.lit(None).cast("string").alias("parent_id")).distinct()
    kids = p.where("child is not null").select(F.col("child").alias("name"), F.concat("top", F.lit(SEPARATOR), "child").alias("path"), key(F.col("top")).alias("parent_id"))
    new = tops.unionByName(kids).distinct().select(key(F.col("path")).alias("id"), "parent_id", "name", "path", F.when(F.col("name") == FALLBACK, 9999).otherwise(0).alias("sort_order"), F.lit(True).alias("is_ai_proposed"))
    return kept.select("id", "parent_id", "name", "path", "sort_order", "is_ai_proposed").unionByName(new.join(kept.select("path"), "path", "left_anti").select("id", "parent_id", "name", "path", "sort_order", "is_ai_proposed"))


def classify(answers: DataFrame, categories: DataFrame) -> DataFrame:
    """(document_id, category_id): the category whose path equals the answer's; null for any other answer."""
    return answers.join(categories.select("path", F.col("id").alias("category_id")), "path", "left").select("document_id", "category_id")


def outlines(documents: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, title, doc_type, outline, headings) of every document that isn't archived and has a current version.

    outline: the first `most` distinct heading paths in code point order; headings: how many there are. A document without headings has an empty outline.
    """
    d = documents.where("status <> 'archived' and current_version_id is not null").select("document_id", "title", "doc_type")
    h = chunks.where("heading_path is not null").select("document_id", "heading_path").distinct()
    g = h.groupBy("document_id").agg(F.sort_array(F.collect_set("heading_path")).alias("all"))
    x = d.join(g, "document_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    return x.select("document_id", "title", "doc_type", F.array_join(F.slice("all", 1, most), " | ").alias("outline"), F.size("all").cast("long").alias("headings"))


def summary_line() -> Column:
    """A document as a line of a prompt: title, type, outline."""
    return F.concat_ws(" | ", F.concat(F.lit("- "), "title"), F.col("doc_type"), F.when(F.col("outline") != "", F.col("outline")))


def propose(outlines_: DataFrame, provider: TextProvider, prompt_lines: int = 2_000) -> DataFrame:
    """(top, child) as the provider proposes them from all documents; its answer is {"categories": [{"name", "children"}]}.

    Every document is read. A call takes at most `prompt_lines` documents, so a large archive is proposed for in parts, in the tasks, and
    the parts' proposals are united; only those few rows travel.
    """
    rows = outlines_.select(summary_line().alias("line"))
    parts = max(1, -(-rows.count() // prompt_lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [x for b in batches for x in b["line"]]
        for a in range(0, len(lines), prompt_lines):
            got = provider.complete_json("\n".join(sorted(lines[a : a + prompt_lines])), ("categories",))["categories"]
            yield pd.DataFrame([(c["name"], k) for c in got for k in [*c.get("children", []), None]], columns=["top", "child"])

    return rows.repartition(parts).mapInPandas(run, "top string, child string").distinct()


def without_proposed(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents whose category was a machine-proposed one have none any more, as those are replaced."""
    gone = categories.where("coalesce(is_ai_proposed, false)").select(F.col("id").alias("category_id"), F.lit(True).alias("gone"))
    return documents.join(gone, "category_id", "left").withColumn("category_id", F.when(F.col("gone").isNull(), F.col("category_id"))).drop("gone").select(*documents.columns)


def classify_all(documents: DataFrame, outlines_: DataFrame, categories: DataFrame, provider: TextProvider, now: int, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """The documents after every unclassified one that isn't archived was given the category whose path the provider names.

    An answer that is no path, or a failed call, leaves the document without one. The paths are a small fixed list (1,000 at most) and part of every prompt.
    `progress` is told (done, total) from the counters of the run when it is over; the tasks count into an accumulator, which a listener may read meanwhile.
    """
    spark = documents.sparkSession
    paths = [r[0] for r in categories.select("path").distinct().orderBy("path").limit(1_001).collect()]
    if len(paths) > 1_000:
        raise ValueError("more than 1,000 categories don't fit a prompt")
    todo = unclassified(documents).select("document_id").join(outlines_, "document_id", "left").select("document_id", F.coalesce(summary_line(), F.lit("")).alias("line"))
    done = spark.sparkContext.accumulator(0)
    head = "\n".join(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for line in b["line"]:
                try:
                    said.append(str(provider.complete_json(f"{head}\n---\n{line}", ("categoryPath",))["categoryPath"]).strip())
                except ProviderError:
                    said.append(None)
                done.add(1)
            yield pd.DataFrame({"document_id": b["document_id"], "path": said})

    answers = materialise(classify(todo.mapInPandas(run, "document_id string, path string"), categories), "classified")
    if progress is not None:
        total = answers.count()
        progress(min(done.value, total), total)
    x = documents.join(answers.select("document_id", F.col("category_id").alias("chosen"), F.lit(True).alias("asked")), "document_id", "left")
    out = x.withColumns({"category_id": F.coalesce("category_id", "chosen"), "updated_at": F.when(F.col("asked"), F.lit(now).cast("long")).otherwise(F.col("updated_at"))})
    return out.select(*documents.columns)


def unclassified(documents: DataFrame) -> DataFrame:
    """Documents that aren't archived and have no category."""
    return documents.where("status <> 'archived' and category_id is null")
