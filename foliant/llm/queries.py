"""The pN_ queries: each operator on the archive's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import components, langid, leaks, lookalike, neardup, neighbours, ocr, packing, splitting
from foliant.llm.hot import group_pairs
from foliant.runtime import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


# ---- 1: near-duplicates with small edits


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of versions of different documents whose markdown is at least 60 % alike."""
    return neardup.similar_pairs(table(spark, d, "document_versions"), "version_id", "document_id", "markdown").select(F.col("a").alias("a_version_id"), F.col("b").alias("b_version_id"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every version with the class of its text and the number of classes like it."""
    return neardup.classes_with_links(table(spark, d, "document_versions"), "version_id", "document_id", "markdown").withColumnRenamed("key", "version_id")


# ---- 2: visually identical text


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks stored differently that look the same."""
    m = materialise(lookalike.lookalike_members(table(spark, d, "chunks"), "chunk_id", "text").distinct(), "lookalike")
    pairs = group_pairs(m, "class_id", "key", "a.stored <> b.stored and a.key < b.key")
    return pairs.select(F.col("a.key").alias("a_chunk_id"), F.col("b.key").alias("b_chunk_id")).distinct()


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text in the form shared by all texts that look like it."""
    got = lookalike.canonical_texts(table(spark, d, "chunks"), "chunk_id", "text")
    return got.select(F.col("key").alias("chunk_id"), F.sha2("canonical", 256).alias("canonical_sha"), F.length("canonical").cast("long").alias("canonical_chars"), "changed")


# ---- 3: groups from pairwise matches


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version that a counting relation links, with the smallest version of its group."""
    links = components.counting_links(table(spark, d, "document_relations"))
    return components.connected_groups(links, "a_version_id", "b_version_id").select(F.col("member").alias("version_id"), "group_id")


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Groups by number of members."""
    sizes = p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("groups"))


# ---- 4: text from scanned pages


def _repaired(spark: SparkSession, d: str, paragraphs: bool) -> DataFrame:
    results = table(spark, d, "conversion_results")
    return ocr.repair_results(results, ocr.fit(results), paragraphs=paragraphs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Damaged lines of the pages."""
    return _repaired(spark, d, False).select("version_id", F.explode("defects").alias("x")).select("version_id", "x.page_no", "x.line_no", "x.defect").distinct()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every result, paragraph by paragraph."""
    return _repaired(spark, d, True).select("version_id", F.posexplode("paragraphs").alias("paragraph_no", "text"))


# ---- 5: most similar vectors

ALIKE = 0.85


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chunks of every chunk with a usable vector."""
    return neighbours.nearest(table(spark, d, "chunk_embeddings"), "chunk_id", "embedding", wanted=0.95, digits=10).select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round(F.col("cosine").cast("double"), 5).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at 0.85 or more of which one is among the five most similar of the other."""
    near = neighbours.nearest(table(spark, d, "chunk_embeddings"), "chunk_id", "embedding", least=ALIKE - 1e-6).where(F.col("cosine") >= ALIKE - 1e-7)
    return near.select(F.least("id", "neighbour").alias("a_chunk_id"), F.greatest("id", "neighbour").alias("b_chunk_id")).distinct()


# ---- 6: pieces of oversized sections


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All sections cut to their target, with overlap."""
    return splitting.split_sections(table(spark, d, "markdown_sections")).drop("text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized sections with the coarsest boundary that suffices."""
    return splitting.split_sections(table(spark, d, "markdown_sections")).where("piece_no = 0 and boundary is not null").select("section_id", "boundary")


# ---- 7: containers of fixed capacity


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity of token_budgets."""
    return packing.fill_containers(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "token_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused tokens of each budget."""
    bins = p7_containers(spark, d).groupBy("budget_id", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return bins.groupBy("budget_id", "capacity").agg(F.count("*").alias("containers"), F.sum(F.col("capacity") - F.col("used")).alias("unused"))


# ---- 8: evaluation passages in the corpus


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold a passage (phrase) or most words near each other (near), with the share of the item that they hold."""
    m = leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return m.withColumn("share", F.round(F.col("covered") / F.col("item_words"), 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat at least half of an item."""
    return p8_matches(spark, d).where("kind = 'phrase'").where(F.col("covered") * 2 >= F.col("item_words")).select("doc_id", "item_id")


# ---- 9: languages


def _languages(spark: SparkSession, d: str, segments: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.identify(docs, langid.fit_trees(docs), segments=segments)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong, or that hold several."""
    rows = _languages(spark, d).where("label is null or size(languages) > 1 or not array_contains(languages, label)")
    return rows.select("doc_id", F.explode("languages").alias("lang"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document with language and confidence."""
    s = _languages(spark, d, True).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return s.select("doc_id", "segment_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.round("s.confidence", 6).alias("confidence"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_canonical, p3_found, p3_group_sizes, p4_found, p4_paragraphs, p5_found, p5_neighbours, p6_found, p6_pieces, p7_containers, p7_fill, p8_found, p8_matches, p9_found, p9_segments)}
