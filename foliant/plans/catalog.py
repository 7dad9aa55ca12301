"""Queries of the core operators by name, each over whole tables, with DuckDB counterparts where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foliant.functions.highlight import highlight
from foliant.functions.quality import needs_fallback, quality
from foliant.functions.segment import query_terms, words
from foliant.functions.shingle import containment, jaccard, shingles, simhash48
from foliant.functions.text import accepted, extension, mime_type, strip_anchors, title_from_filename, utf16_length
from foliant.operators import chunk, contradiction, dedupe, diff, fts, hybrid, ingest, taxonomy, vector
from foliant.plans import reports
from foliant.providers import HashingEmbedder
from foliant.runtime import materialise, spread, table
from foliant.streaming import jobs

NOW = 1_767_225_600_000
QUERY = ["supply", "review"]


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.list_documents(*_t(spark, d, "managed_documents", "document_versions", "chunks"))


def document_details(spark: SparkSession, d: str) -> DataFrame:
    return reports.document_details(*_t(spark, d, "managed_documents", "document_versions", "people"))


def versions_with_previous(spark: SparkSession, d: str) -> DataFrame:
    return reports.versions_with_previous(*_t(spark, d, "managed_documents", "document_versions"))


def stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats_by(*_t(spark, d, "managed_documents", "document_versions"), "doc_type")


def stats_by_engine(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats_by(*_t(spark, d, "managed_documents", "document_versions"), "conversion_engine")


def governance_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.governance_summary(*_t(spark, d, "managed_documents", "document_versions", "document_relations"))


def open_relations(spark: SparkSession, d: str) -> DataFrame:
    return reports.open_relations(*_t(spark, d, "managed_documents", "document_versions", "document_relations"))


def superseded_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.superseded_documents(*_t(spark, d, "document_versions", "document_relations"))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_freshness(*_t(spark, d, "managed_documents", "document_versions", "people", "document_relations"), NOW)


def freshness_scores(spark: SparkSession, d: str) -> DataFrame:
    return _fresh(spark, d).withColumn("review_due_at", F.col("review_due_at").cast("string"))


def freshness_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return reports.heatmap(_fresh(spark, d))


def due_soon(spark: SparkSession, d: str) -> DataFrame:
    """The eight documents whose review is due next."""
    return _fresh(spark, d).where("review_due_at is not null").orderBy("review_due_at", "document_id").limit(8).select("document_id", "review_due_at")


def overdue(spark: SparkSession, d: str) -> DataFrame:
    return _fresh(spark, d).where("overdue_days > 0").select("document_id", "overdue_days")


def finding_titles(spark: SparkSession, d: str) -> DataFrame:
    return reports.finding_titles(*_t(spark, d, "document_relations", "document_versions", "managed_documents"))


def visible_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, people = _t(spark, d, "managed_documents", "people")
    x = docs.join(people.withColumnRenamed("person_id", "owner_person_id"), "owner_person_id", "left")
    return x.where(fts.filters(doc_types=["manual", "regulation"], updated_after=1_600_000_000_000)).select("document_id", "title", "department")


def category_tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions over nations as a two-level tree, customers as their documents."""
    region, nation, customer = _t(spark, d, "region", "nation", "customer")
    cats = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("sort_order")).unionByName(
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("sort_order"))
    )
    counts = customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("id")).agg(F.count("*").alias("n"))
    return taxonomy.tree(cats, counts).drop("root_order", "root_id")


def document_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Every document that isn't archived and has a current version, with its first heading paths."""
    return taxonomy.outlines(*_t(spark, d, "managed_documents", "chunks"))


def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.counts(table(spark, d, "events"), ("click", "error", "purchase", "signup"), "event_type")


def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The fifty latest events."""
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type")


def by_severity(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most urgent, latest orders."""
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return o.orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type, taken as a stream."""
    tag = uuid.uuid4().hex
    from foliant.runtime import shared_dir

    return jobs.stream_counts(spark, d, "events.parquet", f"{shared_dir(spark)}/stream-{tag}", f"events_{tag}")


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    x = jobs.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# ---- files and ingest


def file_names(spark: SparkSession, d: str) -> DataFrame:
    v = reports.once(table(spark, d, "document_versions"), "version_id")
    f = F.col("original_filename")
    return v.select("version_id", extension(f).alias("extension"), mime_type(f).alias("mime"), title_from_filename(f).alias("title"), F.coalesce(accepted(f), F.lit(False)).alias("accepted"))


def ingest_new(spark: SparkSession, d: str) -> DataFrame:
    """documents.text as uploads into an empty archive: which become documents, which are duplicates of which."""
    docs = table(spark, d, "documents")
    up = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("error"), F.lit("a.docx").alias("filename"), F.lit(None).cast("string").alias("mime"), F.lit(0).cast("long").alias("bytes"))
    none = table(spark, d, "document_versions").where("false")
    fresh, old = ingest.new_documents(up, none, NOW)
    return fresh.select("document_id", F.lit("new").alias("outcome")).unionByName(old.select("document_id", F.lit("duplicate").alias("outcome"))).groupBy("document_id", "outcome").agg(F.count("*").alias("n"))


def next_version_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "document_versions")
    return v.groupBy("document_id").agg((F.coalesce(F.max("version_no"), F.lit(0)) + 1).cast("int").alias("next_version_no"))


def merged_relations(spark: SparkSession, d: str) -> DataFrame:
    """The stored relations after a scan that found every near_dup pair again with another score."""
    r = reports.once(table(spark, d, "document_relations"), "relation_id").where("a_version_id is not null and b_version_id is not null")
    old = r.select("relation_id", F.least("a_version_id", "b_version_id").alias("a"), F.greatest("a_version_id", "b_version_id").alias("b"), "kind", "score", "evidence", "status", "detected_at").withColumn("n", F.row_number().over(Window.partitionBy("a", "b", "kind").orderBy("relation_id"))).where("n = 1").drop("n")
    found = old.where("kind = 'near_dup'").select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", F.lit(0.5).alias("score"), F.lit("{}").alias("evidence"))
    return dedupe.upsert_relations(old, found, NOW).select("relation_id", "kind", "score", "status", "detected_at")


# ---- text


def markdown_bodies(spark: SparkSession, d: str) -> DataFrame:
    v = reports.once(table(spark, d, "document_versions"), "version_id").where("markdown is not null")
    s = strip_anchors(F.col("markdown"))
    return v.select("version_id", F.sha2(s, 256).alias("body_sha"), utf16_length(F.col("markdown")).cast("long").alias("units"))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "conversion_results").select("version_id", quality(F.col("page_texts")).alias("q"))
    r = lambda c: F.round(f"q.{c}", 6).alias(c)
    return q.select("version_id", r("confidence"), r("chars_per_page"), r("blank_page_ratio"), r("garbled_ratio"), r("cjk_ratio"), F.col("q.text_length").cast("long").alias("text_length"), needs_fallback(F.col("q.confidence")).alias("fallback"))


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = reports.once(table(spark, d, "chunks"), "chunk_id")
    w = words(F.col("text"), "simple")
    return c.select("chunk_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(shingles(w))).cast("long").alias("n_shingles"))


def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    """The hundred words that stand in most chunks."""
    c = reports.once(table(spark, d, "chunks"), "chunk_id").select("chunk_id", F.explode(F.array_distinct(words(F.col("text"), "simple"))).alias("word"))
    return c.groupBy("word").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "word").limit(100)


def annotated_lines(spark: SparkSession, d: str) -> DataFrame:
    v = reports.once(table(spark, d, "document_versions"), "version_id")
    return chunk.annotate_lines(v, "version_id", "markdown").withColumn("page", F.col("page").cast("string"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = reports.once(table(spark, d, "document_versions"), "version_id")
    return chunk.chunk_markdown(v, "version_id", "markdown").withColumnRenamed("key", "version_id").withColumns({"chars": F.length("text"), "page_from": F.col("page_from").cast("string"), "page_to": F.col("page_to").cast("string")}).drop("text")


def version_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Line changes between every version and the one before it."""
    v = reports.once(table(spark, d, "document_versions"), "version_id")
    w = Window.partitionBy("document_id").orderBy("version_no", "version_id")
    p = v.select("version_id", strip_anchors(F.col("markdown")).alias("new"), F.lag(strip_anchors(F.col("markdown"))).over(w).alias("old"), F.lag("version_id").over(w).alias("before")).where("before is not null")
    r = p.select("version_id", F.explode_outer(diff.diff_runs(F.col("old"), F.col("new"))).alias("r"))
    return r.groupBy("version_id").agg(F.sum(F.when(F.col("r.kind") == "added", F.col("r.lines")).otherwise(0)).alias("added"), F.sum(F.when(F.col("r.kind") == "removed", F.col("r.lines")).otherwise(0)).alias("removed"))


# ---- search


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = reports.once(table(spark, d, "chunks"), "chunk_id")
    docs = table(spark, d, "managed_documents").where("status <> 'archived'").select("document_id")
    return c, c.select(F.col("chunk_id").alias("id"), "document_id").join(docs, "document_id", "left_semi")


def _keyword(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, visible = _chunks(spark, d)
    return fts.bm25(fts.build_index(c, "chunk_id", "title", "heading_path", "text", "simple", keep=True), QUERY), visible


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    hits, visible = _keyword(spark, d)
    return hits.join(visible, "id").orderBy("score", "id").limit(30).select(F.col("id").alias("chunk_id"), "document_id", F.round("score", 6).alias("score"))


def _filterable(spark: SparkSession, d: str) -> DataFrame:
    """Every document with all that a search can filter by: owner's department, engine of the current version, freshness."""
    docs, people, versions = _t(spark, d, "managed_documents", "people", "document_versions")
    v = reports.once(versions, "version_id").select(F.col("version_id").alias("current_version_id"), "conversion_engine")
    p = people.select(F.col("person_id").alias("owner_person_id"), "department")
    f = _fresh(spark, d).select("document_id", F.col("score").alias("freshness_score"))
    return docs.join(v, "current_version_id", "left").join(p, "owner_person_id", "left").join(f, "document_id", "left")


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits for one word among the documents that pass filters of type, department, engine, date, status and freshness."""
    c = reports.once(table(spark, d, "chunks"), "chunk_id")
    x = _filterable(spark, d)
    want = fts.filters(doc_types=["minutes", "report", "manual", "regulation", "contract", "other", "sheet"], department="Human Resources", engine="local:mammoth+turndown", updated_after=1_600_000_000_000, freshness_max=95.0, columns=tuple(x.columns))
    visible = c.select(F.col("chunk_id").alias("id"), "document_id").join(x.where(want).select("document_id"), "document_id", "left_semi")
    hits = fts.search(fts.build_index(c, "chunk_id", "title", "heading_path", "text", "simple"), ["review"], visible)
    return hits.select(F.col("id").alias("chunk_id"), "document_id", F.round("score", 6).alias("score"))


JAPANESE = "勤怠申請書の保存期間"


def _japanese(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    c, visible = _chunks(spark, d)
    terms = query_terms(spark, JAPANESE)
    return fts.bm25(fts.build_index(c, "chunk_id", "title", "heading_path", "text", keep=True), terms), visible, terms


def japanese_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits for a Japanese question, parted like the texts by the dictionary, best first and grouped by document."""
    hits, visible, _ = _japanese(spark, d)
    top = hits.join(visible, "id").orderBy("score", "id").limit(30)
    return fts.group_by_document(top, "document_id").select(F.col("id").alias("chunk_id"), "document_id", "hit_no", F.round("score", 6).alias("score"))


def japanese_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that answer a Japanese question, with excerpts around its words."""
    hits, visible, terms = _japanese(spark, d)
    c = reports.once(table(spark, d, "chunks"), "chunk_id").select(F.col("chunk_id").alias("id"), "text")
    x = hits.join(visible, "id").join(c, "id")
    h = spread(x).select(F.col("id").alias("chunk_id"), highlight(F.col("text"), F.array(*map(F.lit, terms))).alias("h"))
    return h.select("chunk_id", F.size("h").alias("excerpts"), F.exists(F.col("h")[0]["segments"], lambda s: s["hit"]).alias("has_hit"))


def japanese_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """As near_duplicates, with words by the dictionary."""
    reps = materialise(dedupe.representatives(_current(spark, d)), "contents")
    return dedupe.classify(dedupe.near_pairs(reps), reps).select("a", "b", "kind", F.round("score", 6).alias("score"), "hamming")


def grouped_hits(spark: SparkSession, d: str) -> DataFrame:
    hits, visible = _keyword(spark, d)
    top = hits.join(visible, "id").orderBy("score", "id").limit(30)
    return fts.group_by_document(top, "document_id").select(F.col("id").alias("chunk_id"), "document_id", "hit_no", F.round("best_score", 6).alias("best_score"), F.col("extra_hits").cast("long").alias("extra_hits"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    e = table(spark, d, "chunk_embeddings").where(vector.usable(F.col("embedding")) & (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))
    return e.orderBy("chunk_id").limit(1).first()["embedding"]


def _semantic(spark: SparkSession, d: str, limit: int) -> DataFrame:
    visible = table(spark, d, "managed_documents").where("status <> 'archived'").select("document_id")
    e = table(spark, d, "chunk_embeddings").join(visible, "document_id", "left_semi")
    return vector.nearest_to(e, "chunk_id", "embedding", _query_vector(spark, d), limit)


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d, 30).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits, visible = _keyword(spark, d)
    x = hybrid.hybrid(hits.join(visible, "id").select("id", "score"), _semantic(spark, d, 50), visible)
    return x.select(F.col("id").alias("chunk_id"), F.round("rrf", 6).alias("rrf"), "matched_by")


def unembedded(spark: SparkSession, d: str) -> DataFrame:
    return vector.missing(*_t(spark, d, "chunks", "chunk_embeddings", "managed_documents")).select("chunk_id", "document_id")


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the stand-in provider for all chunks without one."""
    return vector.backfill(spread(vector.missing(*_t(spark, d, "chunks", "chunk_embeddings", "managed_documents"))), HashingEmbedder()).select("chunk_id", F.size("embedding").cast("long").alias("size"))


def highlighted(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of every chunk around the query."""
    c = reports.once(table(spark, d, "chunks"), "chunk_id")
    h = spread(c.select("chunk_id", "text")).select("chunk_id", highlight(F.col("text"), F.array(*map(F.lit, QUERY))).alias("h"))
    return h.select("chunk_id", F.size("h").alias("excerpts"), F.col("h")[0]["offset"].alias("first_offset"), F.exists(F.col("h")[0]["segments"], lambda s: s["hit"]).alias("has_hit"))


# ---- duplicates


def _current(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.current_versions(*_t(spark, d, "managed_documents", "document_versions"))


def exact_classes(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.exact_classes(_current(spark, d)).select("version_id", "first_version_id", "copies")


def simhash_values(spark: SparkSession, d: str) -> DataFrame:
    c = spread(_current(spark, d))
    return c.select("version_id", simhash48(shingles(words(F.col("markdown"), "simple"))).alias("simhash"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Kind and score for all pairs of different contents whose hashes are near."""
    reps = materialise(dedupe.representatives(_current(spark, d), "simple"), "contents")
    x = dedupe.classify(dedupe.near_pairs(reps), reps)
    return x.select("a", "b", "kind", F.round("score", 6).alias("score"), "hamming")


def contradiction_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The sixty pairs of passages with figures or rules, of different documents that aren't archived, that are most alike without being the same."""
    c, visible = _chunks(spark, d)
    c = c.where(contradiction.has_signal(F.col("text"))).select(F.col("chunk_id").alias("id"), "text").join(visible, "id")
    return contradiction.candidates(c, profile="simple").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def relation_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness and containment of the two texts of every stored relation between known versions."""
    v = reports.once(table(spark, d, "document_versions"), "version_id").where("markdown is not null").select("version_id", F.array_distinct(shingles(words(F.col("markdown"), "simple"))).alias("s"))
    r = reports.once(table(spark, d, "document_relations"), "relation_id").select("relation_id", "a_version_id", "b_version_id")
    x = r.join(v.select(F.col("version_id").alias("a_version_id"), F.col("s").alias("sa")), "a_version_id").join(v.select(F.col("version_id").alias("b_version_id"), F.col("s").alias("sb")), "b_version_id")
    return x.select("relation_id", F.round(jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"), F.round(containment(F.col("sa"), F.col("sb")), 6).alias("containment"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        list_documents, document_details, versions_with_previous, stats_by_type, stats_by_engine, governance_summary, open_relations, superseded_documents, freshness_scores, freshness_heatmap, due_soon, overdue, finding_titles,
        visible_documents, category_tree, document_outlines, job_counts, recent_jobs, by_severity, stream_event_counts, hourly_events, file_names, ingest_new, next_version_numbers, merged_relations, markdown_bodies, quality_gate,
        token_statistics, frequent_words, annotated_lines, markdown_chunks, version_diffs, bm25_search, grouped_hits, filtered_search, japanese_search, japanese_excerpts, japanese_near_duplicates, cosine_topk, rrf_fusion, unembedded, backfilled, highlighted, exact_classes, simhash_values, near_duplicates,
        contradiction_candidates, relation_likeness,
    )
}
