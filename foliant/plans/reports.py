"""Named queries over the archive's tables: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.functions import freshness as fr
from foliant.functions.text import human_bytes

LOW = 0.6


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key's row once, however often it was delivered."""
    return df.dropDuplicates([key])


def list_documents(docs: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that aren't archived with engine and confidence of their current version and the number of their chunks over all versions."""
    v = once(versions, "version_id").select("version_id", "conversion_engine", "conversion_confidence", "version_no")
    n = chunks.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("chunk_count"))
    d = docs.where("status <> 'archived'")
    x = d.join(v, d.current_version_id == v.version_id, "left").join(n, "document_id", "left")
    return x.select("document_id", "title", "doc_type", "version_no", "conversion_engine", "conversion_confidence", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "created_at")


def document_details(docs: DataFrame, versions: DataFrame, people: DataFrame) -> DataFrame:
    """Every document with its owner's name, the size of its current file and the state of its conversion."""
    v = once(versions, "version_id").select("version_id", "original_filename", "original_bytes", "conversion_engine", "conversion_confidence")
    p = people.select(F.col("person_id").alias("owner_person_id"), F.col("display_name").alias("owner_name"))
    x = docs.join(v, docs.current_version_id == v.version_id, "left").join(p, "owner_person_id", "left")
    return x.select("document_id", "owner_name", "original_filename", human_bytes(F.col("original_bytes")).alias("size"), conversion_badge().alias("badge"))


def conversion_badge(engine: str = "conversion_engine", confidence: str = "conversion_confidence") -> Column:
    """unconverted, check, ai or local."""
    return F.when(F.col(engine).isNull(), "unconverted").when(F.col(confidence) < LOW, "check").when(F.startswith(F.col(engine), F.lit("local-llm:")), "ai").otherwise("local")


def versions_with_previous(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Every version with the one before it, newest first within its document, and whether it is the current one."""
    v = once(versions, "version_id").select("version_id", "document_id", "version_no")
    w = Window.partitionBy("document_id").orderBy("version_no", "version_id")
    c = docs.select("document_id", "current_version_id")
    x = v.withColumn("previous_version_id", F.lag("version_id").over(w)).join(c, "document_id", "left")
    return x.select("document_id", "version_id", "version_no", "previous_version_id", F.coalesce(F.col("version_id") == F.col("current_version_id"), F.lit(False)).alias("is_current"))


def stats_by(docs: DataFrame, versions: DataFrame, column: str) -> DataFrame:
    """Documents that aren't archived by a column of theirs or of their current version; null is a group."""
    v = once(versions, "version_id").select("version_id", "conversion_engine")
    d = docs.where("status <> 'archived'")
    x = d if column in docs.columns else d.join(v, d.current_version_id == v.version_id, "left")
    return x.groupBy(column).agg(F.count("*").alias("n"))


def governance_summary(docs: DataFrame, versions: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of key figures: documents, low-confidence conversions, ones without owner, AI conversions, open relations."""
    v = once(versions, "version_id").select("version_id", "conversion_engine", "conversion_confidence")
    d = docs.where("status <> 'archived'").join(v, F.col("current_version_id") == v.version_id, "left")
    n = d.agg(
        F.count("*").alias("documents"),
        F.count(F.when(F.col("conversion_confidence") < LOW, 1)).alias("low_confidence"),
        F.count(F.when(F.col("owner_person_id").isNull(), 1)).alias("orphans"),
        F.count(F.when(F.startswith("conversion_engine", F.lit("local-llm:")), 1)).alias("ai_converted"),
    )
    r = relations.where("status = 'open'").agg(F.countDistinct("relation_id").alias("open_relations"))
    return n.join(r, F.lit(True))  # one row each


def open_relations(docs: DataFrame, versions: DataFrame, relations: DataFrame) -> DataFrame:
    """Open relations whose two versions are known, with both titles."""
    r = once(relations.where("status = 'open'"), "relation_id").select("relation_id", "kind", "score", "a_version_id", "b_version_id", "detected_at")
    v = once(versions, "version_id").select("version_id", "document_id").join(docs.select("document_id", "title"), "document_id")
    a = v.select(F.col("version_id").alias("a_version_id"), F.col("title").alias("a_title"))
    b = v.select(F.col("version_id").alias("b_version_id"), F.col("title").alias("b_title"))
    return r.join(a, "a_version_id").join(b, "b_version_id").select("relation_id", "kind", "score", "a_title", "b_title", "detected_at")


def superseded_documents(versions: DataFrame, relations: DataFrame) -> DataFrame:
    """Documents on the strictly older side of an open near_dup or contained_in relation to another document."""
    v = once(versions, "version_id").select("version_id", "document_id", "created_at")
    r = relations.where("status = 'open' and kind in ('near_dup', 'contained_in')").select("a_version_id", "b_version_id").distinct()
    x = r.join(v.select(F.col("version_id").alias("a_version_id"), F.col("document_id").alias("da"), F.col("created_at").alias("ta")), "a_version_id").join(v.select(F.col("version_id").alias("b_version_id"), F.col("document_id").alias("db"), F.col("created_at").alias("tb")), "b_version_id")
    old = F.when(F.col("ta") < F.col("tb"), F.col("da")).when(F.col("tb") < F.col("ta"), F.col("db"))
    return x.where("da <> db").select(old.alias("document_id")).where("document_id is not null").distinct()


def with_freshness(docs: DataFrame, versions: DataFrame, people: DataFrame, relations: DataFrame, now: int) -> DataFrame:
    """Freshness of every document that isn't archived and has a current version; a stated review date goes before the one that follows from interval, last review and effect."""
    v = once(versions, "version_id").select("version_id", F.col("created_at").alias("version_created_at"), "conversion_confidence")
    s = superseded_documents(versions, relations).withColumn("superseded", F.lit(True))
    p = people.select(F.col("person_id").alias("owner_person_id"), F.col("display_name").alias("owner_name"))
    d = docs.where("status <> 'archived'")
    x = d.join(v, d.current_version_id == v.version_id).join(s, "document_id", "left").join(p, "owner_person_id", "left")
    at = F.lit(now)
    own = lambda c: F.col(c).cast("long") if c in docs.columns else F.lit(None).cast("long")
    due = fr.review_due(F.col("doc_type"), own("review_interval_days"), own("last_reviewed_at"), own("effective_date"), F.col("version_created_at"))
    x = x.withColumn("review_due_at", F.coalesce(own("review_due_at"), due))
    overdue = F.coalesce(at > F.col("review_due_at"), F.lit(False))
    x = x.withColumns({"overdue_days": F.when(overdue, fr.days_between(F.col("review_due_at"), at)), "age_days": fr.days_between(F.col("version_created_at"), at)})
    score = fr.freshness(F.col("doc_type"), F.col("age_days"), F.col("overdue_days"), F.col("owner_person_id").isNotNull(), F.coalesce("superseded", F.lit(False)), F.coalesce(F.col("conversion_confidence") < LOW, F.lit(False)))
    return x.withColumn("score", score).select("document_id", "doc_type", "owner_name", "review_due_at", F.coalesce("overdue_days", F.lit(0)).cast("long").alias("overdue_days"), F.round("score", 6).alias("score"), fr.band(F.col("score")).alias("band"))


def heatmap(rows: DataFrame) -> DataFrame:
    """Documents by type and band, 0 where there is none."""
    p = rows.groupBy("doc_type").pivot("band", ["healthy", "review", "action"]).agg(F.count(F.lit(1))).fillna(0, ["healthy", "review", "action"])
    return p.select("doc_type", *(F.col(c).cast("long") for c in ("healthy", "review", "action")))


def finding_titles(relations: DataFrame, versions: DataFrame, docs: DataFrame) -> DataFrame:
    """(relation_id, titles): the titles of both ends of a relation; the id itself for an end that isn't known."""
    ends = once(relations, "relation_id").select("relation_id", F.explode(F.array_compact(F.array("a_version_id", "b_version_id"))).alias("version_id"))
    v = once(versions, "version_id").select("version_id", "document_id").join(docs.select("document_id", "title"), "document_id", "left").select("version_id", "title")
    x = ends.join(v, "version_id", "left").withColumn("t", F.coalesce("title", "version_id"))
    return x.groupBy("relation_id").agg(F.array_join(F.sort_array(F.collect_list("t")), " / ").alias("titles"))  # two at most
