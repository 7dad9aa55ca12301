"""From a landing folder to the archive's tables: convert, assess, chunk, index, embed, compare. Incremental and repeatable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions.quality import needs_fallback, quality
from foliant.functions.segment import enable_icu, words
from foliant.functions.shingle import shingles, simhash48
from foliant.operators import chunk, dedupe, ingest, vector
from foliant.providers import EmbeddingProvider
from foliant.runtime import materialise
from foliant.schemas import evolve, schema
from foliant.sources import files

VERSION_COLUMNS = "version_id string, document_id string, version_no int, original_sha256 string, original_filename string, original_mime string, original_bytes long, title string, created_at long, markdown string, content_hash string, simhash long, conversion_engine string, conversion_confidence double, needs_fallback boolean, error string"
RELATION_COLUMNS = "relation_id string, a string, b string, kind string, score double, evidence string, status string, detected_at long"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    p, fs = _path(spark, path)
    return spark.read.schema(ddl).parquet(path).select(*(c.split()[0] for c in ddl.split(", "))) if fs.exists(p) else spark.createDataFrame([], ddl)


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete copies of a table that is written anew each time, oldest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")[0]))


def current(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The newest complete copy of a table of generations; empty if there is none."""
    have = _generations(spark, path)
    return spark.read.schema(ddl).parquet(f"{path}/gen={have[-1]}") if have else spark.createDataFrame([], ddl)


def publish(df: DataFrame, path: str) -> None:
    """Write a new copy beside the old one, which stays readable till the new one is complete; older ones are deleted."""
    spark = df.sparkSession
    have = _generations(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/gen={have[-1] + 1 if have else 0}")
    for old in have[:-1]:
        p, fs = _path(spark, f"{path}/gen={old}")
        fs.delete(p, True)


def documents(spark: SparkSession, archive: str) -> DataFrame:
    return current(spark, f"{archive}/documents", schema("managed_documents").simpleString()[7:-1].replace(":", " "))


def relations(spark: SparkSession, archive: str) -> DataFrame:
    return current(spark, f"{archive}/relations", RELATION_COLUMNS)


def _found_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, kind, score, evidence) that the new versions have with the current ones: the stored hashes are compared, and texts are read of the pairs alone."""
    v = old.unionByName(new).where("markdown is not null and markdown <> ''")
    newest = v.groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("version_id"))
    now = v.join(newest, ["document_id", "version_id"], "left_semi").select("version_id", "document_id", "content_hash", "simhash")
    one = now.groupBy("content_hash").agg(F.min("version_id").alias("content_id"), F.when(F.min("document_id") == F.max("document_id"), F.min("document_id")).alias("owner"), F.first("simhash").alias("simhash"))
    fresh = materialise(now.join(new.select("version_id"), "version_id", "left_semi").join(one, "content_hash").select("version_id", "content_id", "content_hash"), "fresh")
    same = now.join(one.select("content_hash", "content_id"), "content_hash").join(fresh.select("content_hash").distinct(), "content_hash", "left_semi").where("version_id <> content_id")
    exact = same.select(F.col("content_id").alias("a"), F.col("version_id").alias("b"), F.lit("exact_dup").alias("kind"), F.lit(1.0).alias("score"), F.lit("{}").alias("evidence"))
    points = one.select(F.col("content_id").alias("version_id"), F.col("owner").alias("document_id"), "simhash")
    pairs = materialise(dedupe.near_pairs(points, fresh=fresh.select(F.col("content_id").alias("version_id"))), "near")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("version_id")).distinct()
    texts = v.join(ends, "version_id", "left_semi").select("version_id", F.array_distinct(shingles(words(F.col("markdown")))).alias("shingles"))
    near = dedupe.classify(pairs, texts).select("a", "b", "kind", "score", F.to_json(F.struct("hamming", "jaccard", "containment")).alias("evidence"))
    return exact.unionByName(near)


def ingest_batch(uploads: DataFrame, archive: str, now: int, embedder: EmbeddingProvider | None = None, fallback: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add one batch of uploads to the tables below `archive`: chunks, embeddings, Markdown files, relations, documents, versions.

    An upload with a document_id is the next version of that document, the others are new documents. Bytes that are known
    are not added again. A file that can't be read becomes a version with an error and no text. `fallback` may replace converted
    rows of low confidence; without one they stay, marked. The versions come last, so a batch that broke off is done again as a whole, and
    every step before replaces what an earlier try wrote; relations keep their ids and statuses.
    """
    spark = uploads.sparkSession
    enable_icu(spark)  # a stream has a session of its own
    versions = _table(spark, f"{archive}/versions", VERSION_COLUMNS)
    told = "document_id" in uploads.columns
    fresh = ingest.new_documents(uploads.where("document_id is null") if told else uploads, versions, now)[0]
    if told:
        fresh = fresh.unionByName(ingest.new_versions(uploads.where("document_id is not null"), versions, now))
    fresh = materialise(fresh, "fresh")
    if fresh.isEmpty():
        return
    wanted = uploads.join(fresh.select(F.col("original_sha256").alias("sha256")), "sha256", "left_semi").dropDuplicates(["sha256"])
    done = files.convert(wanted)
    done = materialise(done.withColumn("q", quality(F.col("page_texts"))), "converted")
    if fallback is not None:
        low = needs_fallback(F.col("q.confidence")) & F.coalesce(F.col("engine") == "local:pdf", F.lit(False))
        done = materialise(done.where(~low).unionByName(fallback(done.where(low))), "converted")
    v = fresh.join(done.select(F.col("sha256").alias("original_sha256"), "markdown", F.col("engine").alias("conversion_engine"), F.col("q.confidence").alias("conversion_confidence"), needs_fallback(F.col("q.confidence")).alias("needs_fallback"), "error"), "original_sha256", "left")
    v = v.withColumns({"content_hash": F.sha2("markdown", 256), "simhash": simhash48(shingles(words(F.col("markdown"))))})
    v = materialise(v.select(*(c.split()[0] for c in VERSION_COLUMNS.split(", "))), "versions")
    batch = f"{v.agg(F.bit_xor(F.xxhash64('version_id'))).first()[0] & (1 << 64) - 1:016x}"
    pieces = chunk.chunk_markdown(v, "version_id", "markdown").withColumnRenamed("key", "version_id")
    pieces = materialise(pieces.join(v.select("version_id", "document_id", "title"), "version_id").withColumn("chunk_id", F.xxhash64("version_id", "ordinal")), "chunks")
    ingest.replace_partition(pieces, f"{archive}/chunks", "version_id")
    if embedder is not None:
        ingest.replace_partition(vector.backfill(pieces, embedder), f"{archive}/embeddings", "chunk_id")
    files.write_mirror(v, f"{archive}/markdown/batch={batch}")
    publish(materialise(dedupe.upsert_relations(relations(spark, archive), _found_relations(versions, v), now), "relations"), f"{archive}/relations")
    docs = documents(spark, archive)
    first = v.where("version_no = 1").join(docs.select("document_id"), "document_id", "left_anti").select("document_id", "title", F.lit("other").alias("doc_type"), F.lit("active").alias("status"), F.lit("upload").alias("connector"), "created_at", F.col("created_at").alias("updated_at"))
    publish(materialise(evolve(ingest.with_current(docs.unionByName(evolve(first, "managed_documents")), v, now), "managed_documents"), "documents"), f"{archive}/documents")
    v.write.mode("overwrite").parquet(f"{archive}/versions/batch={batch}")


def watch(spark: SparkSession, landing: str, archive: str, checkpoint: str, now: Callable[[], int], embedder: EmbeddingProvider | None = None, continuous: bool = False) -> StreamingQuery:
    """Ingest what arrives in a folder; by default what is there now, then stop."""

    def batch(df: DataFrame, _: int) -> None:
        ingest_batch(ingest.check_uploads(materialise(df.select("path", "content"), "landing")), archive, now(), embedder)

    ddl = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(ddl).load(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (s.trigger(processingTime="5 seconds") if continuous else s.trigger(availableNow=True)).start()
