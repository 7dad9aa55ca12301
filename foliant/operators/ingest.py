"""Batches of uploads to documents and versions, without touching what is already there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foliant.functions.text import accepted, extension, mime_type, title_from_filename


def check_uploads(files: DataFrame) -> DataFrame:
    """Uploads (path, content, ...) with filename, sha256, mime, bytes, error; error is null for accepted ones, so one bad file spoils no other."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"filename": name, "sha256": F.sha2(F.col("content").cast("binary"), 256), "mime": mime_type(name), "bytes": F.octet_length("content").cast("long")}).withColumn(
        "error", F.when(~F.coalesce(accepted(name), F.lit(False)), F.concat(F.lit("unsupported: "), F.coalesce(extension(name), F.lit("")))).when(F.col("bytes").isNull(), F.lit("empty"))
    )


def new_documents(uploads: DataFrame, versions: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(accepted new documents as first versions, duplicates with the version that already holds their bytes).

    An upload whose SHA-256 any version has, archived ones included, is a duplicate; of several equal uploads in one batch the one
    with the smallest path is new and the others are duplicates of it. Keys are derived from the content, so a repeated batch changes nothing.
    """
    ok = uploads.where("error is null")
    known = versions.where("original_sha256 is not null").groupBy(F.col("original_sha256").alias("sha256")).agg(F.min(F.struct("version_id", "document_id")).alias("have"))
    # keys alone are grouped, not the files' bytes: the smallest path of a hash is the new one
    first = ok.groupBy("sha256").agg(F.min("path").alias("first_path"))
    x = ok.select("path", "sha256", "filename", "mime", "bytes").join(first, "sha256").join(known, "sha256", "left").withColumn("n", F.when(F.col("path") == F.col("first_path"), 1).otherwise(2))
    did, vid = F.substring(F.sha2(F.concat(F.lit("d"), F.col("sha256")), 256), 1, 26), F.substring(F.sha2(F.concat(F.lit("v1"), F.col("sha256")), 256), 1, 26)
    fresh = x.where("have is null and n = 1").select(
        vid.alias("version_id"), did.alias("document_id"), F.lit(1).alias("version_no"), F.col("sha256").alias("original_sha256"), F.col("filename").alias("original_filename"), F.col("mime").alias("original_mime"), F.col("bytes").alias("original_bytes"), title_from_filename(F.col("filename")).alias("title"), F.lit(now).alias("created_at")
    )
    old = x.where("have is not null or n > 1").select("path", "sha256", F.coalesce("have.version_id", vid).alias("version_id"), F.coalesce("have.document_id", did).alias("document_id"))
    return fresh, old


def new_versions(uploads: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """Next versions of existing documents: uploads (document_id, path, sha256, ...) numbered behind the highest version of their document.

    Unknown documents and bytes that the document already holds are left out. Several uploads of one document are numbered by path.
    """
    ok = uploads.where("error is null").dropDuplicates(["document_id", "sha256"])
    same = versions.select("document_id", F.col("original_sha256").alias("sha256")).distinct()
    top = versions.groupBy("document_id").agg(F.coalesce(F.max("version_no"), F.lit(0)).alias("top"))
    x = ok.join(same, ["document_id", "sha256"], "left_anti").join(top, "document_id")
    no = (F.col("top") + F.row_number().over(Window.partitionBy("document_id").orderBy("path"))).cast("int")
    return x.withColumn("version_no", no).select(F.substring(F.sha2(F.concat_ws("|", "document_id", "sha256"), 256), 1, 26).alias("version_id"), "document_id", "version_no", F.col("sha256").alias("original_sha256"), F.col("filename").alias("original_filename"), F.col("mime").alias("original_mime"), F.col("bytes").alias("original_bytes"), title_from_filename(F.col("filename")).alias("title"), F.lit(now).alias("created_at"))


def with_current(documents: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """Documents pointing at their newest added version; those are active again."""
    newest = versions.groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("newest"))
    x = documents.join(newest, "document_id", "left")
    moved = F.col("newest").isNotNull()
    return x.withColumns({"current_version_id": F.coalesce("newest", "current_version_id"), "status": F.when(moved, "active").otherwise(F.col("status")), "updated_at": F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))}).drop("newest")


def replace_partition(df: DataFrame, path: str, by: str, buckets: int = 64) -> None:
    """Write rows so that those of the keys present in `by` replace the ones stored for them and nothing else changes.

    Partitions are hash buckets of the key, so that a table with many keys has few directories; a touched bucket is
    rewritten from what it held for other keys and the new rows. The number of buckets belongs to the table; larger ones want more.
    """
    spark: SparkSession = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        keep = old.join(new.select(by).distinct(), by, "left_anti").select(*new.columns)
        new = keep.unionByName(new)
        from foliant.runtime import materialise

        new = materialise(new, "replace")
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_people(people: DataFrame, names: DataFrame, name: str = "display_name") -> DataFrame:
    """People with those names added that nobody has yet; names are trimmed, blank ones left out."""
    n = names.select(F.trim(name).alias("display_name")).where("display_name <> ''").distinct().join(people.select("display_name"), "display_name", "left_anti")
    more = n.select(F.concat(F.lit("P"), F.substring(F.sha2("display_name", 256), 1, 12)).alias("person_id"), "display_name", F.lit(None).cast("string").alias("department"))
    return people.unionByName(more)


def latest_state(events: DataFrame, actions: list[str]) -> DataFrame:
    """(document_id, last_<action> ...): the time of the latest event of each action."""
    return events.groupBy("document_id").agg(*(F.max(F.when(F.col("action") == a, F.col("at"))).alias(f"last_{a}") for a in actions))


def set_status(table: DataFrame, key: str, ids: list[str], status: str, allowed: tuple[str, ...]) -> DataFrame:
    """The table with another status for some keys; raises for a status that isn't allowed."""
    if status not in allowed:
        raise ValueError(f"status {status!r} is none of {allowed}")
    return table.withColumn("status", F.when(F.col(key).isin(ids), F.lit(status)).otherwise(F.col("status")))
