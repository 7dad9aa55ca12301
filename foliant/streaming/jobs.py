"""A job queue as a stream of files: claim, run, retry, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

MAX_ATTEMPTS = 3
STATUSES = ("queued", "running", "succeeded", "failed")
JOB = "id string, kind string, payload string, status string, attempts int, error string, created_at long"


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append jobs to the queue folder."""
    jobs.select("id", "kind", "payload", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), "created_at").write.mode("append").parquet(path)


def run_jobs(spark: SparkSession, queue: str, results: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], continuous: bool = False) -> StreamingQuery:
    """Process the queue in micro-batches. A handler takes the jobs of its kind and returns (id, error), error null for success.

    Jobs are tried up to MAX_ATTEMPTS times within their batch, then failed; an unknown kind fails at once. The checkpoint makes every job
    run once even when the driver restarts, since results are written by batch number.
    """

    def batch(jobs: DataFrame, number: int) -> None:
        from foliant.runtime import materialise

        todo = materialise(jobs.where("status = 'queued'").dropDuplicates(["id"]), "jobs")
        # claimed: whoever reads the results meanwhile sees the jobs running; the outcome replaces this
        todo.select("id", "kind", F.lit("running").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error")).write.mode("overwrite").parquet(f"{results}/batch={number}")
        done = [todo.where(~F.col("kind").isin(*handlers)).select("id", "kind", F.lit("failed").alias("status"), F.lit(1).alias("attempts"), F.concat(F.lit("unknown kind: "), "kind").alias("error"))]
        for kind, handler in handlers.items():
            open_jobs = todo.where(F.col("kind") == kind)
            for attempt in range(1, MAX_ATTEMPTS + 1):
                try:
                    got = materialise(open_jobs.join(handler(open_jobs).select("id", F.col("error").alias("why")), "id", "left"), "handled")
                except Exception as e:  # noqa: BLE001 - the batch goes on with the other kinds
                    got = materialise(open_jobs.withColumn("why", F.lit(str(e)[:200])), "handled")
                last = attempt == MAX_ATTEMPTS
                over = got if last else got.where("why is null")
                done.append(over.select("id", "kind", F.when(F.col("why").isNull(), "succeeded").otherwise("failed").alias("status"), F.lit(attempt).alias("attempts"), F.col("why").alias("error")))
                open_jobs = got.where("why is not null").drop("why")
                if last or open_jobs.isEmpty():
                    break
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        out.write.mode("overwrite").parquet(f"{results}/batch={number}")

    s = spark.readStream.schema(JOB).parquet(queue).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (s.trigger(processingTime="1 second") if continuous else s.trigger(availableNow=True)).start()


def counts(jobs: DataFrame, statuses: tuple[str, ...] = STATUSES, column: str = "status") -> DataFrame:
    """One row with the number of jobs of each status, 0 where there is none; other statuses aren't counted."""
    return jobs.groupBy().agg(*(F.count(F.when(F.col(column) == s, 1)).alias(s) for s in statuses))


def any_recent(jobs: DataFrame, kind: str, statuses: tuple[str, ...] = ("queued", "running"), among: int = 20) -> bool:
    """Whether one of the latest `among` jobs is of a kind and in one of the statuses."""
    latest = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(among)
    return bool(latest.agg(F.max((F.col("kind") == kind) & F.col("status").isin(*statuses))).first()[0])


def stream_counts(spark: SparkSession, folder: str, name: str, checkpoint: str, view: str, column: str = "event_type") -> DataFrame:
    """Counts by a column of a table of event files, taken as a stream until all that is there is read. The table is a folder or one file."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(schema)
    events = files.parquet(f"{folder}/{name}") if is_folder else files.option("pathGlobFilter", name).parquet(folder)
    q = events.groupBy(column).agg(F.count("*").alias("n")).writeStream.format("memory").queryName(view).outputMode("complete")
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(view)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and tumbling window of a stream or table; a stream drops events later than the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")
