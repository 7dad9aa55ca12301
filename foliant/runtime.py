"""Session-level helpers: table access, shared storage, read parallelism."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MOVES_ROWS = re.compile(r"(?m)^[\s+:-]*(Join|Aggregate|Window|Sort|Distinct|Deduplicate|Repartition\w*|RebalancePartitions)\b")


def spread(df: DataFrame) -> DataFrame:
    """Use all task slots for a scan that has fewer splits than there are slots.

    A cluster-sized input has more splits than slots and passes through unchanged, without a shuffle; so does a plan that
    shuffles anyway, since asking for its partitions would run it.
    """
    if _MOVES_ROWS.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where the session names none, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. The copy outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._foliant_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    path = getattr(df, "_foliant_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete all stages that this process has materialised, when no result that reads them is needed any more; how many there were."""
    jvm, n = spark._jvm, len(_WRITTEN)
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n
