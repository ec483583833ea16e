"""Shared folder handling: where intermediate tables are written so that lost executors do no harm."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}
#: What a scan opens at once at least; smaller inputs don't reach all cores by themselves.
_LEAST_SPLIT = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it isn't set, a temporary one where all runs on one machine (local, local-cluster); elsewhere an error, as executors don't share local disks."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        app = spark.sparkContext.applicationId
        there = _own.get(app)
        if there is None:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            there = _own[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return its scan; removed by :func:`clear`, or when the JVM ends.

    ``by``: a column of few values, each of which gets files of its own, so that a reader of one value reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    there, fs = _place(spark, path)
    fs.deleteOnExit(there)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def _place(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> int:
    """Delete the tables that :func:`written` has made in this application; DataFrames that read them can't be run any more. Returns their number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        there, fs = _place(spark, path)
        fs.delete(there, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs much more than its input's bytes suggest. Runs no job: the size of what the plan reads decides."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df if size >= _LEAST_SPLIT * cores else df.repartition(2 * cores)
