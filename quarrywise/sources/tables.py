"""Reading and writing tables; cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer parts than there are: a small table whose file cannot be split further."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where that is unset, a session whose executors are in this process gets a temporary one; any other is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="quarrywise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df once and read it again, so nothing above is computed twice and lost executors cost little.

    The shuffle files that took go at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quarrywise-index/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Remove a table that materialize() gave and that nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, a write's shuffle files are removed when it is done, not only when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        pass


def remove_others(spark: SparkSession, folder: str, prefix: str, kept: str) -> None:
    """Remove the folders in ``folder`` whose names begin with prefix, but for one."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(top):
        name = status.getPath().getName()
        if name.startswith(prefix) and name != kept:
            store.delete(status.getPath(), True)
