"""Helpers shared by the operators: input columns, sizes, tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Most bytes that a lookup table may have to be broadcast; beyond, a shuffle join is used.
BROADCAST_BYTES = 32 << 20
_written: list[str] = []


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("an active SparkSession is needed")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where none is named, a session whose executors are in this process gets a temporary one; any other is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="quarrywise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there.

    Lost executors cost nothing that was finished.  The table goes by free(), or when the driver exits; the shuffle files it took go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrywise/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(free, spark, 0)
    _written.append(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


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


def mark() -> int:
    """The number of tables written so far, for free()."""
    return len(_written)


def free(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Remove the tables written after mark() gave ``since``, but for the last ``keep``: nothing may need them any more."""
    for i in range(since, len(_written) - keep):
        if _written[i]:
            _remove(spark, _written[i])
            _written[i] = ""


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the shared folder's owner clears it
        pass


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """So many partitions that each gets about per_partition rows."""
    return max(least, -(-int(rows) // per_partition))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a worker's memory stays bounded with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run):
    """run, for mapInArrow; once it ends, its worker gives freed memory back to the system.

    Workers stay for the next stages, and what each keeps counts beside what the next one needs.
    """

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def give_back(spark: SparkSession) -> bool:
    """The driver's JVM gives the memory that its C library has freed and kept back to the system; whether it could.

    Its compilers and codecs free hundreds of MB in the course of many steps, which count beside its heap until then.
    """
    try:
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        (call,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)  # the bean, the command, no arguments, no types
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)
        return True
    except Exception:  # other JVMs have no such command
        return False


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values are of at most limit bytes, counted over all its rows, else as it is."""
    size = F.lit(0)
    for f in df.schema.fields:
        column = quoted([f.name])[0]
        size += 16 + (F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) if not isinstance(f.dataType, (T.NumericType, T.BooleanType)) else 0)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def with_types(df: DataFrame, **kinds: str) -> T.StructType:
    """Schema of df with columns added or retyped."""
    fields = {f.name: f for f in df.schema.fields}
    for name, kind in kinds.items():
        fields[name] = T.StructField(name, T._parse_datatype_string(kind), True)
    return T.StructType(list(fields.values()))
