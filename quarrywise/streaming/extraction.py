"""Documents of files as they arrive: the batch extractor behind a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrywise.sources import files


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of index documents, one for each new file of a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return files.documents(stream.select("path", "content"))


def append_to(stream: DataFrame, table_dir: str, checkpoint_dir: str):
    """Append a stream of documents to a table; with the same checkpoint each file is added once."""
    return stream.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
