"""A directory of files as a DataFrame, and its documents by extraction in the tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywise.functions import split as S
from quarrywise.functions import text as T

from .extract import Extracted, extract

# Folders and suffixes that are never part of a corpus.
SKIPPED = ("__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules", "dist", "build")
SKIPPED_SUFFIXES = (".pyc", ".pyo")


def wanted(relative: str) -> bool:
    parts = relative.split("/")
    return not any(p.startswith(".") or p in SKIPPED for p in parts) and not relative.endswith(SKIPPED_SUFFIXES)


def scan(spark: SparkSession, folder: str, leave_out: str | None = None) -> DataFrame:
    """(path, content) of a corpus's files, by relative path.

    Paths are listed through Hadoop, so names beginning with an underscore are found and any store works;
    the driver holds paths alone, bytes are read in the tasks.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = store.makeQualified(root).toString().rstrip("/")
    out = store.makeQualified(jvm.org.apache.hadoop.fs.Path(leave_out)).toString().rstrip("/") if leave_out else None
    found, empty, files = [], [], store.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        path = status.getPath().toString()
        if wanted(path[len(base) + 1 :]) and not (out and path.startswith(out + "/")):
            (found if status.getLen() else empty).append(path)
    schema = "path string, content binary"
    plain = [p for p in found if not p.rsplit("/", 1)[-1].startswith("_")]
    hidden = [p for p in found if p.rsplit("/", 1)[-1].startswith("_")]
    parts = [spark.read.format("binaryFile").load(group).select("path", "content") for group in ([plain] if plain else [])]
    if empty or not found:  # Spark's reader leaves out empty files
        parts.append(spark.createDataFrame([(p, b"") for p in empty], schema))
    if hidden:  # and names with an underscore
        parts.append(spark.createDataFrame([(p,) for p in hidden], "path string").mapInPandas(_read, schema))
    df = reduce(DataFrame.unionByName, parts)
    normal = F.regexp_replace("path", "^file:/+", "/")
    return df.select(F.substring(normal, len(base.replace("file://", "").replace("file:", "")) + 2, 1 << 20).alias("path"), "content")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        content = []
        for path in pdf["path"]:
            store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            with store.open_input_stream(place) as f:
                content.append(f.read())
        yield pdf.assign(content=content)


DOCUMENT = "path string, size_bytes bigint, sha256 string, doc_type string, canonical_text string, topic_text string, ranges array<struct<start:bigint,end:bigint>>, extraction_method string, warnings array<string>, metadata map<string,string>, ocr_confidence double"


def documents(files: DataFrame, parsers: dict[str, Callable[[bytes], Extracted]] | None = None) -> DataFrame:
    """A document for each file (path, content): canonical text, page ranges and how it was read.

    A null content is an empty file; a file that cannot be read is a document without text and with a warning.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                raw = bytes(raw or b"")
                got = extract(path, raw, parsers)
                text, ranges = S.canonical(got.pages)
                topic = S.canonical(got.topic_pages)[0] if got.topic_pages is not None else text
                rows.append((path, len(raw), hashlib.sha256(raw).hexdigest(), got.doc_type, text, topic, [{"start": a, "end": b} for a, b in ranges], got.method, got.warnings, {k: str(v) for k, v in got.metadata.items()}, got.ocr_confidence))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.replace("struct<start:bigint,end:bigint>", "x").replace("map<string,string>", "m").split(", ")])

    df = files.select("path", "content").mapInPandas(run, DOCUMENT)
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split("path", "/")
    return df.select(
        T.stable_id("D", 12, F.col("path"), F.col("sha256")).alias("doc_id"),
        F.col("path").alias("source_uri"),
        F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("default").alias("source_batch"),
        name.alias("original_filename"),
        T.title(F.col("canonical_text"), F.regexp_replace(name, r"\.[^.]+$", "")).alias("title"),
        "doc_type",
        F.lit("unknown").alias("language"),
        "size_bytes",
        "sha256",
        "canonical_text",
        "topic_text",
        "ranges",
        "extraction_method",
        "warnings",
        "metadata",
        "ocr_confidence",
        (F.trim("canonical_text") != "").alias("text_available"),
    )
