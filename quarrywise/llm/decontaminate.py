"""Benchmark decontamination: hash windows of test items, scan texts, verify, mark or remove.

Items become windows of ``width`` words (an item with fewer, but not none, is one window).
A benchmark of at most MOST_BYTES goes to the executors as one broadcast hash set, and texts are scanned
in one narrow pass.  Of a larger one only a bit filter is broadcast, of at most MOST_BITS bits: text windows that pass it
meet the items' windows in a shuffle join, texts are written once with a row number, and what is found joins them
by it.  A window's hash only proposes a hit; the words themselves decide, either way.

Nulls: a null text has no words; a null item text none; a null item_id is named ``""``.
Empty tables give no rows (documents) or no hits (benchmark).  Repeated rows are kept and judged alike; a window
that many items have, or one item often, is one window.  Very long texts are scanned whole.  Extra columns are
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._words import ALNUM, U, Words, split, windows

WIDTH = 13
#: A document is contaminated if at least one of its words in so many is hit.
ONE_IN = 20
#: Bytes of the largest benchmark that is broadcast: about five times that in a worker.
MOST_BYTES = 8 << 20
#: The filter has a bit for every sixteenth of a window at least, up to so many.
MOST_BITS = 27
FOUND = "struct<n_words:bigint,n_hit:bigint,hits:array<bigint>,chars:array<bigint>,items:array<string>>"


def _bits(windows_: int, most: int) -> int:
    return min(most, max(16, (16 * windows_).bit_length()))


def _item_windows(text: str, width: int) -> tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(k, values, words, start, end): an item's windows of k words; words has them joined by blanks, [start, end) each window's."""
    words = text.encode().translate(ALNUM.table).split()
    k = min(width, len(words))
    if not k:
        return 0, np.zeros(0, np.uint64), b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = b" ".join(words)
    found, _ = split(pa.array([joined.decode()]), ALNUM)
    values, at = windows(found.value, found.first, k)
    return k, values, joined, found.start[at], found.end[at + k - 1]


class Windows:
    """The windows of some items by length: sorted hash values, a bit filter sized to them, the words and item of each."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        found: dict[int, list[tuple]] = {}
        self.names, self.text, at = [], [], 0
        for name, text in items:
            k, values, joined, start, end = _item_windows(text, width)
            if k:
                found.setdefault(k, []).append((values, start + at, end + at, np.full(len(values), len(self.names))))
                self.names.append(name)
                self.text.append(joined)
                at += len(joined)
        self.text = b"".join(self.text)
        self.tables = {}
        for k, parts in found.items():
            value, start, end, item = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((item, value))
            value, start, end, item = value[order], start[order], end[order], item[order]
            bits = np.zeros(1 << _bits(len(value), MOST_BITS), bool)
            bits[(value & U(len(bits) - 1)).astype(np.int64)] = True
            self.tables[k] = value, start, end, item, bits

    def scan(self, words: Words) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Word ranges that are hit, and the items found, for each row."""
        n = len(words.first) - 1
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        for k, (value, start, end, item, bits) in self.tables.items():
            values, at = windows(words.value, words.first, k)
            maybe = np.flatnonzero(bits[(values & U(len(bits) - 1)).astype(np.int64)])
            low, high = np.searchsorted(value, values[maybe], "left"), np.searchsorted(value, values[maybe], "right")
            real = np.flatnonzero(high > low)
            rows = np.searchsorted(words.first, at[maybe[real]], side="right") - 1
            known: dict[int, dict[bytes, set[str]]] = {}  # the items of each value's words
            for i, a, b, row in zip(at[maybe[real]].tolist(), low[real].tolist(), high[real].tolist(), rows.tolist()):
                if a not in known:
                    known[a] = {}
                    for j in range(a, b):
                        known[a].setdefault(self.text[start[j] : end[j]], set()).add(self.names[item[j]])
                named = known[a].get(words.joined(i, i + k, ALNUM))
                if named:
                    ranges[row].append((i - int(words.first[row]), i + k - int(words.first[row])))
                    items[row] |= named
        return ranges, items


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), C.text_or_empty().alias("text"))


def scan(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_bytes: int = MOST_BYTES, into: str = "found") -> DataFrame:
    """documents with a struct column: words, hit words, hit ranges by word and by byte (first and end in turn), item names."""
    spark = documents.sparkSession
    C.small_batches(spark)
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    df = documents.withColumn(into, F.lit(None).cast(FOUND))
    if size <= most_bytes:
        shared = spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in items.collect()], width))
        return df.mapInArrow(C.trimmed(_scanner(shared, into)), df.schema)
    row, hits = C.fresh(df, "__row"), C.fresh(df, "__hits")
    rows = C.materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = _joined(rows.select(F.col(row).alias("row"), C.text_or_empty().alias("text")), items, width)
    joined = rows.join(found.select(F.col("row").alias(row), F.struct("ranges", "items").alias(hits)), row, "left")
    return joined.drop(row).mapInArrow(C.trimmed(_filled(into, hits)), df.schema)


def _scanner(shared, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = split(batch.column(batch.schema.get_field_index("text")), ALNUM)
            found = [_found(words, r, *x) for r, x in enumerate(zip(*shared.value.scan(words)))]
            yield _with(batch, into, found)

    return run


def _filled(into: str, hits: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = split(batch.column(batch.schema.get_field_index("text")), ALNUM)
            at = batch.schema.get_field_index(hits)
            known = [x or {"ranges": None, "items": None} for x in batch.column(at).to_pylist()]
            found = [_found(words, r, [(x["i"], x["i"] + x["k"]) for x in h["ranges"] or ()], set(h["items"] or ())) for r, h in enumerate(known)]
            yield _with(batch.drop_columns([hits]), into, found)

    return run


def _with(batch: pa.RecordBatch, into: str, found: list[dict]) -> pa.RecordBatch:
    at = batch.schema.get_field_index(into)
    columns = list(batch.columns)
    columns[at] = pa.array(found, type=batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _joined(texts: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(row, ranges, items) of the rows (row, text) that have a hit, by a shuffle join of windows."""
    spark = texts.sparkSession

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, values, joined, start, end = _item_windows(text, width)
                words = pa.array([joined[a:b] for a, b in zip(start, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), words, pa.array([item] * len(values), pa.string())], names=["k", "value", "words", "item"])

    known = C.materialize(items.mapInArrow(made, "k int, value bigint, words binary, item string").distinct(), "windows")
    sizes = {r["k"]: _bits(r["n"], MOST_BITS) for r in known.groupBy("k").agg(F.count("*").alias("n")).collect()}  # width rows at most
    slot = F.shiftright(F.col("slot"), 16).alias("part"), F.col("slot").bitwiseAND(65535).cast("int").alias("bit")
    place = F.lit(0).cast("long")
    for k, b in sizes.items():
        place = F.when(F.col("k") == k, F.col("value").bitwiseAND((1 << b) - 1)).otherwise(place)
    slots = known.select("k", place.alias("slot")).distinct()
    parts = slots.select("k", *slot).groupBy("k", "part").agg(F.collect_list("bit").alias("bits"))
    filters = {k: np.zeros(1 << b, bool) for k, b in sizes.items()}
    for r in parts.toLocalIterator():  # a bit set of at most 1 << MOST_BITS for each length of window
        filters[r["k"]][(r["part"] << 16) + np.array(r["bits"], np.int64)] = True
    shared = spark.sparkContext.broadcast({k: np.packbits(x, bitorder="little") for k, x in filters.items()})

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = split(batch.column(1), ALNUM)
            for k, bits in shared.value.items():
                values, at = windows(words.value, words.first, k)
                place = (values & U(8 * len(bits) - 1)).astype(np.int64)
                maybe = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                at, values = at[maybe], values[maybe]
                row = np.searchsorted(words.first, at, side="right") - 1
                text = pa.array([words.joined(i, i + k, ALNUM) for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((at - words.first[row]).astype(np.int64)), pa.array(np.full(len(at), k, np.int32)), pa.array(values.view(np.int64)), text], names=["row", "i", "k", "value", "words"])

    tried = C.materialize(texts.mapInArrow(C.trimmed(passed), "row bigint, i bigint, k int, value bigint, words binary"), "tried")
    key = ["k", "value", "words"]
    ranges = tried.join(known.select(*key).distinct(), key).groupBy("row").agg(F.collect_list(F.struct("i", "k")).alias("ranges"))
    named = tried.select("row", *key).distinct().join(known, key).groupBy("row").agg(F.collect_set("item").alias("items"))
    return ranges.join(named, "row")


def _found(words: Words, r: int, ranges: list[tuple[int, int]], items: set[str]) -> dict:
    """What a row's ranges, counted from its first word, come to."""
    a, b = int(words.first[r]), int(words.first[r + 1])
    if not ranges:
        return {"n_words": b - a, "n_hit": 0, "hits": [], "chars": [], "items": []}
    step = np.zeros(b - a + 1, np.int64)
    np.add.at(step, [s for s, _ in ranges], 1)
    np.add.at(step, [e for _, e in ranges], -1)
    mark = np.concatenate(([0], np.cumsum(step) > 0)).astype(np.int8)
    edge = np.flatnonzero(np.diff(mark))
    base = int(words.offsets[r])
    chars = np.stack([words.start[a + edge[::2]], words.end[a + edge[1::2] - 1]], 1).ravel() - base
    return {"n_words": b - a, "n_hit": int(mark.sum()), "hits": edge.tolist(), "chars": chars.tolist(), "items": sorted(items)}


def judge(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, one_in: int = ONE_IN, most_bytes: int = MOST_BYTES, keep_ranges: str | None = None) -> DataFrame:
    """documents with n_words, n_hit, n_items, items_sha256 and contaminated; columns of these names are replaced.

    keep_ranges names a further column for the hit byte ranges.
    """
    into = C.fresh(documents, "__found")
    df = scan(documents, benchmark, width, most_bytes, into)
    df = df.withColumns(
        {
            "n_words": F.col(f"{into}.n_words"),
            "n_hit": F.col(f"{into}.n_hit"),
            "n_items": F.size(f"{into}.items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", F.col(f"{into}.items")), 256),
            "contaminated": (F.col(f"{into}.n_hit") > 0) & (F.col(f"{into}.n_hit") * one_in >= F.col(f"{into}.n_words")),
        }
        | ({keep_ranges: F.col(f"{into}.chars")} if keep_ranges else {})
    )
    return df.drop(into)


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """documents without contaminated rows, or (remove="spans") with every hit passage cut out of its text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = {c: C.fresh(documents, f"__{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    own = [c for c in documents.columns if c.lower() in names]
    df = documents.withColumnsRenamed({c: names[c.lower()] for c in own})
    spans = C.fresh(documents, "__spans")
    judged = judge(df, benchmark, keep_ranges=spans, **options)
    if remove == "documents":
        judged = judged.filter(~F.col("contaminated"))
    else:
        cut = F.pandas_udf(_cut, "string")
        judged = judged.withColumn("text", F.when(F.col("n_hit") > 0, cut("text", spans)).otherwise(F.col("text")))
    return judged.select(*[F.col(names[c.lower()]).alias(c) if c in own else C.quoted([c])[0] for c in documents.columns])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, span in zip(texts, spans):
        raw, at, kept = (text or "").encode(), 0, []
        for s, e in zip(span[::2], span[1::2]):
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        out.append(b"".join(kept).decode(errors="ignore"))
    return pd.Series(out, dtype=object)


def digest(names: list[str]) -> str:
    """The items_sha256 of some item names."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
