"""Byte-balanced range sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (MD5 of the text, doc_id, a tie number fixed when the keys are first
written), so copies of a text lie together and no two keys are equal.  A size-weighted
sample of keys gives quantile boundaries for many more ranges than shards; a range that holds
over twice its share is subdivided by a new sample of its own rows.  With the bytes and rows of
every range known, whole ranges fall to shards; in a range that a shard boundary cuts, a row's place in the global
order of bytes decides: shard k takes the rows whose middle byte lies in the k-th of equal parts.  Two shards'
bytes differ by no more than two documents.  Texts are read once; all later steps use keys of fixed width.

Law ``bytes``.  A null text has size 1 and the checksum of no bytes; a very long one is placed whole.  Copies of a text
are neighbours, so only those are parted that a shard boundary falls among.  Repeated rows are placed each.  An empty
table gives no rows.  A null doc_id sorts first.  Only doc_id and text are read, so others may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

SHARDS = 8
#: Rows of one range, up to MOST_RANGES ranges; beyond 33 million rows ranges grow, to 610,000 rows (60 MB) of ten billion.
RANGE_ROWS = 2000
MOST_RANGES = 1 << 14
#: Sampled keys for each range: the driver holds SAMPLE * MOST_RANGES keys at most.
SAMPLE = 24
#: Rounds of subdividing, each with twice the sample of the one before, after which it is an error that ranges are overfull.
MOST_ROUNDS = 24


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the order key of each row."""
    text = C.text_or_empty()
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.concat_ws("-", F.md5(text.cast("binary")), F.lpad(doc, 20, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def _literal(values: list, kind: str) -> Column:
    """A constant array, folded once, without an expression for each element."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds lie below the key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(_literal(bounds[step - 1 :: step], "string"), lambda b: b < key))
    fine = F.slice(_literal(bounds, "string"), coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(fine, lambda b: b < key))


def _quantiles(sample: list, parts: int) -> list[str]:
    """Keys that cut a weighted sample, sorted by key, into parts."""
    total, run, out = sum(r["weight"] for r in sample), 0.0, []
    for r in sample:
        run += r["weight"]
        if len(out) < parts - 1 and run >= total * (len(out) + 1) / parts:
            out.append(r["key"])
    return sorted(set(out))


def _draw(rows: DataFrame, rate: Column) -> list:
    """Rows drawn with odds rate * size, each weighted by the inverse of its odds."""
    odds = F.least(F.col("size") * rate, F.lit(1.0))
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(chance < odds).select("key", (F.col("size") / odds).alias("weight")).orderBy("key").collect()


def _ranges(rows: DataFrame, total: int, count: int, range_rows: int) -> tuple[list[str], list[int], list[int]]:
    """Bounds of ranges, and each range's bytes and rows.  None holds over twice its share besides its largest row."""
    ranges = max(1, min(MOST_RANGES, -(-count // range_rows)))
    share = total / ranges
    bounds = _quantiles(_draw(rows, F.lit(SAMPLE / share)), ranges)
    for turn in range(MOST_ROUNDS):
        found = {r["range"]: r for r in rows.groupBy(_range_of(F.col("key"), bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).collect()}
        size, n, most = ([found[i][k] if i in found else 0 for i in range(len(bounds) + 1)] for k in ("bytes", "rows", "most"))
        over = {i for i in range(len(size)) if size[i] - most[i] > 2 * share}
        if not over:
            return bounds, size, n
        rate = F.get(_literal([SAMPLE * 2**turn / share if i in over else 0.0 for i in range(len(size))], "double"), _range_of(F.col("key"), bounds))
        drawn: dict[int, list] = {}
        for r in _draw(rows, rate):
            drawn.setdefault(bisect_left(bounds, r["key"]), []).append(r)
        bounds = sorted({*bounds, *(b for i, sample in drawn.items() for b in _quantiles(sample, int(size[i] // share) + 1))})
    raise RuntimeError(f"{len(over)} ranges stayed overfull")


def shard(documents: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot of each row."""
    rows = C.materialize(keyed(documents), "keys")
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not whole["n"]:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    total = whole["bytes"]
    bounds, size, n = _ranges(rows, total, whole["n"], range_rows)
    ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))
    order = Window.partitionBy("range").orderBy("key")
    up_to = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.get(_literal(list(_running(size)), "bigint"), F.col("range"))
    place = (F.row_number().over(order) - 1).cast("long") + F.get(_literal(list(_running(n)), "bigint"), F.col("range"))
    placed = ranged.withColumns({"__end": up_to, "__place": place})
    middle = F.col("__end") - F.expr("size div 2") - 1
    placed = placed.withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("__place").alias("first")).collect()}
    slot = F.col("__place") - F.get(_literal([first.get(i, 0) for i in range(shards)], "bigint"), F.col("shard"))
    return placed.withColumn("slot", slot).drop("range", "__end", "__place")


def _running(values: list[int]):
    total = 0
    for v in values:
        yield total
        total += v


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write documents and their slots as Parquet folders shard=0, shard=1, ...

    Where documents have a column shard or slot, in any case, the new one's name ends in an underscore.
    """
    key, folder, slot = (C.fresh(documents, x) for x in ("__row", "shard", "slot"))
    kept = C.materialize(documents.withColumn(key, F.monotonically_increasing_id()), "rows")
    placed = shard(kept.select(F.col(key).alias("doc_id"), "text"), shards).select(F.col("doc_id").alias(key), F.col("shard").alias(folder), F.col("slot").alias(slot))
    spread = C.partitions_for(kept.count(), 50_000)
    whole = kept.join(placed, key).drop(key).repartition(spread, folder, F.expr(f"`{slot}` div {50_000}"))
    whole.sortWithinPartitions(folder, slot).write.partitionBy(folder).parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(C.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
