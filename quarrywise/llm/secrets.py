"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Everything on the main path is a DataFrame function.  Spans are [start, end) in code points.

Base kinds, leftmost and not overlapping within a kind:
``assign`` (a keyword, a sign, a value of 6 characters or more), ``access`` (AKIA and at least 16
more), ``hex`` (24 or more of 0-9a-f).

Method: two first-order character models, of random strings and of ordinary identifiers, learned
from labelled samples (columns ``sample`` string, ``random`` boolean).  A run of 16 or more characters
that could be a key, also right after ``=``, is a span of kind ``markov`` if its mean log-likelihood ratio and its whole
ratio exceed two limits and it touches no base span.  The query's samples are bounded: SAMPLES
random strings made by hashing numbers, and the words, outside of assignments, of about SAMPLE_DOCS different
texts, taken by their hash; all documents are scanned.

Arrays of spans are built and searched in blocks of BLOCK, so a very long text with very many spans costs little
more than its length.  Nulls are empty texts: no spans, and the hash of nothing.  Repeated rows are scanned each.
Empty tables give no rows.  Columns named as the outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run may start after a sign ("name=value"); "=" is its padding only where the run ends with it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
#: Limits of the mean and of the whole log-likelihood ratio (natural logarithms).
LEAST_MEAN = 0.25
LEAST_TOTAL = 6.0
#: Characters that candidates are made of, and how many pairs a character's own odds count as.
ALPHABET = 66
BACKOFF = 8.0
SAMPLES = 4000
SAMPLE_DOCS = 2000
#: Spans handled together: about the root of the number of spans of a long text.
BLOCK = 128
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _blocks(items: Column) -> Column:
    """items in arrays of BLOCK; none of an empty array."""
    of = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, of).otherwise(F.slice(F.array(items), 1, 0))


def _running(values: Column, begin: int, step) -> Column:
    """What step makes of all earlier values, for each; of a short array."""
    return F.aggregate(values, F.array(F.lit(begin).cast("long")), lambda done, v: F.array_append(done, step(F.element_at(done, -1), v)))


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None, keep_text: bool = False) -> Column:
    """Spans of all matches, with the text of each if asked for, from the texts between them (split) and of them (extract)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda v: F.length(v) >= LEAST_VALUE) if value_group else F.transform(found, lambda v: F.lit(True))
    parts = F.zip_with(F.zip_with(found, F.split(text, pattern, -1), lambda m, b: F.struct(m.alias("run"), b.alias("between"))), long_enough, lambda x, ok: F.struct(x["run"].alias("run"), F.length(x["between"]).cast("long").alias("b"), F.length(x["run"]).cast("long").alias("m"), ok.alias("ok")))
    parts = F.filter(parts, lambda x: x["run"].isNotNull())  # a text after the last match has none
    kept = "start:bigint,kind:int,end:bigint" + ",run:string" * keep_text

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["b"]
        end = start + x["m"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *[x["run"].alias("run")] * keep_text).cast(f"struct<{kept}>")
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    empty = F.array().cast(f"array<struct<{kept}>>")
    length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x["b"] + x["m"])

    def placed(blocks: Column) -> Column:
        offsets = _running(F.transform(blocks, length), 0, lambda a, n: a + n)
        return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"]))

    spans = _bound(_blocks_of(parts), placed)
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(empty)


def _bound(value: Column, f) -> Column:
    """f(value), value being computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks_of(items: Column) -> Column:
    return _bound(items, _blocks)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def default_samples(documents: DataFrame, samples: int = SAMPLES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples: hashed numbers in three alphabets, and corpus words of 8 or more characters that no assignment holds."""
    spark = documents.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9+/]", "")
    shape = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.upper(mixed)).otherwise(mixed)
    random = spark.range(samples).select(shape.alias("sample"), F.lit(True).alias("random"))
    every = max(1, documents.count() // sample_docs)
    texts = documents.select(C.text_or_empty().alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))  # copies of one text are one row
    bare = F.regexp_replace("text", F.lit(ASSIGN), F.lit(" "))
    some = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z_][A-Za-z0-9_-]{7,}"), F.lit(0))).alias("sample"))
    words = some.filter(~F.col("sample").rlike(f"^(?:{ACCESS}|{HEX})$")).distinct()
    return random.unionByName(words.select("sample", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs (random over ordinary), 128 by 128.

    Counts are aggregated before they leave the executors: at most 2 * 128 * 128 rows.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("sample") - 1))
    pairs = samples.filter((F.length("sample") > 1) & ~F.col("sample").rlike(r"[^\x00-\x7F]")).select("random", "sample", at.alias("i"))
    code = lambda i: F.ascii(F.substring(F.col("sample"), i, F.lit(1)))
    counts = pairs.groupBy("random", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b")).count()
    table = {True: [[0] * 128 for _ in range(128)], False: [[0] * 128 for _ in range(128)]}
    for r in counts.collect():
        table[r["random"]][r["a"]][r["b"]] = r["count"]
    log = {}
    for k, rows in table.items():  # a pair's odds lean on the second character's own where the first is rare
        whole = sum(map(sum, rows))
        single = [(sum(row[b] for row in rows) + 0.5) / (whole + 0.5 * ALPHABET) for b in range(128)]
        log[k] = [[math.log((n + BACKOFF * p) / (sum(row) + BACKOFF)) for n, p in zip(row, single)] for row in rows]
    return [round(x - y, 4) for p, q in zip(log[True], log[False]) for x, y in zip(p, q)]


def markov_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of candidate runs that look random rather than ordinary."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def score(span: Column) -> Column:  # padding is no part of what the models know
        codes = F.transform(F.split(F.rtrim(span["run"], F.lit("=")), ""), lambda c: F.ascii(c))
        pairs = _bound(codes, lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.get(weights, a * 128 + b)))
        return F.aggregate(pairs, F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))

    def random(span: Column) -> Column:
        return _bound(score(span), lambda total: (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * (span["end"] - span["start"] - 1)))

    runs = F.filter(_spans(text, CANDIDATE, 3, keep_text=True), random)
    return F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _apart(spans: Column, others: Column) -> Column:
    """Those of spans that no other one overlaps; others begin and end in order."""

    def free(own: Column, blocks: Column) -> Column:
        heads = F.transform(blocks, lambda b: F.element_at(b, 1)["start"])

        def alone(x: Column, heads: Column) -> Column:  # of the others that begin before its end, the last ends last
            block = F.get(blocks, F.size(F.filter(heads, lambda h: h < x["end"])) - 1)
            return F.coalesce(~F.exists(block, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])), F.lit(True))

        return _bound(heads, lambda h: F.filter(own, lambda x: alone(x, h)))

    def apart(own: Column) -> Column:
        return F.when((F.size(others) > 0) & (F.size(own) > 0), _bound(_blocks_of(others), lambda blocks: free(own, blocks))).otherwise(own)

    return _bound(spans, apart)  # named once: a plan holds what spans is made of, the models' table too, as often as it is named


def find(documents: DataFrame, ratios: list[float]) -> DataFrame:
    """documents with columns base and all: arrays of spans (start, kind as a place in KINDS, end)."""
    text = C.text_or_empty()
    df = documents.withColumn("base", base_spans(text))
    added = markov_spans(text, ratios)
    for kind in range(3):
        added = _apart(added, F.filter("base", lambda b: b["kind"] == kind))  # noqa: B023
    return df.withColumn("all", F.array_sort(F.concat("base", added)))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with mask in place of each span, or of what overlapping ones cover; the spans are by start."""

    def of(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        return _bound(_running(ends, 0, F.greatest), lambda at: F.zip_with(blocks, F.slice(at, 1, F.size(blocks)), part))

    def part(block: Column, at: Column) -> Column:
        last = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))
        return F.struct(block.alias("spans"), at.alias("at"), F.substring(text, (at + 1).cast("int"), (last - at).cast("int")).alias("text"))

    def pieces(x: Column) -> Column:  # the texts before the masks of one block
        def step(done: Column, s: Column) -> Column:
            before = F.substring(x["text"], (done["at"] - x["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
            return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], F.array_append(done["out"], before)).otherwise(done["out"]).alias("out"))

        return F.aggregate(x["spans"], F.struct(x["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]

    def joined(parts: Column) -> Column:
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        tail = F.substring(text, (end + 1).cast("int"), F.length(text))
        return F.array_join(F.array_append(F.flatten(F.transform(parts, pieces)), tail), mask)

    return _bound(_bound(_blocks_of(spans), of), joined)


def redact(documents: DataFrame, ratios: list[float] | None = None, mask: str = "[secret]") -> DataFrame:
    """documents with every span of each text replaced by mask; texts without spans, and nulls, stay as they are."""
    ratios = ratios or train(default_samples(documents))
    base, spans = C.fresh(documents, "__base"), C.fresh(documents, "__all")
    df = find(documents.select("*").withColumnsRenamed({c: f"__own_{c}" for c in documents.columns if c.lower() in ("base", "all")}), ratios)
    df = df.withColumnsRenamed({"base": base, "all": spans})
    df = df.withColumn("text", F.when(F.size(spans) > 0, _masked(F.col("text"), F.col(spans), mask)).otherwise(F.col("text")))
    df = df.drop(base, spans).withColumnsRenamed({f"__own_{c}": c for c in documents.columns})
    return df.select(*C.quoted(documents.columns))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    df = find(docs, train(default_samples(docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
