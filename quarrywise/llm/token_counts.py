"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A text is cut into pre-tokens by the tokenizer's own pattern; a leaf holds a block of them with
their lengths and token counts, an inner node the sums below it.  An edit (start, deleted,
inserted; code points) descends by length to the first pre-token it can concern: the pattern looks
no further than CONTEXT characters past a pre-token's end, so earlier ones stand.  From there the text
is cut anew until a cut falls on an old one beyond the edit; what lies after stands too.  Only the
new pre-tokens are encoded, and only the sums on the paths of the changed blocks are updated.

A null text is empty, a null list of edits has none; positions beyond the end are moved to it.  Edits
apply one after the other.  A very long text is counted whole; pre-tokens of over LONGEST characters are not
remembered.  Repeated rows are counted each.  An empty table gives no rows.  Columns named as the outputs are replaced; others stay.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _common as C

#: The pre-token pattern of byte-level BPE.  A fixed value of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
BLOCK = 32
#: Bytes, with BYTES_EACH for each, of the pre-tokens whose counts a worker remembers; and the longest that it does.
CACHE_BYTES = 48 << 20
BYTES_EACH = 130
LONGEST = 200
_counters: dict[str, "Counter"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads for a few words each cost more than they do
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.size = 0

    def counts(self, parts: list[str]) -> list[int]:
        try:
            return [self.known[p] for p in parts]
        except KeyError:
            if self.size > CACHE_BYTES:
                self.known, self.size = {}, 0
            new = list({p for p in parts if p not in self.known})
            found = {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            kept = found if max(map(len, new)) <= LONGEST else {p: n for p, n in found.items() if len(p) <= LONGEST}
            self.known.update(kept)
            self.size += BYTES_EACH * len(kept) + sum(map(len, kept))
            return [found[p] if p in found else self.known[p] for p in parts]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class CountedText:
    """A text with a segment tree of pre-token lengths and token counts."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        parts = counter.split.findall(text)
        self._build([len(p) for p in parts], self._counts(parts))

    def _counts(self, parts: list[str]) -> list[int]:
        self.encoded += len(parts)
        return self.counter.counts(parts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lengths) // BLOCK))
        self.lengths = [lengths[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.counts = [counts[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(n):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(self.lengths[i]), sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(map(len, self.lengths))

    def _locate(self, at: int) -> tuple[int, int, int]:
        """(block, place in it, start) of the first pre-token that ends after ``at``; past the end, the last block's end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if before + self.chars[i] <= at:
                before += self.chars[i]
                i += 1
        block = min(i - self.size, len(self.lengths) - 1)
        if i - self.size >= len(self.lengths):
            before = self.chars[1] - self.chars[self.size + block]
        for k, n in enumerate(self.lengths[block]):
            if before + n > at:
                return block, k, before
            before += n
        return block, len(self.lengths[block]), before

    def _update(self, block: int) -> None:
        i = self.size + block
        self.chars[i], self.tokens[i] = sum(self.lengths[block]), sum(self.counts[block])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        start = max(0, min(start, len(self.text)))
        deleted = max(0, min(deleted, len(self.text) - start))
        if not deleted and not inserted:
            return
        block, place, at = self._locate(max(0, start - CONTEXT))
        self.text = self.text[:start] + inserted + self.text[start + deleted :]
        shift, beyond = len(inserted) - deleted, start + deleted
        # old pre-tokens from (block, place) on, walked as new cuts pass them
        b, k, old = block, place, at
        fresh: list[str] = []
        done = False
        for m in self.counter.split.finditer(self.text, at):
            fresh.append(m.group())
            while b < len(self.lengths) and (old < beyond or old + shift < m.end()):
                if k >= len(self.lengths[b]):
                    b, k = b + 1, 0
                    continue
                old += self.lengths[b][k]
                k += 1
            if old >= beyond and old + shift == m.end():
                done = True
                break
        if not done:  # to the end of the text
            b, k = len(self.lengths), 0
        lengths, counts = [len(p) for p in fresh], self._counts(fresh)
        if b == block:
            self.lengths[b][place:k], self.counts[b][place:k] = lengths, counts
        else:
            self.lengths[block][place:], self.counts[block][place:] = lengths, counts
            for i in range(block + 1, min(b, len(self.lengths))):
                self.lengths[i], self.counts[i] = [], []
                self._update(i)
            if b < len(self.lengths):
                del self.lengths[b][:k], self.counts[b][:k]
                self._update(b)
        self._update(block)
        if len(self.lengths[block]) > 8 * BLOCK:  # too much in one leaf: deal the blocks anew
            self._build([n for x in self.lengths for n in x], [n for x in self.counts for n in x])


def recount(documents: DataFrame, edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """documents (text, a column of array<struct<start,deleted,inserted>>) with the edited text and counts.

    Adds n_tokens_before, n_tokens, n_pretokens, n_reencoded; text becomes the edited text.
    """
    C.small_batches(documents.sparkSession)
    added = ("n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded")
    path = tokenizer or default_path()
    df = documents.withColumns({k: F.lit(None).cast("long") for k in added})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = counter(path)
        for batch in batches:
            at = {f.name: i for i, f in enumerate(batch.schema)}
            rows = []
            for text, script in zip(batch.column(at["text"]).to_pylist(), batch.column(at[edits]).to_pylist()):
                doc = CountedText(text or "", shared)
                before, doc.encoded = doc.total, 0
                for e in script or ():
                    doc.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                rows.append((doc.text, before, doc.total, doc.pieces, doc.encoded))
            columns = list(batch.columns)
            for name, values in zip(("text", *added), zip(*rows) if rows else [[]] * 5):
                columns[at[name]] = pa.array(list(values), batch.schema.field(at[name]).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def standard_edits(text) -> "F.Column":
    """The query's edits: cut 7 characters at a third, insert a mark at half, replace 5 at two thirds (of the first text)."""
    n = F.length(text)
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.floor(n / 3), 7, ""), edit(F.floor(n / 2), 0, " [edited] "), edit(F.floor(n * 2 / 3), 5, "changed"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.text_or_empty().alias("text"))
    df = recount(docs.withColumn("edits", standard_edits(F.col("text"))))
    return df.select("doc_id", "n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", F.sha2("text", 256).alias("text_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
