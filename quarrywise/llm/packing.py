"""Packing of tokenized documents into fixed windows by best-fit decreasing.

Each text is tokenized where it is read; only (document, start, length, checksum) rows are
shuffled, or the ids too if asked for.  A document longer than a window is first cut into full
windows; what is left of each goes, longest first, to the open window with the least
sufficient room.  A segment tree over remaining capacities 0..4096 finds that window.
Pieces are dealt into buckets by hash, about BUCKET_ROWS documents to each, packed apart: the
windows left partly empty are one or two a bucket.  A piece's bucket follows from its doc_id and start; where a task
meets a doc_id again, from the task and a number too, so repeated documents spread over all buckets.  Tables without
repeated ids are packed alike however they are laid out.

Null texts are empty: one piece holding the end id alone.  A very long text is cut into windows, and words of over
LONGEST characters are not remembered.  Repeated rows are packed each; ties in length go by doc_id and start.  An empty
table gives no rows.  Only doc_id (any type, null too) and text are read, so others may have any names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _common as C
from . import _words as W

WINDOW = 4096
END_ID = 2
BUCKET_ROWS = 4000
#: Bytes, with BYTES_EACH for each chunk, in each of two generations that a worker remembers; and the longest chunk that it does.
CACHE_BYTES = 48 << 20
BYTES_EACH = 130
LONGEST = 200
#: Doc_ids that a task remembers to spread repeated ones.
MET = 500_000
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_tokenizers: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a tokenizer that lower-cases, drops white space and ends words by tokens of their own.

    Blank-separated chunks of many lower-cased texts are told apart by 64-bit values of their bytes; each different one
    is encoded once and remembered as bytes, in two generations, so that what is in use stays.  New plain words are encoded many at once, in one string, and
    told apart by their ending tokens; those of long-standing letters, and the pre-tokens of printable ASCII chunks,
    by the same model without its normalizer and pattern, which leave them as they are.  Texts for which this could differ from the tokenizer go to it whole:
    with special tokens, a capital sigma, separators it does not know, or not in composed form.
    """

    #: Characters of texts whose words are looked up together.
    TOGETHER = 1 << 22
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    #: Pre-tokens of lower-cased printable ASCII.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    #: Letters before this one are letters, and lower-cased alike, in every Unicode that a tokenizer may know.
    NEWER = "\u0500"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        lean = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, self.BYTES]}}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _each(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks of any kind, many a call."""
        found = {}
        for i in range(0, len(chunks), 1000):
            some = chunks[i : i + 1000]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            found.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(some, encoded))
        return found

    def _plain(self, words: list[str]) -> None:
        """Words of letters only, which are one pre-token each."""
        newer = [w for w in words if not w.isascii() and max(w) >= self.NEWER]
        self._joined(self.tokenizer, newer)
        self._joined(self.lean, list(set(words).difference(newer)) if newer else words)

    def _printable(self, chunks: list[str]) -> None:
        """Chunks of printable ASCII: their pre-tokens, each of which ends by a token of its own, many in one string."""
        for i in range(0, len(chunks), 5000):
            some = chunks[i : i + 5000]
            parts = list(map(self.PIECES.findall, some))
            ids = np.array(self.lean.encode_batch_fast([" ".join(chain.from_iterable(parts))], add_special_tokens=False)[0].ids, "<u4")
            at, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(list(map(len, parts)))
            if len(at) != last[-1]:
                self._put(self._each(some))
                continue
            raw, ends = ids.tobytes(), (4 * at[last - 1]).tolist()
            self._put({c: raw[i:j] for c, i, j in zip(some, [0, *ends], ends)})

    def _joined(self, tokenizer: Tokenizer, words: list[str]) -> None:
        for i in range(0, len(words), 5000):
            some = words[i : i + 5000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(some):
                self._put(self._each(some))
                continue
            raw, ends = ids.tobytes(), (4 * at).tolist()
            self._put({w: raw[i:j] for w, i, j in zip(some, [0, *ends], ends)})

    def _put(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.size += BYTES_EACH * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def _unknown(self, chunks: set[str]) -> set[str]:
        """Those of chunks that are not known, once what the older generation has is known again."""
        known, older = self.known, self.older
        new = chunks.difference(known)  # looks each of chunks up; a difference from known.keys() would go over all of known
        if older:
            missed = new.difference(older)
            self._put({x: older[x] for x in new.difference(missed)})
            return missed
        return new

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Make all of chunks known; the ids of those too long to remember."""
        if self.size > CACHE_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        known = self.known
        new = self._unknown(chunks)
        long_ = self._each([x for x in new if len(x) > LONGEST])
        new.difference_update(long_)
        plain = set(filter(str.isalpha, new))
        new -= plain
        tailed = {x: head for x in new if x[-1] in ".,;:!?" and (head := x[:-1]).isalpha()}
        self._plain(list(plain | self._unknown(set(tailed.values()) - plain)))
        self._put(self._each(list(self._unknown({x[-1] for x in tailed}))))
        self._put({x: known[head] + known[x[-1]] for x, head in tailed.items()})
        rest = {x for x in new if x not in known}
        printable = {x for x in rest if x.isascii() and x.isprintable()}
        self._printable(list(printable))
        self._put(self._each(list(rest - printable)))
        return long_

    def forget(self) -> None:
        """Give up all that is remembered, at a task's end: most words are new to the next task anyway, and idle workers stay."""
        self.known, self.older, self.size = {}, {}, 0

    def _lowered(self, text: str) -> str | None:
        """The lower-cased text with ASCII white space alone, or None if it must be encoded whole."""
        if "<|" in text or "\u03a3" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        low = text.lower()
        if text.isascii():
            return low
        if not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return None
        return _SPACES.sub(" ", low)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-cased texts one after the other, and where each text's end."""
        words, _ = W.split(pa.array(texts, pa.large_string()), W.UNSPACED)
        _, one, which = np.unique(words.value, return_index=True, return_inverse=True)
        data = words.data.tobytes()
        chunks = [data[a:b].decode() for a, b in zip(words.start[one].tolist(), words.end[one].tolist())]
        long_ = self._learn(set(chunks))
        known = self.known
        raw = [long_[c] if c in long_ else known[c] for c in chunks] if long_ else list(map(known.__getitem__, chunks))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begin, n = np.cumsum(size) - size, size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], n)
        return np.frombuffer(b"".join(raw), "<u4")[at], ends[words.first]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.TOGETHER):
                size += len(texts[end])
                end += 1
            low = [self._lowered(t) for t in texts[at:end]]
            ids, cuts = self._together([t or "" for t in low])
            for i, t in enumerate(low):
                yield np.frombuffer(self._ids(texts[at + i]), "<u4") if t is None else ids[cuts[i] : cuts[i + 1]]
            at = end


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        if len(self.at[room]) == 1:
            self._move(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least that much room, no longer open."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        if not self.at[room]:
            self._move(room, -1)
        return room, window

    def _move(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i //= 2


def best_fit(lengths: list[int], capacity: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; lengths must not increase and must fit a window."""
    windows = OpenWindows(capacity)
    where, offsets, n = [], [], 0
    for need in lengths:
        found = windows.take(need) if need else None
        room, window = found or (capacity, n)
        n += found is None
        where.append(window)
        offsets.append(capacity - room)
        if room > need:
            windows.add(room - need, window)
    return where, offsets


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met, task = encoder(path).encode, {}, TaskContext.get().partitionId()
        for batch in batches:
            take, start, length, crc, total, salt, ids = [], [], [], [], [], [], []
            docs = batch.column(0).to_pylist()
            for r, found in enumerate(encode(batch.column(1).to_pylist())):
                doc = str(docs[r])
                if len(met) >= MET and doc not in met:
                    met.clear()
                again = met[doc] = met.get(doc, -1) + 1
                found = np.append(found, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(found), capacity):
                    piece = found[a : a + capacity]
                    take.append(r)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(found))
                    salt.append(again and (task << 32) + again)
                    if keep_ids:
                        ids.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, salt))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder(path).forget()

    return run


def _packed(capacity: int):
    """Rows sorted by bucket, then decreasing length -> the same with sequence_id and offset."""

    def settle(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        where, offsets = best_fit(table["length"].to_pylist(), capacity)
        table = table.drop_columns(["bucket", "salt"])
        table = table.append_column("sequence_id", pa.array(np.array(where, np.int64) + (bucket << 32)))
        yield from table.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
            for a, b in zip(edge, [*edge[1:], len(keys)]):
                if keys[a] != now:
                    if parts:
                        yield from settle(now, parts)
                    now, parts = int(keys[a]), []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from settle(now, parts)

    return run


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset."""
    C.small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    buckets = C.partitions_for(documents.count(), bucket_rows)
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt bigint" + ", ids array<int>" * keep_ids
    pieces = documents.select("doc_id", C.text_or_empty().alias("text")).mapInArrow(C.trimmed(_pieces(tokenizer or default_path(), end_id, capacity, keep_ids)), schema)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(buckets)))
    dealt = pieces.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(C.trimmed(_packed(capacity)), schema.replace(" salt bigint,", "").replace(", salt bigint", "") + ", sequence_id bigint, offset bigint")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
