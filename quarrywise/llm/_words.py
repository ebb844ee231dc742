"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A column's UTF-8 bytes are read in place.  A word's 64-bit value comes from its (folded) bytes, eight at
a time: each eight are put in by exclusive or and the whole is mixed, so no arithmetic of the bytes
carries over to the values.  Words of up to eight bytes and one length never share a value; words of over
LONG bytes take theirs from BLAKE2b.  A value depends on the word's bytes alone, so it is the same in every task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; cuts fall between words.
PIECE = 1 << 18
#: Bytes of the longest words that are mixed here.
LONG = 64
#: The first k of eight little-endian bytes, for k from 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on one another."""
    v = (v ^ (v >> U(30))) * U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> U(27))) * U(0x94D049BB133111EB)
    return v ^ (v >> U(31))


def _values(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Values of the words at [start, end) of code, which has eight spare bytes at its end."""
    eight = np.ndarray((len(code) - 7,), "<u8", code, strides=(1,))
    size = end - start
    out = mix((eight[start] & _FIRST[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) + U(0x9E3779B97F4A7C15)))
    for j in range(8, LONG, 8):
        more = np.flatnonzero(size > j)
        if not len(more):
            return out
        part = eight[start[more] + j] & _FIRST[np.minimum(size[more] - j, 8)]
        out[more] = mix(out[more] + U(0x632BE59BD9B4E019) ^ part)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(code[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _heads(code: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Values of the first k (8 at most) bytes of words."""
    eight = np.ndarray((len(code) - 7,), "<u8", code, strides=(1,))
    return mix((eight[start] & _FIRST[np.minimum(end - start, k)]) ^ mix(np.full(1, k << 32, np.uint64)))


class Alphabet:
    """Which bytes make up words, and how they are folded."""

    def __init__(self, word: np.ndarray, lower: bool = True):
        self.word = word.astype(bool)
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        #: Folded bytes of words, 0 for others; a NUL in a word becomes 255, which UTF-8 never has.
        self.codes = bytes((int(f) or 255) if w else 0 for f, w in zip(fold, self.word))
        #: For bytes.translate: other bytes become spaces.
        self.table = bytes(int(f) if w else 32 for f, w in zip(fold, self.word))


def _alnum() -> np.ndarray:
    word = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        word[a : b + 1] = True
    return word


def _unspaced() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, 9, 10, 11, 12, 13]] = False
    return word


#: Digits, letters and all bytes from 0x80: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ALNUM = Alphabet(_alnum())
#: All but ASCII white space: [^\x20\x09-\x0D]+ once A-Z are lower-cased.
UNSPACED = Alphabet(_unspaced())


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in order; doc has each word's row, first the first word of each row (and the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, i: int, alphabet: Alphabet) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().translate(alphabet.table)

    def joined(self, i: int, j: int, alphabet: Alphabet) -> bytes:
        """Words i to j - 1 with a blank between them."""
        return b" ".join(self.data[self.start[i] : self.end[j - 1]].tobytes().translate(alphabet.table).split())


def _pieces(code: np.ndarray, fresh: np.ndarray):
    at, n = 0, len(code)
    while at < n:
        end = min(n, at + PIECE)
        if end < n and code[end - 1] and code[end] and not fresh[end]:
            step = 256
            while True:  # to the next place where no word goes on
                stop = min(n, end + step)
                gap = np.flatnonzero((code[end:stop] == 0) | fresh[end:stop])
                if len(gap):
                    end += int(gap[0])
                    break
                if stop == n:
                    end = n
                    break
                step *= 4
        yield at, end
        at = end


def split(column, alphabet: Alphabet, prefixes: tuple[int, ...] = ()) -> tuple[Words, list[np.ndarray]]:
    """All words of a column; for each k in prefixes (8 at most) also the values of their first k bytes."""
    data, offsets = buffer(column)
    n = len(data)
    code = np.frombuffer(data.tobytes().translate(alphabet.codes) + bytes(8), np.uint8)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[:-1]] = True
    starts, ends, values = [], [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    for a, b in _pieces(code[:n], fresh):
        w, f = code[a:b] != 0, fresh[a:b]
        join = w[:-1] & w[1:] & ~f[1:]  # a word goes on from this byte to the next
        s = np.flatnonzero(w & ~np.concatenate(([False], join)))
        e = np.flatnonzero(w & ~np.concatenate((join, [False]))) + 1
        if not len(s):
            continue
        part = code[a : b + 8]
        values.append(_values(part, s, e))
        for k, out in zip(prefixes, heads):
            out.append(_heads(part, s, e, k))
        starts.append(s + a)
        ends.append(e + a)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    first = np.searchsorted(start, offsets)
    return Words(data, start, join(ends, np.int64), join(values, np.uint64), first, offsets), [join(x, np.uint64) for x in heads]


def value_of(word: bytes, alphabet: Alphabet) -> int:
    """The value split() gives a word."""
    return int(split(pa.array([word.decode()]), alphabet)[0].value[0])


def windows(value: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all runs of k words within one row, and the place of each run's first word."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9) + value[j : j + n]
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    keep = np.flatnonzero(room >= k)
    return mix(out[keep]), keep
