"""TIFF columns: write pages, walk image directories, decode strips and tiles, one row per page.

Reads classic and Big TIFF of either byte order with PackBits, LZW, deflate or no compression, strips or
tiles, samples side by side or in planes, of 1, 2, 4, 8, 16 or 32 bits, either fill order, and predictors 2 (horizontal
differences) and 3 (of floating point) undone.  A page that cannot be read, or would take over ``most`` bytes,
gives a row with an error in place of pixels; the others of its file stand.  What is decoded is never
longer than the page says, whatever the file holds.

The query stores each text as 8-bit grey pages 576 wide, of at most PAGE_ROWS rows: in tiles if there are TILE rows,
else in strips; deflated with predictor 2, by LZW or by PackBits as the checksum of its bytes says, so equal texts
are stored alike.  It reads the file back and describes what it read.

A null medium gives no pages; a null text is stored as an empty one; a very long text has more pages.  Repeated rows
are handled each.  An empty table gives no rows.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 576
PAGE_ROWS = 1024
STRIP_ROWS = 64
#: Rows of a tile of the query's files, and its columns.
TILE = (64, 16)
#: Bytes of the largest page that is decoded.
MOST_BYTES = 1 << 28
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Field types of the format: code -> (letter of struct, bytes).  Fixed values.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Each byte with its bits the other way round.
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class TiffError(ValueError):
    """A file that is not what the format allows or this reader knows."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


# --- compression -------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int | None = None) -> bytes:
    """The bytes that runs and literals stand for, up to size."""
    out, i = bytearray(), 0
    while i < len(data) and (size is None or len(out) < size):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out if size is None else out[:size])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more are repeated bytes, the rest is literal."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    long_ = np.flatnonzero(np.diff(edge) >= 3)
    out, literal = bytearray(), 0  # literal: where bytes not yet written begin

    def flush(end: int) -> None:
        for s in range(literal, end, 128):
            part = data[s : min(s + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, e in zip(edge[long_].tolist(), edge[long_ + 1].tolist()):
        flush(s)
        for k in range(s, e, 128):
            n = min(128, e - k)
            out.extend((257 - n, data[s]) if n > 1 else (0, data[s]))
        literal = e
    flush(len(a))
    return bytes(out)


def _lzw_widths(first: int, n: int) -> np.ndarray:
    """Bits of the codes first to first + n - 1 after a clear code: 9 to 12, growing one code early."""
    known = 258 + np.maximum(np.arange(first, first + n) - 1, 0)
    return 9 + (known >= 511) + (known >= 1023) + (known >= 2047)


def _lzw_codes(data: bytes) -> Iterator[tuple[bool, list[int]]]:
    """The codes of a stream by runs, each with whether a clear code stands before it."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    at, since, clear = 0, 0, False
    while at + 9 <= 8 * len(data):
        width = _lzw_widths(since, min(4096, (8 * len(data) - at) // 9))
        end = at + np.cumsum(width)
        width, end = width[end <= 8 * len(data)], end[end <= 8 * len(data)]
        if not len(width):
            return
        start = end - width
        byte = start >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (start & 7) - width) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        yield clear, codes[:n].tolist()
        if n == len(codes):
            at, since, clear = int(end[-1]), since + n, False
        elif codes[n] == 257:
            return
        else:
            at, since, clear = int(end[n]), 0, True


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first.  Ends with size bytes."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table: list[bytes] = []
    out, length, previous = [], 0, b""
    for clear, codes in _lzw_codes(data):
        if clear:
            table, previous = single.copy(), b""
        if codes and not table:
            raise TiffError("LZW data without a clear code")
        for code in codes:
            if code < len(table) and (previous or code < 256):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise TiffError("LZW code out of range")
            if previous and len(table) < 4096:
                table.append(previous + entry[:1])
            out.append(entry)
            length += len(entry)
            previous = entry
            if size is not None and length >= size:
                return b"".join(out)[:size]
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    codes, table, new = [256], {}, 258
    put, known, prefix = codes.append, table.get, data[0] if data else -1
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = known(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = new
        new += 1
        prefix = byte
        if new == 4094:
            put(256)
            table.clear()
            new = 258
    if data:
        put(prefix)
    put(257)
    code = np.array(codes)
    clear = np.flatnonzero(code == 256)
    width = np.concatenate([[9], *(_lzw_widths(0, n) for n in np.diff(np.append(clear, len(code) - 1)))])
    bits = (code[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(11, -1, -1) < width[:, None]].astype(np.uint8)).tobytes()


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    """The first size bytes of a strip or tile."""
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate data: {e}") from e
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise TiffError(f"compression {compression} is not known")


def _pack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return packbits_encode(data)
    raise ValueError(f"compression {compression} cannot be written")


# --- reading -----------------------------------------------------------------------------


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory in the chain; a tag without values is left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        version = struct.unpack_from(order + "H", data, 2)[0] if order else 0
        if version == 43 and struct.unpack_from(order + "HH", data, 4) == (8, 0):
            word, number, inline, at = order + "Q", order + "Q", 8, struct.unpack_from(order + "Q", data, 8)[0]
        elif version == 42:
            word, number, inline, at = order + "I", order + "H", 4, struct.unpack_from(order + "I", data, 4)[0]
        else:
            raise TiffError("no TIFF header")
        size, head, seen = 4 + 2 * inline, struct.calcsize(number), set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(number, data, at)
            if at + head + size * n > len(data):
                raise TiffError("a directory leaves the file")
            tags = {}
            for i in range(n):
                place = at + head + size * i
                tag, kind = struct.unpack_from(order + "HH", data, place)
                (count,) = struct.unpack_from(word, data, place + 4)
                if kind not in _TYPES or not count:
                    continue
                letter, width = _TYPES[kind]
                place += 4 + inline
                if count * width > inline:
                    (place,) = struct.unpack_from(word, data, place)
                if place + count * width > len(data):
                    raise TiffError("a tag leaves the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
            (at,) = struct.unpack_from(word, data, at + head + size * n)
            yield order, tags
    except struct.error as e:
        raise TiffError("a directory leaves the file") from e


def _samples(raw: bytes, lines: int, across: int, samples: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """(lines, across, samples) of one strip or tile, its predictor undone."""
    if bits < 8:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(lines, -1), axis=1)[:, : across * samples * bits]
        weight = 1 << np.arange(bits - 1, -1, -1)
        return (flat.reshape(lines, across, samples, bits) @ weight).astype(np.uint8)
    if predictor == 3:
        rows = np.frombuffer(raw, np.uint8).reshape(lines, -1, samples)
        rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(lines, kind.itemsize, across * samples)
        block = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">"))
        return block.reshape(lines, across, samples)
    block = np.frombuffer(raw, kind).reshape(lines, across, samples)
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        block = np.cumsum(block.astype(kind.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(kind.newbyteorder("="))
    return block


#: Tags whose values must be whole numbers.
_NUMBERS = (256, 257, 258, 259, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339)


def _page(data: bytes, order: str, tags: dict[int, tuple], most: int = MOST_BYTES) -> Page:
    for tag in _NUMBERS:
        if not all(isinstance(x, int) for x in tags.get(tag, ())):
            raise TiffError(f"tag {tag} is no whole number")
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, compression, predictor, form, planes = one(258, 1), one(259, NONE), one(317, 1), one(339, 1), one(284, 1)
    for name, value in (("size", width), ("size", height), ("samples", samples)):
        if not isinstance(value, int) or value < 1:
            raise TiffError(f"no image {name}")
    letter = {1: "u", 2: "i", 3: "f"}.get(form)
    fits = bits in (8, 16, 32) and predictor in (1, 2) or bits in (1, 2, 4) and predictor == 1 or bits in (16, 32) and predictor == 3 and letter == "f"
    if set(tags.get(258, (1,))) - {bits} or not fits or letter is None or letter == "f" and bits < 16 or planes not in (1, 2) or one(266, 1) not in (1, 2):
        raise TiffError("samples of this form are not known")
    kind = np.dtype("u1") if bits < 8 else np.dtype(f"{order}{letter}{bits // 8}")
    if width * height * samples * kind.itemsize > most:
        raise TiffError(f"the page has over {most} bytes")
    tiled = 322 in tags
    across, down = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if min(across, down) < 1 or across * down * samples * kind.itemsize > most:
        raise TiffError("strips or tiles of no size, or too large")
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    columns, rows = -(-width // across), -(-height // down)
    each, layers = (samples, 1) if planes == 1 else (1, samples)
    if not offsets or not counts or len(offsets) != columns * rows * layers or len(counts) != len(offsets):
        raise TiffError("strips or tiles are missing")
    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (at, count) in enumerate(zip(offsets, counts)):
        layer, k = divmod(k, columns * rows)
        y, x = k // columns * down, k % columns * across
        lines = down if tiled else min(down, height - y)
        size = lines * -(-across * each * bits // 8)
        packed = data[at : at + count]
        raw = _unpack(packed.translate(_MIRRORED) if one(266, 1) == 2 else packed, compression, size)
        if len(raw) < size:
            raise TiffError("a strip or tile is too short")
        part = _samples(raw, lines, across, each, bits, kind, predictor)[: height - y, : width - x]
        pixels[y : y + part.shape[0], x : x + part.shape[1], slice(None) if planes == 1 else slice(layer, layer + 1)] = part
    return Page(width, height, samples, bits, compression, predictor, tiled, pixels)


def scan(data: bytes, most: int = MOST_BYTES) -> Iterator[Page | TiffError]:
    """Each page of a file in the order of its directories, or why it cannot be read; last, why there are no more."""
    try:
        for order, tags in _directories(data):
            try:
                yield _page(data, order, tags, most)
            except TiffError as e:
                yield e
    except TiffError as e:
        yield e


def read(data: bytes, most: int = MOST_BYTES) -> list[Page]:
    """All pages of a file; a TiffError if one of them cannot be read."""
    pages = list(scan(data, most))
    for p in pages:
        if isinstance(p, TiffError):
            raise p
    return pages


# --- writing -----------------------------------------------------------------------------


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of pages (height, width[, samples]) of uint8 or uint16; tile is (width, height), multiples of 16."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for pixels in pages:
        pixels = pixels.reshape(pixels.shape[0], pixels.shape[1], -1)
        height, width, samples = pixels.shape
        kind = np.dtype(f"{order}u{pixels.dtype.itemsize}")
        across, down = tile or (width, min(rows, height))
        offsets, counts = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = pixels[y : y + down, x : x + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], 1)
                packed = _pack(block.astype(kind, copy=False).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * kind.itemsize] * samples), (259, 3, [compression]), (262, 3, [1 if samples < 3 else 2]), (277, 3, [samples])]
        fields += [(322, 4, [across]), (323, 4, [down]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [down]), (279, 4, counts)]
        fields += [(317, 3, [predictor])]
        entries = bytearray()
        for tag, code, values in sorted(fields):
            letter, size = _TYPES[code]
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place, out = len(out), out + raw
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# --- DataFrames --------------------------------------------------------------------------

PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def pages(media: DataFrame, key: str, column: str, most: int = MOST_BYTES) -> DataFrame:
    """A row for each page of each medium: the key, the page's form and its samples, or its error."""
    C.small_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    kinds = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "pixels": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, data in enumerate(batch.column(1)):
                for k, p in enumerate(scan(data.as_py(), most) if data.is_valid else ()):
                    row = {"page": k, "error": str(p)} if isinstance(p, TiffError) else {"page": k, **vars(p), "pixels": p.pixels.tobytes()}
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), *(pa.array([row.get(n)], t) for n, t in kinds.items())], names=[key, *kinds])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, {PAGE_SCHEMA}")


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with 255s up to a positive multiple of WIDTH)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))


def store(data: bytes) -> bytes:
    """A payload as a TIFF file."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    parts = [grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)]
    compression = (DEFLATE, LZW, PACKBITS)[zlib.crc32(data) % 3]
    return write(parts, compression, 2 if compression == DEFLATE else 1, tile=TILE if len(grid) >= TILE[1] else None)


def feature(found: list[Page]) -> str:
    """Size, pages, mean, deviation and entropy of the samples, mean step along lines, and an 8 by 8 average hash."""
    grid = np.concatenate([p.pixels[:, :, 0] for p in found])
    counts = np.bincount(grid.ravel(), minlength=256)
    share = counts / counts.sum()
    level = np.arange(256)
    mean = float(share @ level)
    deviation = max(0.0, float(share @ level**2) - mean**2) ** 0.5
    full = share[share > 0]
    entropy = float(-(full * np.log2(full)).sum())
    step = float(np.abs(np.diff(grid.astype(np.int16), axis=1)).mean())
    rows = np.arange(9) * len(grid) // 8
    blocks = np.array([grid[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean((0, 2)) for a, b in zip(rows[:-1], rows[1:])])
    bits = "".join("1" if x else "0" for x in (blocks > mean).ravel())
    return f"{WIDTH}x{len(grid)}/{len(found)} mean={mean:.3f} dev={deviation:.3f} entropy={entropy:.4f} step={step:.3f} hash={int(bits, 2):016x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, text in enumerate(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([store(payload(text.as_py())[1])], pa.binary())], names=["doc_id", "media"])


def tiff_pages(spark, sf_dir: str) -> DataFrame:
    """A row for each page of each document's file, the samples as their digest."""
    C.small_batches(spark)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.text_or_empty().alias("text"))
    media = docs.mapInArrow(_stored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")
    return pages(media, "doc_id", "media").withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            n, data = payload(text)
            medium = store(data)
            found = read(medium)
            back = b"".join(p.pixels.tobytes() for p in found)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x)) for x in zip(*rows))] if rows else [batch.column(0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op4_tiff_media(spark, sf_dir: str) -> DataFrame:
    C.small_batches(spark)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_digested, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
