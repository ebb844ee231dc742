import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrywise.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"ab", b"aaaa", b"\0\0"]), max_size=2000).map(b"".join))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_crosses_all_widths_and_clears():
    data = os.urandom(30_000) + b"abc" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 9, (37, 50), np.uint8), rng.integers(0, 60000, (5, 7, 3), np.uint16), rng.integers(0, 255, (1, 1), np.uint8)]
    found = tiff.read(tiff.write(pages, compression, predictor, rows=10, tile=tile, order=order))
    assert len(found) == 3
    for want, got in zip(pages, found):
        assert (want.reshape(got.pixels.shape) == got.pixels).all()
        assert (got.compression, got.predictor, got.tiled) == (compression, predictor, tile is not None)


def test_known_packbits():
    # the example of the format's public description
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.packbits_decode(packed) == bytes.fromhex("aaaaaa80002aaaaaaaa a80002a22".replace(" ", "")) + b"\xaa" * 10


@pytest.mark.parametrize("bad", [b"", b"II*\0", b"GIF89a..", b"II*\0\xff\0\0\0"])
def test_bad_files_are_errors(bad):
    with pytest.raises(tiff.TiffError):
        tiff.read(bad)


def test_rows_for_pages_and_errors(spark):
    good = tiff.write([np.zeros((2, 3), np.uint8), np.ones((1, 3), np.uint8)])
    df = spark.createDataFrame([(1, good), (2, b"no"), (3, None)], "id long, media binary")
    rows = sorted(tiff.pages(df, "id", "media").collect(), key=lambda r: (r.id, r.page or 0))
    assert [(r.id, r.page, r.height) for r in rows] == [(1, 0, 2), (1, 1, 1), (2, 0, None)]
    assert bytes(rows[1].pixels) == b"\1\1\1" and rows[2].error


def test_payload_edges():
    assert tiff.payload(None) == (0, b"\xff" * 576)
    assert tiff.payload("a" * 576) == (576, b"a" * 576)
    long = "".join(random.Random(1).choices("ab c", k=700_000))
    n, data = tiff.payload(long)
    found = tiff.read(tiff.store(data))
    assert len(found) == 2 and b"".join(p.pixels.tobytes() for p in found) == data


def test_a_bad_page_leaves_the_others(spark):
    good = tiff.write([np.zeros((2, 3), np.uint8), np.ones((4, 3), np.uint8), np.ones((1, 3), np.uint8)], tiff.NONE)
    at = good.index(struct.pack("<HHIHH", 259, 3, 1, tiff.NONE, 0), good.index(struct.pack("<HHII", 257, 4, 1, 4)))
    bad = good[: at + 8] + struct.pack("<H", 7) + good[at + 10 :]  # the second page: a compression that is not known
    df = spark.createDataFrame([(1, bad, "x"), (1, bad, "y")], "page int, media binary, error string").withColumnRenamed("page", "id")
    rows = tiff.pages(df, "id", "media").collect()
    assert sorted((r.page, r.height, r.error is None) for r in rows if r.height) == [(0, 2, True)] * 2 + [(2, 1, True)] * 2
    assert sum(r.error is not None and r.page == 1 for r in rows) == 2
    assert tiff.pages(df.limit(0), "id", "media").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=6), st.integers(0, 400))
def test_damaged_files_give_errors_alone(form, changes, cut):
    pages = [np.arange(40 * 33, dtype=np.uint8).reshape(40, 33), np.ones((3, 3), np.uint16)]
    data = bytearray(tiff.write(pages, (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[form], 2 if form else 1, tile=(16, 16) if form % 2 else None))
    for at, value in changes:
        data[at % len(data)] = value
    for found in tiff.scan(bytes(data[: len(data) - cut]), most=1 << 20):
        assert isinstance(found, (tiff.Page, tiff.TiffError))


def test_tags_of_another_type_are_errors():
    for tile in (None, (16, 16)):
        data = tiff.write([np.ones((40, 33), np.uint8)], tiff.NONE, tile=tile)
        for tag in (256, 257, 258, 259, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339):
            for at in (i for i in range(len(data)) if data[i : i + 2] == struct.pack("<H", tag) and data[i + 2 : i + 4] in (b"\3\0", b"\4\0")):
                for kind in (2, 5, 11, 12):
                    for found in tiff.scan(data[: at + 2] + struct.pack("<H", kind) + data[at + 4 :]):
                        assert isinstance(found, (tiff.Page, tiff.TiffError))


def test_tags_of_no_size_are_errors():
    data = tiff.write([np.zeros((4, 4), np.uint8)], tiff.NONE)
    for tag in (256, 257, 258, 277, 278, 279):
        at = next(i for i in range(len(data)) if data[i : i + 2] == struct.pack("<H", tag) and data[i + 4 : i + 8] == b"\1\0\0\0")
        for value in (data[: at + 8] + bytes(4) + data[at + 12 :], data[: at + 4] + bytes(4) + data[at + 8 :]):
            for found in tiff.scan(value):
                assert isinstance(found, tiff.TiffError) or tag in (258, 277, 278)
    with pytest.raises(tiff.TiffError):
        tiff.read(tiff.write([np.zeros((400, 400), np.uint8)]), most=1000)


def _made(tags: dict, body: bytes, big: bool = False) -> bytes:
    """A file of one page, by hand: tags of one LONG each, the body's place in 273."""
    head = b"MM\0\x2b\0\x08\0\0" if big else b"MM\0\x2a"
    word = ">Q" if big else ">I"
    start = 16 if big else 8
    tags = {273: start, 279: len(body)} | tags
    out = head + struct.pack(word, start + len(body)) + body + struct.pack(">Q" if big else ">H", len(tags))
    for tag, value in sorted(tags.items()):
        out += struct.pack(">HH", tag, 4) + struct.pack(word, 1) + struct.pack(">I", value) + bytes(4 if big else 0)
    return out + struct.pack(word, 0)


def test_forms_made_by_hand():
    page = tiff.read(_made({256: 10, 257: 2, 258: 1}, bytes([0b10110000, 0b01000000, 0b00000001, 0b10000000])))[0]
    assert page.pixels[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 0, 0, 1, 1, 0]]
    page = tiff.read(_made({256: 3, 257: 1, 258: 4, 266: 2}, bytes([0b10000100, 0b11110000])))[0]
    assert page.pixels.ravel().tolist() == [2, 1, 0]
    page = tiff.read(_made({256: 2, 257: 2, 258: 8}, b"\1\2\3\4", big=True))[0]
    assert page.pixels[:, :, 0].tolist() == [[1, 2], [3, 4]]
    values = np.array([[1.5, -2.0, 3.25], [0.0, 1e9, -7.0]], ">f4")
    rows = values.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], 1).astype(np.uint8)
    page = tiff.read(_made({256: 3, 257: 2, 258: 32, 317: 3, 339: 3}, coded.tobytes()))[0]
    assert page.pixels[:, :, 0].tolist() == values.tolist()


def test_planes_are_put_together():
    body = b"\1\2\3\4" + b"\5\6\7\x08"
    out = b"II*\0" + struct.pack("<I", 16) + body
    tags = [(256, [2]), (257, [2]), (258, [8]), (273, None), (277, [2]), (278, [2]), (279, None), (284, [2])]
    out += struct.pack("<H", len(tags))
    end = 16 + 2 + 12 * len(tags) + 4
    for tag, value in tags:
        out += struct.pack("<HHI", tag, 4, 2 if value is None else 1) + struct.pack("<I", (end if tag == 273 else end + 8) if value is None else value[0])
    out += struct.pack("<I", 0) + struct.pack("<IIII", 8, 12, 4, 4)
    assert tiff.read(out)[0].pixels.tolist() == [[[1, 5], [2, 6]], [[3, 7], [4, 8]]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_queries(spark):
    here = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{here}/documents.parquet").collect()}
    got = tiff.op4_tiff_media(spark, here).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    for r in got:
        raw = text[r.doc_id].encode()
        whole = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        stored = tiff.store(whole)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256) / len(whole)
        assert f" mean={(counts * np.arange(256)).sum():.3f} " in r.feature and r.feature.startswith(f"576x{len(whole) // 576}/1 ")
        assert f" entropy={-(counts[counts > 0] * np.log2(counts[counts > 0])).sum():.4f} " in r.feature
    pages = tiff.tiff_pages(spark, here).collect()
    assert {r.compression for r in pages} == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {r.tiled for r in pages} == {False, True}
    digest = {r.doc_id: r.payload_sha256 for r in got}
    assert all(r.error is None and (r.height >= 1024 or r.pixels_sha256 == digest[r.doc_id]) for r in pages)


def test_the_query_on_odd_tables(spark, tmp_path):
    rows = [(1, None, "x"), (1, "", "y"), (2, "a", "z"), (None, "a", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or 0, r.n_bytes, r.media_sha256) for r in tiff.op4_tiff_media(spark, str(tmp_path)).collect()))
    assert [x[:2] for x in got] == [(0, 1), (1, 0), (1, 0), (2, 1)] and got[0][2] == got[3][2]
