import hashlib
import itertools
import struct
import time
import zlib

import numpy as np
import pytest

from querent.llm import tiff
from querent.llm.queries import media_digests


def image(height, width, bands, kind="u1", seed=0):
    rnd = np.random.default_rng(seed)
    rows = rnd.integers(0, 4, (height, width, bands)).astype(kind) * 7
    rows[height // 3 :, width // 2 :] = 9
    return rows


@pytest.mark.parametrize("compression,predictor,tile,order", [*itertools.product([tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE], [1, 2], [0, 16], ["<", ">"])])
def test_round_trip(compression, predictor, tile, order):
    for big, planar, kind in itertools.product([False, True], [False, True], ["u1", "u2"]):
        pages = [image(37, 45, 3, kind), image(1, 1, 1, kind), image(64, 16, 4, kind, 2)]
        data = tiff.written(pages, compression, predictor, 10, tile, order, big, planar)
        found = list(tiff.Reader(data).pages())
        assert [(p.page, p.height, p.width, p.bands) for p in found] == [(k, *x.shape) for k, x in enumerate(pages)]
        for p, x in zip(found, pages, strict=True):
            assert np.array_equal(np.frombuffer(p.samples, f"<{kind}").reshape(x.shape), x)


def test_codecs():
    rnd = np.random.default_rng(3)
    for data in [b"", b"a", b"ab", b"aaa" * 200, bytes(range(256)) * 20, rnd.integers(0, 256, 30000, dtype="u1").tobytes(), rnd.integers(0, 3, 90000, dtype="u1").tobytes()]:
        assert tiff.unpackbits(tiff.packbits(data)) == data
        assert tiff.unlzw(tiff.lzw(data)) == data


def test_known_packbits_stream():
    stream = bytes.fromhex("FEAA02800 02AFDAA03800 02A22F7AA".replace(" ", ""))
    assert tiff.unpackbits(stream).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"


def test_float_predictor():
    values = np.linspace(-3, 9, 35, dtype="<f4").reshape(5, 7)
    planes = values.astype(">f4").view("u1").reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    coded = np.diff(planes, axis=1, prepend=np.zeros((5, 1), "u1")).astype("u1")
    block = tiff.Reader(b"II*\0\0\0\0\0").block(zlib.compress(coded.tobytes()), tiff.DEFLATE, 3, 5, 7, 1, 32)
    assert np.array_equal(block.view("<f4"), values)


def test_broken_files(spark):
    good = tiff.written([image(20, 20, 1)])
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    rows = [(0, None), (1, b""), (2, b"not a tiff"), (3, good[:40]), (4, good[:-60]), (5, bytes(looped)), (6, good), (6, good), (7, b"II*\0\xff\xff\xff\x7f")]
    files = spark.createDataFrame([(k, None if d is None else bytearray(d), 1) for k, d in rows], "doc_id long, media binary, page int")
    got = tiff.tiff_pages(files, keep=("doc_id",)).collect()
    assert sorted((r.doc_id, r.page, r.error is None) for r in got if r.error is None) == [(5, 0, True), (6, 0, True), (6, 0, True)]
    assert sorted(r.doc_id for r in got if r.error) == [2, 3, 4, 7]
    with pytest.raises(ValueError):
        tiff.tiff_pages(files, keep=("doc_id", "page"))


def plain_feature(payload):
    n = len(payload)
    cuts = [k * n // 64 for k in range(65)]
    sums = [sum(payload[a:b]) for a, b in zip(cuts, cuts[1:])]
    bits = "".join("1" if s * 64 > sum(sums) else "0" for s in sums)
    return f"64x{n // 192}x3:{sum(payload) * 1000 // n}:{int(bits, 2):016x}"


def test_every_layout_gives_the_text_back(spark):
    docs = spark.createDataFrame([(k, f"text number {k} é\n" * (1 + k * 9)) for k in range(40)], "doc_id long, text string")
    for layout in tiff.LAYOUTS:
        pages = tiff.tiff_pages(tiff.tiff_written(docs, layouts=(layout,)), keep=("doc_id", "n_bytes")).collect()
        assert sorted(r.doc_id for r in pages) == list(range(40))
        assert all(bytes(r.samples)[: r.n_bytes].decode() == f"text number {r.doc_id} é\n" * (1 + r.doc_id * 9) for r in pages)
        assert {(r.compression, r.tiled) for r in pages} == {(layout["compression"], "tile" in layout)}


def forged(*entries, tail=b""):
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4 + tail


def test_forged_files_cost_nothing():
    bomb = zlib.compress(bytes(50_000_000), 9)
    page = lambda width, height, tail, kind=8: forged((256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, kind), (273, 4, 1, 98), (278, 4, 1, height), (279, 4, 1, len(tail)), tail=tail)
    files = [
        forged((273, 5, 16_000_000, 0)),
        forged((256, 4, 0xFFFFFFFF, 0)),
        page(0xFFFFFFFF, 0xFFFFFFFF, bomb),
        page(60_000, 60_000, bomb),
        page(0, 5, b"x"),
        page(60_000, 60_000, b"\x81a" * 1000, tiff.PACKBITS),
        b"II*\0\x08\0\0\0" + b"\xff\xff" * 3000,
    ]
    for data in files:
        began = time.perf_counter()
        with pytest.raises((ValueError, KeyError, struct.error)):
            list(tiff.Reader(data).pages())
        assert time.perf_counter() - began < 1
    small = page(64, 1, bomb)
    began = time.perf_counter()
    assert [len(p.samples) for p in tiff.Reader(small).pages()] == [64]
    assert time.perf_counter() - began < 1


def test_digests_equal_a_plain_count(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long text é\n" * 40000, "a"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media_digests(docs).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = tiff.written(tiff.text_pages(t), **tiff.LAYOUTS[zlib.crc32(data) % len(tiff.LAYOUTS)])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == plain_feature(payload)
    assert got[2].asDict() | {"doc_id": 7} == got[7].asDict()
    assert got[0].asDict() | {"doc_id": 1} == got[1].asDict()
    assert media_digests(docs.limit(0)).collect() == []


def test_many_pages_hold_the_whole_text(spark):
    text = "one line of the text\n" * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pages = sorted(tiff.tiff_pages(tiff.tiff_written(docs, page_rows=10), keep=("doc_id",)).collect(), key=lambda r: r.page)
    assert len(pages) == 11
    assert b"".join(bytes(p.samples) for p in pages).rstrip(b" ") == text.encode()
