import base64
import hashlib
import io
import random
import zipfile
import zlib

import pytest

from querent.llm import warc


def reading(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_and_ranges(zip64):
    members = [("archive/é.bin", bytes(range(256)) * 9), ("empty", b""), ("b", b"xyz")]
    data = warc.zipped(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    own = warc.Zip(reading(data), len(data))
    for name, content in members:
        assert own.range(name, 0, len(content)) == content
    assert own.range("archive/é.bin", 100, 9) == members[0][1][100:109]
    with pytest.raises(ValueError):
        own.range("b", 1, 3)


def test_files_of_the_standard_library():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.comment = b"a comment at the end"
        z.writestr("stored", b"abc" * 100)
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"wide content")
    own = warc.Zip(reading(held.getvalue()), len(held.getvalue()))
    assert own.range("stored", 3, 6) == b"abcabc" and own.range("wide", 0, 12) == b"wide content"
    with pytest.raises(ValueError):
        own.range("packed", 0, 1)


def test_only_ranges_are_read(tmp_path):
    found = [(f"urn:page:{k}", f"http://x/{k}", warc.gzipped(warc.record("response", f"urn:page:{k}", f"http://x/{k}", random.Random(k).randbytes(9000)))) for k in range(40)]
    data = warc.packed(found)
    read = []

    def read_at(at, n):
        read.append(n)
        return data[at : at + n]

    assert {r.name for r in warc.records(read_at, len(data))} == {f"urn:page:{k}" for k in range(40)}
    assert max(read) <= 22 + 65535 and len(data) > 300_000
    path = tmp_path / "a.wacz"
    path.write_bytes(data)
    assert len(list(warc.path_records(str(path)))) == 40
    bare = warc.zipped([("archive/x.warc.gz", b"".join(r for *_, r in found))])
    assert [r.name for r in warc.records(reading(bare), len(bare))] == [n for n, *_ in found]
    plain = [zlib.decompress(r, 31) for *_, r in found]
    flat = warc.zipped([("archive/x.warc", b"".join(plain))])
    assert [r.name for r in warc.records(reading(flat), len(flat))] == [n for n, *_ in found]
    for name, body in (("archive/x.zst", b"x"), ("archive/x.warc.gz", found[0][2][:-9]), ("archive/x.warc", b"WARC/1.1")):
        odd = warc.zipped([(name, body)])
        with pytest.raises(ValueError):
            list(warc.records(reading(odd), len(odd)))


def test_tasks_read_files_by_ranges(spark, tmp_path):
    data = warc.packed([(f"urn:page:{k}", "u", warc.gzipped(warc.record("response", f"urn:page:{k}", "u", b"body" * k))) for k in range(30)])
    for k, path in enumerate([f"{tmp_path}/a/b.wacz", f"file://{tmp_path}/c.wacz", f"file:{tmp_path}/d.wacz"]):
        warc.put(path, data if k else data[:-40])
    paths = spark.createDataFrame([(f"{tmp_path}/{x}.wacz",) for x in ("a/b", "c", "d", "missing")], "path string")
    got = warc.ranged_records(paths).collect()
    assert sorted(r.path[-9:] for r in got if r.error) == ["/a/b.wacz", "ssing.wacz"[-9:]]
    assert sorted(r.record_id for r in got if not r.error) == sorted([f"urn:page:{k}" for k in range(30)] * 2)


def brute(rows, least=0):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        least_id = first.get(h or "") if len(data) >= least else None
        revisit = least_id is not None and least_id != p
        out.append((p, len(data), digest(data), "revisit" if revisit else "response", least_id if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("archive_bytes,least", [(8 << 20, 0), (500, 0), (2000, 12)])
def test_pages_are_read_back(spark, archive_bytes, least):
    rnd = random.Random(1)
    bodies = [None, "", "<p>é</p>", "x" * 100_000, "WARC/1.1\r\n\r\n", *("y" * rnd.randint(1, 30) for _ in range(20))]
    rows = [(k, f"http://h/{k} \n\r ü", rnd.choice(bodies)) for k in range(150)] + [(3, "dup", "x"), (3, "dup", "x"), (900, "later", "x"), (None, None, "x"), (None, None, "only null ids have this")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, refers_to string, size int")
    got = warc.page_records(pages, least, archive_bytes).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, least)


def test_broken_archives_and_empty_tables(spark):
    good = warc.packed([("urn:page:1", "u", warc.gzipped(warc.record("response", "urn:page:1", "u", b"body")))])
    bad = good[:-30]
    forged = warc.packed([("urn:page:1", "u", warc.gzipped(warc.record("response", "urn:page:1", "u", b"body").replace(b"body", b"bodY")))])
    files = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad)), ("none", None), ("forged", bytearray(forged))], "path string, content binary")
    got = {r.path: r for r in warc.archive_records(files).collect()}
    assert bytes(got["good"].payload) == b"body" and not got["good"].error
    assert got["bad"].error and got["none"].error and "digest" in got["forged"].error
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(pages).collect() == []


def test_forged_archives_give_an_error_row():
    import json
    import struct

    page = warc.gzipped(warc.record("response", "urn:page:1", "http://x", b"words"))
    good = warc.packed([("urn:page:1", "http://x", page)])
    wide = warc.zipped([("archive/data.warc.gz", page)], True)
    end = wide.rindex(warc.END64)
    forged = []
    for length, offset in ((1 << 36, 0), (1 << 62, 0), ((1 << 64) - 1, 0), (10, (1 << 64) - 1)):
        forged.append(wide[: end + 40] + struct.pack("<QQ", length, offset) + wide[end + 56 :])
    for entry in ({"filename": "data.warc.gz", "offset": None, "length": "5"}, {"filename": None, "offset": 0, "length": 5}, {"filename": "data.warc.gz", "offset": -4, "length": 9}, {"filename": "data.warc.gz", "offset": 0, "length": 1 << 70}, {}):
        forged.append(warc.zipped([("archive/data.warc.gz", page), ("indexes/index.cdxj", f"x 1 {json.dumps(entry)}\n".encode())]))
    forged += [good[:-9], b"", wide.replace(warc.LOCAL, b"PKxx", 1)]
    rnd = random.Random(3)
    for _ in range(300):
        data = bytearray(rnd.choice([good, wide]))
        for _ in range(rnd.randint(1, 12)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        forged.append(bytes(data))
    for k, data in enumerate(forged):
        rows = [r for batch in warc.tabled(iter([("p", warc.records(reading(data), len(data)))])) for r in batch.to_pylist()]
        assert k >= 12 or rows[-1]["error"], (k, rows)  # those of random bytes end without an exception


def test_inflation_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "MOST", 1 << 20)
    bomb = warc.gzipped(warc.record("response", "urn:page:1", "http://x", bytes(3 << 20)))
    for data in (warc.packed([("urn:page:1", "http://x", bomb)]), warc.zipped([("archive/x.warc.gz", bomb)])):
        (row,) = [r for batch in warc.tabled(iter([("p", warc.records(reading(data), len(data)))])) for r in batch.to_pylist()]
        assert "inflates" in row["error"]
    many = b"".join(warc.gzipped(warc.record("response", f"urn:page:{k}", "http://x", bytes(600_000))) for k in range(4))
    data = warc.zipped([("archive/x.warc.gz", many)])
    assert len(list(warc.records(reading(data), len(data)))) == 4
