import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.operators import pages as whole_pages
from querent.sources import pdf, pdfwrite
from querent.sources.pdffonts import CodeMap, glyph_text
from querent.sources.pdfobjects import END, File, Name, Operator, PdfError, Reader, Ref, Stream, dumped, inflated, lzw, run_lengths, unpredicted


def lzw_encoded(data, early=1):
    """A full encoder, with growing codes."""
    out, table, width, piece = [], {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    out.append((256, 9))
    for b in data:
        both = piece + bytes([b])
        if both in table:
            piece = both
            continue
        out.append((table[piece], width))
        if size < 4096:
            table[both] = size
            size += 1
            width = min(12, max(9, (size - 1 + early).bit_length()))
        piece = bytes([b])
        if size == 4095:
            out.append((table[piece], width))
            out.append((256, min(12, max(9, (size + early).bit_length()))))
            table, width, size, piece = {bytes([k]): k for k in range(256)}, 9, 258, b""
    if piece:
        out.append((table[piece], width))
        width = min(12, max(9, (size + early).bit_length()))
    out.append((257, width))
    bits = n = 0
    for code, w in out:
        bits, n = bits << w | code, n + w
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 1))
def test_lzw(data, early):
    data = data * 3
    assert lzw(lzw_encoded(data, early), early) == data
    assert lzw(pdfwrite.lzw_literals(data), 1) == data


def test_filters_undo_what_was_done():
    assert run_lengths(b"\x02abc\xfed\x80rest") == b"abcddd"
    rows = bytes(range(12))
    assert unpredicted(bytes([1, 1, 1, 1, 5, 5, 5, 5]), {"Predictor": 2, "Columns": 4}) == bytes([1, 2, 3, 4, 5, 10, 15, 20])
    for rule, line in ((0, rows[4:8]), (1, bytes([4, 1, 1, 1])), (2, bytes([4, 4, 4, 4])), (3, bytes([4, 3, 3, 3])), (4, bytes([4, 1, 1, 1]))):
        got = unpredicted(bytes([0]) + rows[:4] + bytes([rule]) + line, {"Predictor": 15, "Columns": 4})
        if rule in (0, 1, 2):
            assert got == rows[:8]
    with pytest.raises(PdfError):
        inflated(zlib.compress(bytes(65 << 20)))
    assert inflated(zlib.compress(b"some words")[:-3]) == b"some words"


values = st.recursive(
    st.one_of(st.integers(-(10**9), 10**9), st.booleans(), st.none(), st.binary(max_size=12), st.text(alphabet="aB #/1é", min_size=1, max_size=6).map(Name), st.integers(1, 99).map(Ref)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(alphabet="abc(", min_size=1, max_size=4).map(Name), inner, max_size=4)),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(values)
def test_values_are_read_as_they_were_written(value):
    assert Reader(dumped(value)).value() == value


def test_syntax():
    reader = Reader(rb"% note" b"\n" rb"(a\(b\)\n\101(in)\\) <48 6> /A#20b -.5 +7 true [1 2 R 3 0 R] << /K (v) /L << >> >> BT")
    assert [reader.value() for _ in range(9)] == [b"a(b)\nA(in)\\", b"H`", "A b", -0.5, 7, True, [Ref(1), Ref(3)], {"K": b"v", "L": {}}, b"BT"]
    assert reader.value() is END
    assert isinstance(Reader(b"BT").value(), Operator)
    with pytest.raises(PdfError):
        Reader(b"[" * 5000).value()


def test_glyph_names_and_maps():
    assert [glyph_text(n) for n in ("A", "eacute", "Scaron", "fi", "uni00E9", "u1F600", "alpha", "Omega", "f_i", "a.alt", "none such")] == ["A", "é", "Š", "fi", "é", "😀", "α", "Ω", "fi", "a", None]
    found = CodeMap(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <01> <03> <0041> <8001> <8002> [<0062> <00630064>] endbfrange 1 beginbfchar <05> <D83DDE00> endbfchar")
    assert found.text == {1: "A", 2: "B", 3: "C", 0x8001: "b", 0x8002: "cd", 5: "😀"}
    assert list(found.codes(b"\x01\x80\x01\x05")) == [(1, 1), (0x8001, 2), (5, 1)]


def made_up(rnd, words=40):
    page = {"width": 600.0, "height": 780.0, "words": [], "rules": [], "bars": []}
    for k in range(words):
        text = "".join(rnd.choice("abcXYZ12.,éß日Ω😀(\\") for _ in range(rnd.randint(1, 9)))
        x0, top, size = 30.0 + 130 * (k % 4), 30.0 + 15 * (k // 4), rnd.choice([8.0, 9.0, 10.0])
        page["words"].append({"text": text, "x0": x0, "x1": x0 + 6.0 * len(text), "top": top, "bottom": top + size})
    for _ in range(rnd.randint(0, 5)):
        page["rules"].append({"x0": 50.0, "x1": 50.0 + rnd.randint(100, 400), "top": float(rnd.randint(400, 700)), "height": 0.0})
        page["bars"].append({"x": float(rnd.randint(50, 500)), "top": 400.0, "bottom": 400.0 + rnd.randint(10, 300)})
    return page


def read(data, size=pdf.PAGES):
    return [row for piece in pdf.slices_of("f", data, size) for row in pdf.pages_of(piece)]


def placed(items, *keys):
    return sorted(tuple(round(i[k], 3) if isinstance(i[k], float) else i[k] for k in keys) for i in items)


@pytest.mark.parametrize("kind", pdfwrite.KINDS)
def test_pages_are_read_as_they_were_written(kind):
    rnd = random.Random(4)
    pages = [made_up(rnd) for _ in range(37)] + [{"width": 100.0, "height": 200.0, "words": [], "rules": [], "bars": []}]
    for size in (1, 16):
        got = read(pdfwrite.pdf_bytes(pages, kind), size)
        assert [r["page"] for r in got] == list(range(1, 39)) and {r["error"] for r in got} == {None}
        for row, page in zip(got, pages, strict=True):
            assert (row["width"], row["height"]) == (page["width"], page["height"])
            for name, keys in (("words", ("text", "x0", "x1", "top", "bottom")), ("rules", ("x0", "x1", "top", "height")), ("bars", ("x", "top", "bottom"))):
                assert placed(row[name], *keys) == placed(page[name], *keys)


def one_page(content, resources=b"<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >> >>", page=b"", more=()):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources " + resources + page + b" >>", b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream", *more]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n" % k + o + b"\nendobj" for k, o in enumerate(objects, 1))


def words_of(data):
    (row,) = read(data)
    assert row["error"] is None
    return [(w["text"], round(w["x0"], 2), round(w["x1"], 2), round(w["top"], 2), w["upright"]) for w in row["words"]]


def test_text_operators():
    # Helvetica: H 722, i 222, space 278; the file has no table of references at all
    assert words_of(one_page(b"BT /F1 10 Tf 20 50 Td (Hi Hi) Tj ET")) == [("Hi", 20, 29.44, 42.07, True), ("Hi", 32.22, 41.66, 42.07, True)]
    assert words_of(one_page(b"BT /F1 10 Tf 20 50 Td [(H) -50 (i) -300 (i)] TJ ET")) == [("Hi", 20, 29.94, 42.07, True), ("i", 32.94, 35.16, 42.07, True)]
    assert words_of(one_page(b"BT /F1 10 Tf 12 TL 20 50 Td (H) Tj T* (i) Tj (i) ' ET")) == [("H", 20, 27.22, 42.07, True), ("i", 20, 22.22, 54.07, True), ("i", 20, 22.22, 66.07, True)]
    assert words_of(one_page(b"q 2 0 0 2 0 0 cm BT /F1 5 Tf 50 Tz 3 Tc 10 25 Td (Hi) Tj ET Q BT /F1 10 Tf (i) Tj ET"))[:1] == [("H", 20, 23.61, 42.07, True)]
    assert words_of(one_page(b"BT /F1 10 Tf 0 1 -1 0 50 20 Tm (Hi) Tj ET")) == [("iH", 42.07, 52.07, 70.56, False)]  # from the top down
    assert words_of(one_page(b"BT /F1 10 Tf 0 1 -1 0 50 20 Tm (Hi) Tj ET", page=b"/Rotate 90")) == [("Hi", 20, 29.44, 42.07, True)]
    assert words_of(one_page(b"BT /F1 10 Tf 20 50 Td (\\351\\223x\\224) Tj ET"))[0][0] == "é“x”"
    assert words_of(one_page(b"BI /W 1 /H 1 ID (( EI\nBT /F1 10 Tf 20 50 Td (i) Tj ET"))[0][0] == "i"


def test_forms_differences_and_type3():
    form = b"<< /Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 100 0] /Length 38 >>\nstream\nBT /F1 10 Tf 20 50 Td (H) Tj ET /Fm Do\nendstream"
    font = b"<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Some /FirstChar 72 /Widths [500] /Encoding << /Differences [72 /eacute /fi] >> >> >> /XObject << /Fm 5 0 R >> >>"
    (row,) = read(one_page(b"BT /F1 10 Tf 20 50 Td (H) Tj ET", font, more=(form,)))
    assert [(w["text"], w["x0"], w["x1"]) for w in row["words"]] == [("é", 20, 25)]
    (row,) = read(one_page(b"/Fm Do", font, more=(form,)))
    assert row["error"].startswith("PdfError: forms nested") and row["words"] == []
    (row,) = read(one_page(b"/Fm Do", font, more=(form.replace(b"/Fm Do", b"      "),)))
    assert [(w["text"], w["x0"]) for w in row["words"]] == [("é", 120)]
    type3 = b"<< /Font << /F1 << /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FirstChar 97 /Widths [50] /Encoding << /Differences [97 /a] >> >> >> >>"
    (row,) = read(one_page(b"BT /F1 10 Tf 20 50 Td (aa) Tj ET", type3))
    assert [(w["text"], w["x0"], w["x1"]) for w in row["words"]] == [("aa", 20, 30)]


def test_lines_and_rectangles():
    (row,) = read(one_page(b"10 20 m 110 20 l S 5 5 m 5 95 l S 20 30 100 40 re S 0 0 m 9 9 l S 1 1 m 2 2 3 3 90 1 c S 20 80 m 90 80 l n 30 90 50 1 re f"))
    assert placed(row["rules"], "x0", "x1", "top", "edge") == [(10, 110, 80, False), (20, 120, 30, True), (20, 120, 70, True), (30, 80, 9, True), (30, 80, 10, True)]
    assert placed(row["bars"], "x", "top", "bottom", "edge") == [(5, 5, 95, False), (20, 30, 70, True), (120, 30, 70, True)]


def test_broken_files_give_an_error_and_never_end_the_task(spark):
    whole = pdfwrite.pdf_bytes([made_up(random.Random(1)) for _ in range(3)], "packed")
    assert read(b"") == read(None) and read(b"")[0]["error"] == "PdfError: no PDF header"
    assert read(whole[: len(whole) // 3])[0]["error"]
    assert [r["error"] for r in read(whole.replace(b"/Root", b"/Encrypt 1 0 R /Root"))] == ["PdfError: an encrypted file"]
    lost = whole[: whole.rindex(b"startxref")] + b"startxref\n7\n%%EOF"
    assert [len(r["words"]) for r in read(lost)] == [40, 40, 40]
    loop = one_page(b"").replace(b"/Kids [3 0 R]", b"/Kids [2 0 R 2 0 R 3 0 R 3 0 R]")
    assert len(read(loop)) == 1
    bomb = zlib.compress(bytes(80 << 20))
    (row,) = read(one_page(b"").replace(b"<< /Length 0 >>\nstream\n", b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(bomb) + bomb))
    assert "inflates to more" in row["error"]
    rnd = random.Random(9)
    for kind in pdfwrite.KINDS:
        data = pdfwrite.pdf_bytes([made_up(rnd, 6)], kind)
        for _ in range(150):
            forged = bytearray(data)
            for _ in range(rnd.randint(1, 30)):
                forged[rnd.randrange(len(forged))] = rnd.randrange(256)
            for row in read(bytes(forged)):
                assert row["error"] is None or row["words"] == []
    files = spark.createDataFrame([("good", whole), ("bad", b"no"), ("none", None)], "source string, content binary")
    got = {(r.doc_id, r.page): (len(r.words), r.error) for r in pdf.pdf_pages(files, 2).collect()}
    assert got == {("good", 1): (40, None), ("good", 2): (40, None), ("good", 3): (40, None), ("bad", None): (0, "PdfError: no PDF header"), ("none", None): (0, "PdfError: no PDF header")}
    assert pdf.pdf_pages(files.limit(0)).collect() == []


def test_folder_and_page_texts(spark, tmp_path):
    words = [{"text": t, "x0": 50.0 + 60 * k, "x1": 80.0 + 60 * k, "top": 100.0, "bottom": 110.0} for k, t in enumerate("Plain words of the page".split())]
    page = {"width": 600.0, "height": 780.0, "words": words, "rules": [], "bars": []}
    (tmp_path / "a.pdf").write_bytes(pdfwrite.pdf_bytes([page, page], "plain"))
    (tmp_path / "b.txt").write_bytes(b"no pdf")
    tables = pdf.page_tables(pdf.read_pdf(spark, str(tmp_path)))
    texts = whole_pages.page_texts(tables.words, tables.rules, tables.pages, 600.0, tables.bars)
    assert sorted(map(tuple, texts.collect())) == [("a.pdf", k, "Plain words of the page") for k in (1, 2)]


def test_a_slice_leaves_pictures_and_font_programs_out():
    pages = one_page(b"BT /F1 10 Tf 20 50 Td (H) Tj ET", b"<< /Font << /F1 << /Type /Font /Subtype /TrueType /BaseFont /Helvetica /FontDescriptor << /FontFile2 5 0 R /Descent -200 >> >> >> /XObject << /Im 6 0 R >> >>", more=(b"<< /Length 5000 >>\nstream\n" + b"f" * 5000 + b"\nendstream", b"<< /Subtype /Image /Length 9000 >>\nstream\n" + b"i" * 9000 + b"\nendstream"))
    (piece,) = pdf.slices_of("f", pages)
    assert sum(map(len, piece["bodies"])) < 1000 and 5 not in piece["numbers"]
    file = File(pages)
    assert isinstance(file.get(Ref(6)), Stream) and len(file.get(Ref(6)).raw) == 9000


def test_documents_of_a_folder(spark, tmp_path):
    from querent.sources.files import read_documents

    cell = lambda text, k, row: {"text": text, "x0": 55.0 + 100 * k, "x1": 55.0 + 100 * k + 5 * len(text), "top": 103.0 + 14 * row, "bottom": 112.0 + 14 * row}
    table = [["model", "EM", "size"], ["alpha", "12.5", "7"], ["beta", "13.5", "9"], ["gamma", "14.5", "11"]]
    words = [cell(t, k, r) for r, row in enumerate(table) for k, t in enumerate(row)] + [cell("Below.", 0, 12)]
    rules = [{"x0": 50.0, "x1": 350.0, "top": 100.0 + 14 * r, "height": 0.0} for r in range(5)]
    bars = [{"x": 50.0 + 100 * k, "top": 100.0, "bottom": 156.0} for k in range(4)]
    column = [{"text": f"w{side}{k}", "x0": x, "x1": x + 60, "top": 60.0 + 14 * k, "bottom": 69.0 + 14 * k} for side, x in (("l", 100.0), ("l", 200.0), ("l", 300.0), ("r", 450.0), ("r", 550.0), ("r", 650.0)) for k in range(20)]
    pages = [{"width": 600.0, "height": 780.0, "words": words, "rules": rules, "bars": bars}, {"width": 800.0, "height": 780.0, "words": column, "rules": [], "bars": []}]
    (tmp_path / "a.pdf").write_bytes(pdfwrite.pdf_bytes(pages, "packed"))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "b.txt").write_text("Plain text.")
    rows = {(r.src_order, r.source, r.text) for r in read_documents(spark, str(tmp_path)).collect()}
    whole = next(t for _, s, t in rows if s == "a.pdf" and t.startswith("|"))
    assert whole.startswith("| model | EM | size |\n| --- | --- | --- |\n| alpha | 12.5 | 7 |")
    second = whole.split("Below.")[1].split()
    assert [w[1] for w in second] == ["l"] * 60 + ["r"] * 60  # the left column first, by this page's own width
    assert any("alpha" in t and "12.5" in t and "|" not in t for _, s, t in rows if s == "a.pdf") and (2, "b.txt", "Plain text.") in rows
    assert {s for _, s, _ in rows} == {"a.pdf", "b.txt"}


def test_plain_content_is_read_in_runs(monkeypatch):
    """Tokens of plain content don't go through ``Reader``, and equal strings are looked up once."""
    words = [{"text": f"word{k % 7}", "x0": 50.0 * (k % 10), "x1": 50.0 * (k % 10) + 40, "top": 14.0 * (k // 10), "bottom": 14.0 * (k // 10) + 9} for k in range(400)]
    data = pdfwrite.pdf_bytes([{"width": 600.0, "height": 700.0, "words": words, "rules": [], "bars": []}], "coded")
    (piece,) = pdf.slices_of("f", data)
    calls = []
    value = Reader.value
    monkeypatch.setattr(Reader, "value", lambda self, depth=0: (calls.append(1), value(self, depth))[1])
    (row,) = pdf.pages_of(piece)
    assert [w["text"] for w in row["words"]] == [w["text"] for w in words]
    assert len(calls) < 200


RUNS = (
    b"BT /F1 10 Tf 1 0 0 1 20 50 Tm (Hi) Tj ET\nBT /F1 10 Tf 1 0 0 1 60 50 Tm (iH) Tj ET BT /F1 10. Tf 1 0 0 1 +.5 50 Tm <48> Tj ET",
    b"BT /F1 10 Tf 50 Tz 1 0 0 1 20 50 Tm <4869> Tj ET\nBT /F1 12 Tf 80 Tz 1 0 0 1 60 50 Tm <6948> Tj ET",
    b"3 Tc 2 Tw 1 Ts q 2 0 0 2 0 0 cm BT /F1 5 Tf 1 0 0 1 5 40 Tm (H i) Tj ET BT 1 0 0 1 30 30 Tm (i H) Tj ET BT 90 Tz (Hi) Tj ET Q BT /F1 9 Tf (i) Tj ET (H) Tj",
    b"BT /F2 7 Tf 1 0 0 1 20 50 Tm <481> Tj ET BT /F1 10 Tf 0 1 -1 0 60 50 Tm <> Tj ET BT /F0 10 Tf (i) Tj ET BT (H) Tj ET",
    b"BT /F1 10 Tf 1 0 0 1 20 50 Tm <4869> Tj ET\n" * 3 + b"BT /F1 10 Tf 1 0 0 1 20 50 Td (Hi) Tj ET 1 1 m 9 1 l S",
)


@pytest.mark.parametrize("content", RUNS)
def test_runs_of_text_objects_are_read_as_each_object_is(content, monkeypatch):
    fonts = b"<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> /F2 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >>"
    read_shown = pdf.Page.shown
    calls = []
    monkeypatch.setattr(pdf.Page, "shown", lambda self, *a: (calls.append(1), read_shown(self, *a))[1])
    (got,) = read(one_page(content, fonts))
    in_runs = len(calls)
    monkeypatch.setattr(pdf, "RUN", pdf.re.compile(rb"(?!)"))
    (want,) = read(one_page(content, fonts))
    assert in_runs < (len(calls) - in_runs) / 1.9 and got["error"] is None and want["words"]
    assert [w["text"] for w in got["words"]] == [w["text"] for w in want["words"]]
    for a, b in zip(got["words"], want["words"], strict=True):
        assert [a[k] for k in ("x0", "x1", "top", "bottom", "size")] == pytest.approx([b[k] for k in ("x0", "x1", "top", "bottom", "size")], abs=1e-9)
    assert got["rules"] == want["rules"]


def test_a_document_meets_by_one_shuffle(spark):
    rows = [(d, p, t, 50.0 + 60 * k, 90.0 + 60 * k, 100.0, 110.0) for d in (1, 2, 3) for p in (0, 1) for k, t in enumerate("four words of it".split())]
    words = spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double")
    pages = words.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "600 AS width", "700 AS height").where("doc_id != 3 OR page = 0").collect()
    pages = spark.createDataFrame(pages, "doc_id long, page int, width int, height int")
    none = spark.createDataFrame([], "doc_id long, page int, x0 double, x1 double, top double, height double, x double, bottom double")
    files = pdfwrite.pdf_files(words, none, pages, none)
    assert files._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.doc_id, r.page): (r.width, len(r.words), r.error) for r in pdf.pdf_pages(files).collect()}
    assert got == {(str(d), p): (600.0, 4, None) for d in (1, 2, 3) for p in (1, 2) if (d, p) != (3, 2)}


def test_runs_of_lines_are_read_as_each_line_is(monkeypatch):
    content = b"10 20 m 110 20 l S 5 5 m 5 95 l S\n20 30 100 40 re S 30 90 50 1 re f q 2 0 0 2 0 0 cm 1 1 m 9 1 l S 1 2 m 9. 2 l S 1 3 m +9 3 l S Q 3 3 m 7 3 l 10 20 m 30 20 l S 1 4 m 4 9 l S 1 5 m 9 5 l n 2 2 m 8 2 l S 3 8 m 9 8 l f"
    calls = []
    monkeypatch.setattr(pdf.Page, "lines", lambda self, found, ctm, own=pdf.Page.lines: (calls.append(len(found)), own(self, found, ctm))[1])
    (got,) = read(one_page(content))
    monkeypatch.setattr(pdf, "LINES", pdf.re.compile(rb"(?!)"))
    (want,) = read(one_page(content))
    assert (got["rules"], got["bars"], got["error"]) == (want["rules"], want["bars"], None) and len(want["rules"]) > 8
    assert calls == [4, 3, 2]
