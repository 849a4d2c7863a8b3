"""PDF files from tables of words, rules and bars; ``pdf`` reads them back.

Layouts: ``plain`` (a table of references, inflatable content), ``packed`` (objects in object streams, references in a stream with
predicted rows), ``coded`` (content as LZW codes in base 85, references at the end of a longer chain). A file is one row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.batches import together
from querent.sources.pdfobjects import Name, Ref, Stream, dumped

KINDS = ("plain", "packed", "coded")
PAGE = ("width", "height", "rules", "bars")
# Width and depth of the font that words are written in, in ems.
EM, DEPTH = 0.6, 0.157


def lzw_literals(data: bytes) -> bytes:
    """LZW codes of single bytes; the table is cleared after 199 of them, which is before codes grow beyond nine bits and at a whole byte."""
    whole = len(data) // 199
    codes = np.full((whole, 200), 256, np.uint16)
    codes[:, 1:] = np.frombuffer(data, np.uint8, whole * 199).reshape(whole, 199)
    codes = np.concatenate([codes.ravel(), [256], np.frombuffer(data, np.uint8, offset=whole * 199), [257]]).astype(">u2")
    return np.packbits(np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)[:, 7:]).tobytes()


def base85(data: bytes) -> bytes:
    """Bytes as digits of 85; zeros, which have a short form, are left to ``base64``."""
    short = -len(data) % 4
    words = np.frombuffer(data + bytes(short), ">u4").astype(np.uint32)
    if not words.all():
        return base64.a85encode(data)
    digits = np.empty((len(words), 5), np.uint8)
    for k in range(4, -1, -1):
        above = words // np.uint32(85)
        digits[:, k], words = words - above * np.uint32(85) + np.uint32(33), above
    out = digits.tobytes()
    return out[:-short] if short else out


class Shown(dict):
    """Numbers as they are written, each worked out once."""

    def __init__(self, digits: int):
        self.digits = digits

    def __missing__(self, value: float) -> str:
        self[value] = out = f"{value:.{self.digits}f}"
        return out


class Codes(dict):
    """Numbers of characters from 1, in the order in which they are met, and ``words`` as the numbers of their characters."""

    def __init__(self):
        self.named: dict[str, str] = {}
        self.words: dict[str, str] = {}

    def word(self, text: str) -> str:
        for c in text:
            if c not in self.named:
                self.named[c] = "%04X" % self.setdefault(c, len(self) + 1)
        self.words[text] = out = "".join([self.named[c] for c in text])
        return out


def columns(words: list[dict] | dict) -> dict:
    """The words of a page as columns."""
    if isinstance(words, dict):
        return words
    return {"text": [w["text"] for w in words]} | {n: np.array([w[n] for w in words], float) for n in ("x0", "x1", "top", "bottom")}


def content(page: dict, codes: Codes) -> bytes:
    """The operators that draw a page; characters are written by their number in ``codes``."""
    out, height, words = [], page["height"], columns(page["words"])
    four, six = Shown(4), Shown(6)
    if texts := words["text"]:
        size = words["bottom"] - words["top"]
        room = np.array([len(t) for t in texts]) * EM * size
        if not room.all():
            raise ValueError("a word without a size")
        stretch, y = (words["x1"] - words["x0"]) / room * 100, height - words["top"] - size * (1 - DEPTH)
        raws = [codes.words.get(t) or codes.word(t) for t in texts]
        shown = zip(*([shown[v] for v in c.tolist()] for shown, c in ((four, size), (six, stretch), (four, words["x0"]), (four, y))), raws, strict=True)
        out = [f"BT /F1 {a} Tf {b} Tz 1 0 0 1 {c} {d} Tm <{raw}> Tj ET" for a, b, c, d, raw in shown]
    for r in page["rules"]:
        y = height - r["top"] - r["height"]
        out.append(f"{r['x0']:.4f} {y:.4f} m {r['x1']:.4f} {y:.4f} l S" if not r["height"] else f"{r['x0']:.4f} {y:.4f} {r['x1'] - r['x0']:.4f} {r['height']:.4f} re f")
    out += [f"{b['x']:.4f} {height - b['top']:.4f} m {b['x']:.4f} {height - b['bottom']:.4f} l S" for b in page["bars"]]
    return "\n".join(out).encode()


def code_map(codes: dict[str, int]) -> bytes:
    """The map from numbers to characters."""
    rows, names = [], [(n, c) for c, n in codes.items()]
    for at in range(0, len(names), 100):
        own = names[at : at + 100]
        rows += [f"{len(own)} beginbfchar", *(f"<{n:04X}> <{c.encode('utf-16-be').hex()}>" for n, c in own), "endbfchar"]
    return "\n".join(["begincmap", "1 begincodespacerange <0000> <FFFF> endcodespacerange", *rows, "endcmap"]).encode()


def pdf_bytes(pages: list[dict], kind: str) -> bytes:
    """A file of ``pages`` (width, height, words, rules, bars)."""
    name, codes = Name, Codes()
    contents = [content(p, codes) for p in pages]
    objects: dict[int, object] = {
        1: {name("Type"): name("Catalog"), name("Pages"): Ref(2)},
        2: {name("Type"): name("Pages"), name("Count"): len(pages), name("Kids"): [Ref(10 + 2 * k) for k in range(len(pages))], name("Resources"): {name("Font"): {name("F1"): Ref(3)}}},
        3: {name("Type"): name("Font"), name("Subtype"): name("Type0"), name("BaseFont"): name("Courier"), name("Encoding"): name("Identity-H"), name("DescendantFonts"): [Ref(4)], name("ToUnicode"): Ref(6)},
        4: {name("Type"): name("Font"), name("Subtype"): name("CIDFontType2"), name("BaseFont"): name("Courier"), name("DW"): EM * 1000, name("FontDescriptor"): Ref(5)},
        5: {name("Type"): name("FontDescriptor"), name("Descent"): -DEPTH * 1000},
        6: Stream({name("Filter"): name("FlateDecode")}, zlib.compress(code_map(codes))),
    }
    for k, (page, data) in enumerate(zip(pages, contents, strict=True)):
        objects[10 + 2 * k] = {name("Type"): name("Page"), name("Parent"): Ref(2), name("MediaBox"): [0, 0, page["width"], page["height"]], name("Contents"): Ref(11 + 2 * k)}
        if kind == "coded":
            objects[11 + 2 * k] = Stream({name("Filter"): [name("ASCII85Decode"), name("LZWDecode")]}, base85(lzw_literals(data)) + b"~>")
        else:
            objects[11 + 2 * k] = Stream({name("Filter"): name("FlateDecode")}, zlib.compress(data, 1))
    return packed(objects) if kind == "packed" else plain(objects, kind == "coded")


def plain(objects: dict[int, object], halves: bool) -> bytes:
    """Objects and a table of references, in two parts linked to each other if ``halves``."""
    out, places, before = bytearray(b"%PDF-1.4\n"), {}, None
    numbers = list(objects)
    cut = len(numbers) // 2
    for own in (numbers[:cut], numbers[cut:]) if halves else (numbers,):
        for n in own:
            places[n] = len(out)
            out += b"%d 0 obj\n" % n + dumped(objects[n]) + b"\nendobj\n"
        begin = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, places[n]) for n in own)
        entries = {Name("Size"): max(objects) + 1, Name("Root"): Ref(1)} | ({Name("Prev"): before} if before is not None else {})
        out += b"trailer\n" + dumped(entries) + b"\nstartxref\n%d\n%%%%EOF\n" % begin
        before = begin
    return bytes(out)


def packed(objects: dict[int, object]) -> bytes:
    """Objects without streams in one object stream, and a stream of references whose rows are differences to those above."""
    out, rows = bytearray(b"%PDF-1.5\n"), {}
    inner = {n: dumped(v) for n, v in objects.items() if not isinstance(v, Stream)}
    holder = max(objects) + 1
    head, at = [], 0
    for k, (n, body) in enumerate(inner.items()):
        head.append(b"%d %d" % (n, at))
        rows[n] = (2, holder, k)
        at += len(body) + 1
    start = b" ".join(head) + b"\n"
    held = Stream({Name("Type"): Name("ObjStm"), Name("N"): len(inner), Name("First"): len(start), Name("Filter"): Name("FlateDecode")}, zlib.compress(start + b"\n".join(inner.values())))
    for n, v in [*((n, v) for n, v in objects.items() if isinstance(v, Stream)), (holder, held)]:
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + dumped(v) + b"\nendobj\n"
    begin = len(out)
    rows[holder + 1] = (1, begin, 0)
    lines, above = bytearray(), bytes(7)
    for n in range(holder + 2):
        kind, place, k = rows.get(n, (0, 0, 0))
        row = bytes([kind]) + place.to_bytes(4, "big") + k.to_bytes(2, "big")
        lines += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    entries = {Name("Type"): Name("XRef"), Name("Size"): holder + 2, Name("W"): [1, 4, 2], Name("Root"): Ref(1), Name("Filter"): Name("FlateDecode"), Name("DecodeParms"): {Name("Predictor"): 12, Name("Columns"): 7}}
    out += b"%d 0 obj\n" % (holder + 1) + dumped(Stream(entries, zlib.compress(bytes(lines)))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % begin
    return bytes(out)


KEY = ("doc_id", "page")
WORD, RULE, BAR = ("top", "x0", "x1", "bottom", "text"), ("top", "x0", "x1", "height"), ("x", "top", "bottom")


def placed(rows: DataFrame, name: str | None = None, *columns: str) -> DataFrame:
    """Rows of pages or what stands on them, as ``drawn`` takes them."""
    size = [(F.col(n).cast("double") if name is None else F.lit(None).cast("double")).alias(n) for n in ("width", "height")]
    return rows.select(*KEY, *size, *([F.struct(*columns).alias(name)] if name else []))


def pdf_files(words: DataFrame, rules: DataFrame, pages: DataFrame, bars: DataFrame) -> DataFrame:
    """(source, content): a file for each doc_id, its pages in order; the layout goes by the crc32 of doc_id."""
    rows = placed(pages)
    for own in (placed(words, "word", *WORD), placed(rules, "rule", *RULE), placed(bars, "bar", *BAR)):
        rows = rows.unionByName(own, allowMissingColumns=True)
    return drawn(rows)


def drawn(rows: DataFrame) -> DataFrame:
    """``pdf_files`` of (doc_id, page, width, height, word, rule, bar), where each may be null; pages without a width are left out.

    All rows of a document meet by one shuffle, and its pages and its file are made in the task.
    """
    listed = [F.array_sort(F.collect_list(n)).alias(f"{n}s") for n in ("word", "rule", "bar")]
    held = rows.repartition("doc_id").groupBy(*KEY).agg(F.max("width").alias("width"), F.max("height").alias("height"), *listed).where("width IS NOT NULL")
    docs = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "words", "rules", "bars"))).alias("pages"))
    docs = docs.select(F.col("doc_id").cast("string").alias("source"), "pages")
    docs = docs.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (F.crc32(F.col("source").cast("binary")) % len(KINDS) + 1).cast("int")))

    def files(batches) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            held, starts = batch.column("pages").values, batch.column("pages").offsets.to_pylist()
            words, at = held.field("words").values, held.field("words").offsets.to_pylist()
            places = {n: words.field(n).to_numpy() for n in ("x0", "x1", "top", "bottom")}
            for k, (source, kind) in enumerate(zip(batch.column("source").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                first, n = starts[k], starts[k + 1] - starts[k]
                pages = [dict(zip(PAGE, own, strict=True)) for own in zip(*(held.field(name).slice(first, n).to_pylist() for name in PAGE), strict=True)]
                for page, a, b in zip(pages, at[first:], at[first + 1 : first + n + 1], strict=False):
                    page["words"] = {"text": words.field("text").slice(a, b - a).to_pylist()} | {name: own[a:b] for name, own in places.items()}
                yield source, pdf_bytes(pages, kind)

    def run(batches):
        return together(files(batches), lambda file: len(file[1]), lambda own: pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.string()), pa.array([c for _, c in own], pa.binary())], ["source", "content"]))

    return docs.mapInArrow(run, "source string, content binary")
