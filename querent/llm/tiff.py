"""TIFF as a column: image directories, strips and tiles, PackBits, LZW and deflate, predictors, one row per page.

``tiff_pages`` reads a binary column. The directory chain is walked by offset (classic files and those of 64-bit offsets,
either byte order; a chain that returns to itself ends). Strips or tiles are decoded, predictors undone, tiles cut to
the image, and separate planes woven together, so ``samples`` holds the page's samples row by row, the low byte first.
``tiff_written`` stores text as a page of 8-bit samples, in one of ``LAYOUTS`` that the text's checksum picks, so strips,
tiles, predictors, planes and all three codecs stand in any larger table.

Nothing that a file says is taken on trust: values of tags must lie within the file, all strips together can't be longer
than it, a directory chain can't have more entries than fit, and decoding stops at the bytes that a strip or tile holds.

Nulls and edges: a null or empty file has no pages. A file that can't be read gives one row with the error and no page.
A null text is stored as an empty one; a text is one page whatever its length, unless ``page_rows`` asks for several.
Repeated rows give repeated rows, an empty table none; columns that aren't asked for are left out, and one that is asked
for under the name of a page's column is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.llm.arrow import by_columns, slices

# Fixed values of the format: tags, compression kinds, and the struct codes of field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END = 256, 257
#: The most bytes that a byte of a codec can stand for.
MOST = {PACKBITS: 64, LZW: 3641, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Tags that are read; all others are passed over.
USED = frozenset((WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES))


def unpackbits(data: bytes, limit: float = float("inf")) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, what is between them as it is, both in packets of up to 128 bytes."""
    array = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(np.concatenate([[True], array[1:] != array[:-1], [True]])) if len(array) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(cuts) >= 3)
    out, at = bytearray(), 0

    def literal(start, stop):
        for a in range(start, stop, 128):
            part = data[a : min(a + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, stop in zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
        literal(at, start)
        for a in range(start, stop, 128):
            n = min(128, stop - a)
            out.extend(bytes([257 - n if n > 1 else 0, data[a]]))
        at = stop
    literal(at, len(data))
    return bytes(out)


def unlzw(data: bytes, limit: float = float("inf")) -> bytes:
    """Codes from the high bit on, 9 to 12 bits wide, widened one code early."""
    out, table, previous = bytearray(), [], None
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END or len(out) >= limit:
            break
        if code == CLEAR:
            table, width, previous = list(base), 9, None
            continue
        if previous is None:
            table = table or list(base)
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    if not data:
        return joined_codes([CLEAR, END], [9, 9])
    codes, widths, width = [CLEAR], [9], 9
    table: dict[int, int] = {}  # a known string's code and the next byte, as one number
    following, code = 258, data[0]
    for byte in memoryview(data)[1:]:
        longer = code << 8 | byte
        if (known := table.get(longer)) is not None:
            code = known
            continue
        codes.append(code)
        widths.append(width)
        table[longer], following, code = following, following + 1, byte
        if following == 4095:
            codes.append(CLEAR)
            widths.append(width)
            table, following, width = {}, 258, 9
        elif following >= 1 << width:
            width += 1
    codes.append(code)
    widths.append(width)
    if following + 1 >= 1 << width and width < 12:
        width += 1
    return joined_codes([*codes, END], [*widths, width])


def joined_codes(codes: list[int], widths: list[int]) -> bytes:
    """The codes one after the other, each by its high bit first."""
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - np.array(widths)[:, None]]).tobytes()


def unpacked(data: bytes, kind: int, need: int) -> bytes:
    """The first ``need`` bytes of a strip or tile; an error if it has fewer."""
    if need > MOST.get(kind, 1) * len(data):
        raise ValueError("a strip or tile can't hold that much")
    if kind == NONE:
        out = data
    elif kind == PACKBITS:
        out = unpackbits(data, need)
    elif kind == LZW:
        out = unlzw(data, need)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, need) if need else b""
    else:
        raise ValueError(f"compression {kind} is not supported")
    if len(out) < need:
        raise ValueError("a strip or tile holds too little")
    return out[:need]


@dataclass
class Page:
    page: int
    width: int
    height: int
    bands: int
    bits: int
    compression: int
    tiled: bool
    samples: bytes


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if self.order is None:
            raise ValueError("no TIFF header")
        version = self.unpack("H", 2)[0]
        if version not in (42, 43):
            raise ValueError(f"TIFF version {version}")
        self.big = version == 43

    def unpack(self, code: str, at: int) -> tuple:
        return struct.unpack_from(self.order + code, self.data, at)

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen, room = self.unpack("Q" if self.big else "I", 8 if self.big else 4)[0], set(), len(self.data)
        while at and at not in seen:
            seen.add(at)
            count, at = self.unpack("Q" if self.big else "H", at)[0], at + (8 if self.big else 2)
            room -= 12 * count
            if room < 0:
                raise ValueError("more directory entries than the file can hold")
            tags: dict[int, tuple] = {}
            held = 0
            for _ in range(count):
                tag, kind, n = self.unpack("HHQ" if self.big else "HHI", at)
                inline = 8 if self.big else 4
                place = at + (12 if self.big else 8)
                if tag in USED and kind in CODES:
                    code = CODES[kind]
                    size = n * struct.calcsize("<" + code)
                    held += size
                    if held > len(self.data):
                        raise ValueError("a tag has more values than the file can hold")
                    if size > inline:
                        place = self.unpack("Q" if self.big else "I", place)[0]
                    tags[tag] = self.unpack(f"{n}s" if code == "s" else code * n if len(code) == 2 else f"{n}{code}", place)
                at += 20 if self.big else 12
            yield tags
            at = self.unpack("Q" if self.big else "I", at)[0]

    def pages(self) -> Iterator[Page]:
        for k, tags in enumerate(self.directories()):
            yield self.page(k, tags)

    def block(self, data: bytes, kind: int, predictor: int, rows: int, width: int, bands: int, bits: int) -> np.ndarray:
        """A decoded strip or tile as rows x (width x bands) samples, or x bytes where samples are not whole bytes."""
        if bits % 8:
            line = (width * bands * bits + 7) // 8
            if predictor != 1:
                raise ValueError("a predictor needs whole bytes")
            return np.frombuffer(unpacked(data, kind, rows * line), np.uint8).reshape(rows, line)
        size = bits // 8
        raw = unpacked(data, kind, rows * width * bands * size)
        if predictor == 3:  # bytes of a row differ in sequence, planes of high bytes first
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, width * size, bands), axis=1, dtype=np.uint8).reshape(rows, size, width * bands)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, width * bands).astype(f"<u{size}")
        array = np.frombuffer(raw, f"{self.order}u{size}").reshape(rows, width, bands)
        if predictor == 2:
            array = np.cumsum(array, axis=1, dtype=array.dtype.newbyteorder("=")).astype(array.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        return array.reshape(rows, width * bands).astype(f"<u{size}", copy=False)

    def page(self, number: int, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height, bands = tags[WIDTH][0], tags[LENGTH][0], one(SAMPLES, 1)
        depths = set(tags.get(BITS, (1,)))
        if len(depths) > 1:
            raise ValueError("bands of different depths are not supported")
        bits, kind, predictor, planes = depths.pop(), one(COMPRESSION, NONE), one(PREDICTOR, 1), bands if one(PLANAR, 1) == 2 else 1
        own = bands // planes
        if min(width, height, bands, bits) < 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise ValueError(f"a page of {width} x {height} x {bands} samples of {bits} bits is not supported")
        tiled = TILE_OFFSETS in tags
        wide, high = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        if min(wide, high) < 1:
            raise ValueError("strips or tiles are empty")
        across, down = -(-width // wide), -(-height // high)
        if min(len(offsets), len(sizes)) < planes * across * down:
            raise ValueError("strips or tiles are missing")
        if sum(sizes[: planes * across * down]) > len(self.data):
            raise ValueError("strips or tiles are longer than the file")
        if tiled and bits % 8:
            raise ValueError("tiles need whole bytes")
        layers = []
        for p in range(planes):
            lines = []
            for y in range(down):
                rows = high if tiled else min(high, height - y * high)
                blocks = []
                for x in range(across):
                    k = (p * down + y) * across + x
                    data = self.data[offsets[k] : offsets[k] + sizes[k]]
                    if len(data) < sizes[k]:
                        raise ValueError("the file ends within a strip or tile")
                    blocks.append(self.block(data, kind, predictor, rows, wide, own, bits))
                lines.append(np.concatenate(blocks, axis=1)[: height - y * high] if len(blocks) > 1 else blocks[0][: height - y * high])
            layers.append(np.concatenate(lines) if len(lines) > 1 else lines[0])
            if tiled:
                layers[-1] = layers[-1][:, : width * own]
        whole = layers[0] if planes == 1 else np.stack([x.reshape(height, width) for x in layers], axis=2)
        return Page(number, width, height, bands, bits, kind, tiled, whole.tobytes())


def feature(page: Page) -> str:
    """Size, mean in thousandths, and an 8 x 8 map of the blocks that are brighter than the page, of the sample bytes."""
    array = np.frombuffer(page.samples, np.uint8)
    if not len(array):
        return f"{page.width}x{page.height}x{page.bands}:-:0"
    sums = np.add.reduceat(array, np.arange(64) * len(array) // 64, dtype=np.int64) if len(array) >= 64 else np.resize(array.astype(np.int64), 64)
    total = int(sums.sum())
    bits = int.from_bytes(np.packbits(sums * 64 > total).tobytes(), "big")
    return f"{page.width}x{page.height}x{page.bands}:{total * 1000 // len(array)}:{bits:016x}"


def written(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 512, tile: int = 0, order: str = "<", big: bool = False, planar: bool = False, level: int = 1) -> bytes:
    """A TIFF file of pages with shape (rows, width, bands) of unsigned samples."""
    pack = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, level)}[compression]
    out = bytearray({"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link, word = (8, "Q") if big else (4, "I")
    for page in pages:
        height, width, bands = page.shape
        blocks = []
        for plane in [page[:, :, k : k + 1] for k in range(bands)] if planar else [page]:
            if tile:
                padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, plane.shape[2]), page.dtype)
                padded[:height, :width] = plane
                parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
            else:
                parts = [plane[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
            for part in parts:
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                blocks.append(pack(part.astype(page.dtype.newbyteorder(order)).tobytes()))
        places = []
        for block in blocks:
            places.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        sizes = [len(b) for b in blocks]
        fields = [(WIDTH, "I", [width]), (LENGTH, "I", [height]), (BITS, "H", [page.dtype.itemsize * 8] * bands), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if bands == 3 else 1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [2 if planar else 1]), (PREDICTOR, "H", [predictor])]
        fields += [(TILE_WIDTH, "I", [tile]), (TILE_LENGTH, "I", [tile]), (TILE_OFFSETS, word, places), (TILE_BYTES, word, sizes)] if tile else [(STRIP_OFFSETS, word, places), (ROWS_PER_STRIP, "I", [rows_per_strip]), (STRIP_BYTES, word, sizes)]
        kinds, entries = {"H": 3, "I": 4, "Q": 16}, []
        for tag, code, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(data) > (8 if big else 4):
                data, at = struct.pack(order + word, len(out)), data
                out += at
            entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kinds[code], len(values)) + data.ljust(8 if big else 4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


#: Bytes of a row of stored text: 64 pixels of three bands.
LINE = 192
#: How texts are stored: compression, and what else ``written`` takes.
LAYOUTS: tuple[dict, ...] = (
    {"compression": DEFLATE, "predictor": 2},
    {"compression": PACKBITS, "tile": 64},
    {"compression": LZW, "rows_per_strip": 64},
    {"compression": DEFLATE, "tile": 64, "planar": True, "big": True},
)


def text_pages(text: str | None, page_rows: int | None = None) -> list[np.ndarray]:
    """The UTF-8 bytes as one page, or pages of ``page_rows`` rows, of 64 x 3 samples a row, filled up with spaces to a positive multiple of LINE."""
    data = (text or "").encode()
    data = data.ljust(max(LINE, -(-len(data) // LINE) * LINE), b" ")
    array = np.frombuffer(data, np.uint8).reshape(-1, 64, 3)
    return [array[y : y + page_rows] for y in range(0, len(array), page_rows)] if page_rows else [array]


def tiff_written(docs: DataFrame, page_rows: int | None = None, layouts: tuple[dict, ...] = LAYOUTS) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a TIFF file in the layout that the CRC-32 of its bytes picks."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work():
        def function(rows):
            sizes, media = [], []
            for text in rows["text"]:
                data = (text or "").encode()
                sizes.append(len(data))
                media.append(written(text_pages(text, page_rows), **layouts[zlib.crc32(data) % len(layouts)]))
            return {"doc_id": rows["doc_id"], "n_bytes": sizes, "media": media}

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)


PAGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "bands", "bits", "compression")] + [T.StructField("tiled", T.BooleanType()), T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])


def tiff_pages(files: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of every file in column ``media``, with the columns ``keep`` of its row."""
    if clash := {*keep} & {*PAGE.names}:
        raise ValueError(f"rename {sorted(clash)}: pages have such columns")
    schema = T.StructType([files.schema[c] for c in keep] + PAGE.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            found: dict[str, list] = {c: [] for c in schema.names}
            for row in part.to_pylist():
                data = row[media]
                rows = []
                try:
                    for p in Reader(data).pages() if data else ():
                        rows.append({**vars(p), "feature": feature(p), "error": None})
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError) as e:
                    rows = [dict.fromkeys(PAGE.names) | {"error": f"{type(e).__name__}: {e}"}]
                for r in rows:
                    for c in schema.names:
                        found[c].append(row[c] if c in keep else r[c])
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return files.select(*keep, media).mapInArrow(run, schema)
