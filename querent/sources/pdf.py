"""Words, rules and bars of PDF pages.

A first pass over the files finds their pages and gives slices of ``PAGES`` pages, each with the objects that its pages need but for
pictures and font programs; slices are dealt over the cluster, and tasks follow each page's content. So a large file isn't one task
beyond its objects, and its pictures are never sent.

Words are characters less than ``GAP`` points apart on lines less than ``LINE`` points apart, between blanks. Places are points from
the page's upper left corner, after its rotation. Level and upright lines and the sides of rectangles are rules and bars.

Nulls and edges: a null or empty file, one without a PDF header, an encrypted one, and one whose pages can't be found give one row with an
error and page null; a page that can't be read gives one row with its error and no words. Broken tables of references are made up for by
a walk over the file. Streams inflate to at most 64 MB, a page may have ``GLYPHS`` characters and ``STEPS`` operators; beyond that it is an
error. A page without text has no words. Characters without a known meaning are left out. Equal files under other names are files of
their own; an empty folder gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions.batches import together
from querent.sources.pdffonts import Font
from querent.sources.pdfobjects import DEEP, END, File, Given, Name, Objects, Operator, PdfError, Reader, Ref, Stream, dumped

#: Pages of a slice, characters and operators of a page, forms within forms.
PAGES, GLYPHS, STEPS, FORMS = 16, 2_000_000, 20_000_000, 12
# Points within which characters make a word and a line, and below which the side of a rectangle is no line.
GAP, LINE, SIDE = 1.0, 3.0, 3.0
#: What a broken file may raise while its values are used.
FAULTS = (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError, ZeroDivisionError, RecursionError)

# The plain tokens of content (numbers, words, hexadecimal strings, names), and what may be a reference; the rest is left to ``Reader``.
PLAIN = re.compile(rb"[\0\t\n\f\r ]*(?:([+-]?(?:\d+\.?\d*|\.\d+))|([A-Za-z'\"][A-Za-z0-9*'\"]*)|<([0-9A-Fa-f]*)>|/([A-Za-z0-9_.+-]+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)")
#: A text object that sets font, stretch and place at most once, in this order, and shows one plain string; runs of them are read as columns.
AMOUNT = rb"([+-]?(?:\d{1,15}(?:\.\d{0,15})?|\.\d{1,15}))[\0\t\n\f\r ]+"
SHOWN = re.compile(
    rb"[\0\t\n\f\r ]*+BT[\0\t\n\f\r ]++(?:/([A-Za-z0-9_.+-]+)[\0\t\n\f\r ]+" + AMOUNT + rb"Tf[\0\t\n\f\r ]++)?+(?:" + AMOUNT + rb"Tz[\0\t\n\f\r ]++)?+"
    rb"(?:" + AMOUNT * 6 + rb"Tm[\0\t\n\f\r ]*+)?+(?:<([0-9A-Fa-f]*+)>|\(([^()\\]*+)\))[\0\t\n\f\r ]*+Tj[\0\t\n\f\r ]++ET(?=[\0\t\n\f\r ]|\Z)"
)
#: A line or a rectangle that is painted at once.
DRAWN = re.compile(rb"[\0\t\n\f\r ]*+(?:" + AMOUNT * 2 + rb"m[\0\t\n\f\r ]++" + AMOUNT * 2 + rb"l|" + AMOUNT * 4 + rb"re)[\0\t\n\f\r ]++[Sf](?=[\0\t\n\f\r ]|\Z)")
RUN, LINES = (re.compile(rb"(?:" + re.sub(rb"(?<!\\)\((?!\?)", b"(?:", one.pattern) + rb"){2,}+") for one in (SHOWN, DRAWN))
#: The words of text objects of so many tokens, for ``fields``.
LAYOUTS = {n: words for given in itertools.product((0, 1), repeat=3) if (n := len(words := [b"BT", *[None, None, b"Tf"] * given[0], *[None, b"Tz"] * given[1], *[*[None] * 6, b"Tm"] * given[2], None, b"Tj", b"ET"]))}
REFERS = re.compile(rb"\d[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
LITERALS = {b"true": True, b"false": False, b"null": None}

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
# Entries that no page's content needs.
LEFT_OUT = frozenset("Parent Annots Metadata PieceInfo Thumb FontFile FontFile2 FontFile3 StructParents B AA Dur Trans LastModified".split())
INHERITED = ("Resources", "MediaBox", "Rotate")


def page_entries(file: Objects) -> Iterator[dict]:
    """The pages in order, with what they inherit."""
    root = file.get(file.trailer.get("Root"), dict) or {}
    waiting, seen = [(root.get("Pages"), {}, 0)], set()
    while waiting:
        ref, above, depth = waiting.pop()
        if isinstance(ref, Ref):
            if ref.number in seen:
                continue
            seen.add(ref.number)
        node = file.get(ref, dict)
        if node is None or depth > DEEP:
            continue
        held = above | {k: node[k] for k in INHERITED if k in node}
        kids = file.get(node.get("Kids"), list)
        if kids is not None and node.get("Type") != "Page":
            waiting += [(k, held, depth + 1) for k in reversed(kids)]
        else:
            yield held | node


def pruned(value, depth: int = 0):
    if isinstance(value, dict) and depth <= DEEP:
        return {k: pruned(v, depth + 1) for k, v in value.items() if k not in LEFT_OUT}
    return [pruned(v, depth + 1) for v in value] if isinstance(value, list) and depth <= DEEP else value


def needed(file: Objects, page: dict, bodies: dict[int, bytes]) -> bytes:
    """A page's own entries; the objects that they lead to are put into ``bodies``."""
    page = pruned({k: page[k] for k in (*INHERITED, "Contents") if k in page})
    waiting = [page]
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            waiting += value.values()
        elif isinstance(value, list):
            waiting += value
        elif isinstance(value, Ref) and value.number not in bodies:
            found = file.get(value)
            if isinstance(found, Stream):
                found = Stream(pruned(found.entries), b"" if found.entries.get("Subtype") == "Image" else found.raw)
                waiting.append({k: v for k, v in found.entries.items() if k != "Length"})
            else:
                found = pruned(found)
                waiting.append(found)
            bodies[value.number] = dumped(found)
    return dumped(page)


SLICE = "source string, first int, pages array<binary>, numbers array<int>, bodies array<binary>, error string"


def slices_of(source: str, data: bytes | None, size: int = PAGES) -> Iterator[dict]:
    """Slices of a file's pages, or its error."""
    first, pages, bodies = 0, [], {}
    one = lambda: {"source": source, "first": first, "pages": pages, "numbers": list(bodies), "bodies": list(bodies.values()), "error": None}
    try:
        file = File(data or b"")
        for page in page_entries(file):
            pages.append(needed(file, page, bodies))
            if len(pages) == size:
                yield one()
                first, pages, bodies = first + size, [], {}
        if not pages and not first:
            raise PdfError("no pages")
    except FAULTS as e:
        yield {"source": source, "first": first, "pages": [], "numbers": [], "bodies": [], "error": f"{type(e).__name__}: {e}"}
        return
    if pages:
        yield one()


def times(m: Matrix, n: Matrix) -> Matrix:
    """``m``, then ``n``."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class Places(NamedTuple):
    """Columns of glyphs or words."""

    x0: np.ndarray
    x1: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    size: np.ndarray
    upright: np.ndarray


class Rule(NamedTuple):
    """A level line, or a side of a rectangle if ``edge``."""

    x0: float
    x1: float
    top: float
    height: float
    edge: bool


class Bar(NamedTuple):
    x: float
    top: float
    bottom: float
    edge: bool


class TextState:
    """What the text operators set; it is kept by q and put back by Q."""

    def __init__(self, ctm: Matrix):
        self.ctm, self.font = ctm, None
        self.size = self.spacing = self.word = self.leading = self.rise = 0.0
        self.stretch = 1.0

    def copy(self) -> TextState:
        out = TextState.__new__(TextState)
        out.__dict__.update(self.__dict__)
        return out


def carried(values: list, first) -> list:
    """Each value, or where it is missing the last one before it."""
    out = []
    for value in values:
        first = value or first
        out.append(first)
    return out


def numbers_of(values: list[bytes], missing: float, carry: bool = True) -> np.ndarray:
    """Numbers of a column of ``SHOWN``; where one isn't given, the last one before it if ``carry``, else ``missing``."""
    seen = {v: float(v) for v in set(values) if v}
    if b"" in values:
        seen[b""] = missing
        values = carried(values, b"") if carry else values
    return np.array([seen[v] for v in values]) if len(seen) > 1 else np.full(len(values), *seen.values())


def fields(data: bytes) -> list:
    """The columns of ``SHOWN`` in a run of text objects; those that are all built alike are told by their tokens."""
    tokens = data.split()
    n = tokens.index(b"ET") + 1
    alike = n in LAYOUTS and len(tokens) % n == 0 and all(tokens[k::n].count(word) * n == len(tokens) for k, word in enumerate(LAYOUTS[n]) if word)
    if not alike or any(mark in data for mark in (b"(", b"\0", b"\v")):
        return list(zip(*SHOWN.findall(data), strict=True))
    own = tokens[n - 3 :: n]
    none = [b""] * len(own)
    known = {word: tokens[k - 1 :: n] for k, word in enumerate(LAYOUTS[n]) if word}
    names = [t[1:] for t in tokens[1::n]] if b"Tf" in known else none
    places = [tokens[k::n] for k in range(n - 10, n - 4)] if b"Tm" in known else [none] * 6
    return [names, known.get(b"Tf", none), known.get(b"Tz", none), *places, [t[1:-1] for t in own], none]


def laid(digits: list[bytes], plain: list[bytes], names: list[bytes], fonts: dict[bytes, Font | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all codes of strings in their fonts, one after the other: characters, widths in ems, whether it is a single space; and the codes of each string."""
    own = fonts[names[0]]
    sizes = np.array([len(d) for d in digits])
    if own is not None and (step := own.step) and names.count(names[0]) == len(names) and not any(plain) and not (sizes % (2 * step)).any():
        found = np.frombuffer(bytes.fromhex(b"".join(digits).decode()), ">u2" if step == 2 else np.uint8)
        distinct, place = np.unique(found, return_inverse=True)
        glyphs, counts = [own.glyph(c, step) for c in distinct.tolist()], sizes // (2 * step)
    else:
        raws = [p or bytes.fromhex((d + b"0" * (len(d) % 2)).decode()) for p, d in zip(plain, digits, strict=True)]
        each = [fonts[n].glyphs(r) if fonts[n] is not None else [] for n, r in zip(names, raws, strict=True)]
        glyphs, counts = [g for one in each for g in one], np.array([len(one) for one in each])
        place = np.arange(len(glyphs))
    texts = np.array([g[0] for g in glyphs], object)
    return texts[place], np.array([g[1] for g in glyphs], float)[place], np.array([g[2] for g in glyphs], bool)[place], counts


class Page:
    """A page's glyphs, rules and bars, gathered by following its content."""

    def __init__(self, objects: Objects, entries: dict):
        self.objects, self.fonts, self.steps = objects, {}, 0
        #: Characters, places and advances of glyphs along their strings, and of each string: glyphs, matrix, depth, size.
        self.characters: list[str] = []
        self.along: list[float] = []
        self.advance: list[float] = []
        self.strings: list[tuple[float, ...]] = []
        self.settled: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # strings, along and advance of runs before
        self.rules: list[Rule] = []
        self.bars: list[Bar] = []
        box = [float(objects.get(v, (int, float))) for v in objects.get(entries.get("MediaBox"), list) or (0, 0, 612, 792)]
        x0, y0, x1, y1 = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
        turn = int(objects.get(entries.get("Rotate"), (int, float)) or 0) % 360
        self.width, self.height = (y1 - y0, x1 - x0) if turn in (90, 270) else (x1 - x0, y1 - y0)
        ctm = {90: (0.0, -1.0, 1.0, 0.0, -y0, x1), 180: (-1.0, 0.0, 0.0, -1.0, x1, y1), 270: (0.0, 1.0, -1.0, 0.0, y1, -x0)}.get(turn, (1.0, 0.0, 0.0, 1.0, -x0, -y0))
        contents = objects.get(entries.get("Contents"))
        parts = [objects.get(c, Stream) for c in contents] if isinstance(contents, list) else [contents]
        data = b"\n".join(objects.bytes_of(p) for p in parts if isinstance(p, Stream))
        self.follow(data, objects.get(entries.get("Resources"), dict) or {}, TextState(ctm), 0)

    def font(self, resources: dict, name) -> Font | None:
        fonts = self.objects.get(resources.get("Font"), dict) or {}
        ref = fonts.get(name)
        held, key = (self.objects.fonts, ref.number) if isinstance(ref, Ref) else (self.fonts, id(ref))
        if key not in held:
            entries = self.objects.get(ref, dict)
            held[key] = Font(self.objects, entries) if entries else None
        return held[key]

    def follow(self, data: bytes, resources: dict, state: TextState, depth: int) -> None:
        reader, held, kept = Reader(data), [], []
        text = line = UNIT
        path: list[list[tuple[float, float]]] = []
        number = lambda k: float(held[k]) if len(held) >= -k and isinstance(held[k], (int, float)) else 0.0  # noqa: E731, UP038
        plain = PLAIN.match if b"R" not in data or not REFERS.search(data) else lambda *_: None
        while True:
            if not held and (found := RUN.match(data, reader.at)):
                text, line = self.run(fields(data[reader.at : found.end()]), resources, state)
                reader.at = found.end()
            if not held and not path and (found := LINES.match(data, reader.at)):
                self.lines(DRAWN.findall(data, reader.at, found.end()), state.ctm)
                reader.at = found.end()
            if found := plain(data, reader.at):
                reader.at, kind = found.end(), found.lastindex
                value = found[kind]
                if kind == 1:
                    held.append(float(value) if b"." in value else int(value) if len(value) < 20 else 0)
                    continue
                if kind == 3:
                    held.append(bytes.fromhex((value + b"0" * (len(value) % 2)).decode()))
                    continue
                if kind == 4:
                    held.append(Name(value.decode()))
                    continue
                if value in LITERALS:
                    held.append(LITERALS[value])
                    continue
            else:
                value = reader.value()
                if value is END:
                    break
                if not isinstance(value, Operator):
                    held.append(value)
                    continue
            self.steps += 1
            if self.steps > STEPS:
                raise PdfError("a page of too many operators")
            match bytes(value):
                case b"q":
                    kept.append(state.copy())
                case b"Q":
                    state = kept.pop() if kept else state
                case b"cm":
                    state.ctm = times(tuple(number(k) for k in range(-6, 0)), state.ctm)
                case b"BT":
                    text = line = UNIT
                case b"Tf":
                    state.font, state.size = self.font(resources, held[-2] if len(held) > 1 else None), number(-1)
                case b"Tc":
                    state.spacing = number(-1)
                case b"Tw":
                    state.word = number(-1)
                case b"Tz":
                    state.stretch = number(-1) / 100
                case b"TL":
                    state.leading = number(-1)
                case b"Ts":
                    state.rise = number(-1)
                case b"Td" | b"TD":
                    if value == b"TD":
                        state.leading = -number(-1)
                    text = line = times((1.0, 0.0, 0.0, 1.0, number(-2), number(-1)), line)
                case b"Tm":
                    text = line = tuple(number(k) for k in range(-6, 0))
                case b"T*" | b"'" | b'"' | b"Tj" | b"TJ":
                    if value in (b"T*", b"'", b'"'):
                        text = line = times((1.0, 0.0, 0.0, 1.0, 0.0, -state.leading), line)
                    if value == b'"':
                        state.word, state.spacing = number(-3), number(-2)
                    if value != b"T*" and held:
                        text = self.shown(held[-1] if isinstance(held[-1], list) else [held[-1]], state, text)
                case b"m":
                    path.append([(number(-2), number(-1))])
                case b"l":
                    if path:
                        path[-1].append((number(-2), number(-1)))
                case b"c" | b"v" | b"y":
                    path.append([(number(-2), number(-1))])  # a curve is no line, and ends where the next one begins
                case b"h":
                    if path:
                        path[-1].append(path[-1][0])
                case b"re":
                    x, y, w, h = (number(k) for k in range(-4, 0))
                    path.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
                case b"S" | b"s" | b"f" | b"F" | b"f*" | b"B" | b"B*" | b"b" | b"b*":
                    self.drawn(path, state.ctm)
                    path = []
                case b"n":
                    path = []
                case b"Do":
                    self.form(resources, held[-1] if held else None, state, depth)
                case b"ID":
                    found = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(data, reader.at)
                    reader.at = found.end() if found else len(data)
            held = []

    def form(self, resources: dict, name, state: TextState, depth: int) -> None:
        forms = self.objects.get(resources.get("XObject"), dict) or {}
        stream = self.objects.get(forms.get(name), Stream)
        if stream is None or stream.entries.get("Subtype") != "Form":
            return
        if depth >= FORMS:
            raise PdfError("forms nested too deep")
        own = state.copy()
        matrix = [self.objects.get(v, (int, float)) for v in self.objects.get(stream.entries.get("Matrix"), list) or ()]
        if len(matrix) == 6 and None not in matrix:
            own.ctm = times(tuple(map(float, matrix)), own.ctm)
        self.follow(self.objects.bytes_of(stream), self.objects.get(stream.entries.get("Resources"), dict) or resources, own, depth + 1)

    def shown(self, parts: list, state: TextState, text: Matrix) -> Matrix:
        """Takes in the glyphs of strings with shifts between them, and gives the text matrix behind them."""
        along, before = 0.0, len(self.characters)
        for part in parts:
            if isinstance(part, (int, float)):  # noqa: UP038
                along -= part / 1000 * state.size * state.stretch
            elif isinstance(part, bytes) and not isinstance(part, Operator) and state.font is not None:
                size, stretch, spacing, word = state.size, state.stretch, state.spacing, state.word
                for characters, width, blank in state.font.glyphs(part):
                    advance = width * size * stretch
                    if characters:
                        self.characters.append(characters)
                        self.along.append(along)
                        self.advance.append(advance)
                    along += advance + (spacing + word * blank) * stretch
                if len(self.characters) > GLYPHS:
                    raise PdfError("a page of too many characters")
        if own := len(self.characters) - before:
            self.strings.append((own, *times(text, state.ctm), state.font.depth * state.size + state.rise, state.size))
        return times((1.0, 0.0, 0.0, 1.0, along, 0.0), text)

    def run(self, columns: list, resources: dict, state: TextState) -> tuple[Matrix, Matrix]:
        """Takes in the strings of text objects, as ``fields`` gives them, and gives the matrices of the text and the line behind them."""
        names, sizes, stretches, *places, digits, plain = columns
        self.steps += 6 * len(digits)
        if self.steps > STEPS:
            raise PdfError("a page of too many operators")
        fonts = {n: self.font(resources, Name(n.decode())) for n in dict.fromkeys(names) if n}
        fonts[b""] = state.font
        named = carried(names, b"") if b"" in names else names
        size, stretch = numbers_of(sizes, state.size), numbers_of(stretches, state.stretch * 100) / 100
        matrix = np.array([numbers_of(own, unit, False) for own, unit in zip(places, UNIT, strict=True)])
        texts, width, blank, codes = laid(digits, plain, named, fonts)
        own_size, own_stretch, ends = np.repeat(size, codes), np.repeat(stretch, codes), np.cumsum(codes)
        advance = width * own_size * own_stretch
        behind = np.cumsum(advance + (state.spacing + state.word * blank) * own_stretch)
        started = np.concatenate([[0.0], behind])[ends - codes]
        along = np.concatenate([[0.0], behind[:-1]])[: len(behind)] - np.repeat(started, codes)
        kept = texts != ""
        self.characters += texts[kept].tolist()
        if len(self.characters) > GLYPHS:
            raise PdfError("a page of too many characters")
        count = np.concatenate([[0], np.cumsum(kept)])
        count = count[ends] - count[ends - codes]
        ctm = np.array(state.ctm)
        m = np.array([matrix[a] * ctm[b] + matrix[a + 1] * ctm[b + 2] + (ctm[b + 4] if a == 4 else 0.0) for a in (0, 2, 4) for b in (0, 1)])
        depths = {n: font.depth if font is not None else 0.0 for n, font in fonts.items()}
        depth = np.array([depths[n] for n in named])
        strings = np.column_stack([count, m.T, depth * size + state.rise, size])
        self.settle()
        self.settled.append((strings[count > 0], along[kept], advance[kept]))
        state.font, state.size, state.stretch = fonts[named[-1]], float(size[-1]), float(stretch[-1])
        line = tuple(map(float, matrix[:, -1]))
        return times((1.0, 0.0, 0.0, 1.0, float(behind[-1] - started[-1]) if codes[-1] else 0.0, 0.0), line), line

    def lines(self, found: list[tuple[bytes, ...]], ctm: Matrix) -> None:
        """Takes in lines and rectangles as ``DRAWN`` finds them."""
        self.steps += 3 * len(found)
        if self.steps > STEPS:
            raise PdfError("a page of too many operators")
        for line in found:
            if line[0]:
                a, b, c, d = map(float, line[:4])
                self.drawn([[(a, b), (c, d)]], ctm)
            else:
                x, y, w, h = map(float, line[4:])
                self.drawn([[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]], ctm)

    def settle(self) -> None:
        """Puts what was shown string by string into columns."""
        if self.strings:
            self.settled.append((np.array(self.strings, float), np.array(self.along, float), np.array(self.advance, float)))
            self.strings, self.along, self.advance = [], [], []

    def drawn(self, path: list[list[tuple[float, float]]], ctm: Matrix) -> None:
        """Takes in the level and upright pieces of a painted path."""
        for points in path:
            places = [moved(ctm, *p) for p in points]
            edge = len(places) > 2
            for (x0, y0), (x1, y1) in zip(places, places[1:], strict=False):
                if edge and abs(x1 - x0) < SIDE and abs(y1 - y0) < SIDE:
                    continue
                if abs(y1 - y0) < 1e-3 < abs(x1 - x0):
                    self.rules.append(Rule(min(x0, x1), max(x0, x1), self.height - max(y0, y1), abs(y1 - y0), edge))
                elif abs(x1 - x0) < 1e-3 < abs(y1 - y0):
                    self.bars.append(Bar(x0, self.height - max(y0, y1), self.height - min(y0, y1), edge))

    def glyphs(self) -> Places:
        """The places of all glyphs, in the order of the content."""
        self.settle()
        rows, along, advance = (np.concatenate(c) for c in zip((np.zeros((0, 9)), np.zeros(0), np.zeros(0)), *self.settled, strict=True))
        m0, m1, m2, m3, m4, m5, low, size = np.repeat(rows[:, 1:], rows[:, 0].astype(int), axis=0).T
        behind = along + advance
        with np.errstate(all="ignore"):
            ax, ay = m0 * along + m2 * low + m4, m1 * along + m3 * low + m5
            bx, by = m0 * behind + m2 * (low + size) + m4, m1 * behind + m3 * (low + size) + m5
            upright = (np.abs(m1) < 1e-6) & (np.abs(m2) < 1e-6) & (m0 * m3 > 0)
        if not all(np.isfinite(v).all() for v in (ax, ay, bx, by)):
            raise PdfError("a glyph without a place")
        y0, y1 = np.minimum(ay, by), np.maximum(ay, by)
        return Places(np.minimum(ax, bx), np.maximum(ax, bx), self.height - y1, self.height - y0, y1 - y0, upright)

    def words(self) -> tuple[list[str], Places]:
        """Texts and places of words: upright ones by lines, others by their places across."""
        whole = self.glyphs()
        spaces = {c: c.isspace() for c in set(self.characters)}
        blank = np.array([spaces[c] for c in self.characters], bool) if any(spaces.values()) else np.zeros(len(self.characters), bool)
        found = [self.joined(whole, blank, np.flatnonzero(whole.upright == upright), upright) for upright in (True, False)]
        texts = found[0][0] + found[1][0]
        kept = np.array([t != "" for t in texts], bool)
        return [t for t in texts if t], Places(*(np.concatenate(c)[kept] for c in zip(found[0][1], found[1][1], strict=True)))

    def joined(self, whole: Places, blank: np.ndarray, own: np.ndarray, upright: bool) -> tuple[list[str], Places]:
        """The words of the glyphs ``own``: a word ends at a blank, a gap, a step to another level and with its line."""
        if not (~blank[own]).any():
            return [], Places(*(c[:0] for c in whole))
        level, start, end = (whole.top, whole.x0, whole.x1) if upright else (whole.x0, whole.top, whole.bottom)
        own = own[np.argsort(level[own], kind="stable")]
        line = np.concatenate([[0], np.cumsum(np.diff(level[own]) > LINE)])
        order = np.lexsort((start[own], line))
        own, line = own[order], line[order]
        solid = np.flatnonzero(~blank[own])
        own, line = own[solid], line[solid]
        apart = (np.diff(line) > 0) | (np.diff(solid) > 1) | (start[own[1:]] > end[own[:-1]] + GAP) | (np.abs(np.diff(level[own])) > LINE)
        first = np.concatenate([[0], np.flatnonzero(apart) + 1])
        last = np.append(first[1:], len(own))
        word = np.repeat(np.arange(len(first)), last - first)
        x0, x1, top, bottom, size, _ = (c[own] for c in whole)
        sizes = size[np.lexsort((size, word))]
        middle = (sizes[first + (last - first - 1) // 2] + sizes[first + (last - first) // 2]) / 2
        characters = [self.characters[k] for k in own.tolist()]
        texts = ["".join(characters[a:b]).strip() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return texts, Places(np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first), np.minimum.reduceat(top, first), np.maximum.reduceat(bottom, first), middle, np.full(len(first), upright))


PAGE_ROW = "doc_id string, page int, width double, height double, words array<struct<text: string, x0: double, x1: double, top: double, bottom: double, size: double, upright: boolean>>, rules array<struct<x0: double, x1: double, top: double, height: double, edge: boolean>>, bars array<struct<x: double, top: double, bottom: double, edge: boolean>>, error string"


NUMBERS = lambda *names: [(n, pa.float64()) for n in names]
#: PAGE_ROW in Arrow's types.
ROW = pa.schema([
    ("doc_id", pa.string()), ("page", pa.int32()), *NUMBERS("width", "height"),
    ("words", pa.list_(pa.struct([("text", pa.string()), *NUMBERS("x0", "x1", "top", "bottom", "size"), ("upright", pa.bool_())]))),
    ("rules", pa.list_(pa.struct([*NUMBERS("x0", "x1", "top", "height"), ("edge", pa.bool_())]))),
    ("bars", pa.list_(pa.struct([*NUMBERS("x", "top", "bottom"), ("edge", pa.bool_())]))),
    ("error", pa.string()),
])


class Row(NamedTuple):
    """A page and its words, or an error."""

    source: str
    number: int | None
    page: Page | None
    texts: list[str]
    places: Places | None
    error: str | None

    def size(self) -> int:
        return 200 if self.page is None else 200 + 64 * len(self.texts) + 40 * (len(self.page.rules) + len(self.page.bars))


def listed(name: str, counts: list[int], columns: list) -> pa.ListArray:
    """A column of ROW that holds structs, ``counts`` of them in each row, from their ``columns``."""
    kind = ROW.field(name).type
    fields = list(kind.value_type)
    own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), own, type=kind)


def batch_of(rows: list[Row]) -> pa.RecordBatch:
    pages = [(r.page, r.places) for r in rows if r.page is not None]
    words = [[t for r in rows for t in r.texts], *(np.concatenate(c) for c in zip(*(places for _, places in pages), strict=True))] if pages else [()] * 7
    columns = {"words": ([len(r.texts) for r in rows], words)}
    for name, n in (("rules", 5), ("bars", 4)):
        own = [line for page, _ in pages for line in getattr(page, name)]
        columns[name] = [len(getattr(r.page, name)) if r.page is not None else 0 for r in rows], list(zip(*own, strict=True)) or [()] * n
    size = [(r.page.width, r.page.height) if r.page is not None else (None, None) for r in rows]
    values = [[r.source for r in rows], [r.number for r in rows], [w for w, _ in size], [h for _, h in size], *(listed(name, *columns[name]) for name in ("words", "rules", "bars")), [r.error for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, list) else v for v, f in zip(values, ROW, strict=True)], schema=ROW)


def page_rows(piece: dict) -> Iterator[Row]:
    """The pages of a slice; of a slice with an error, that error."""
    if piece["error"] is not None:
        yield Row(piece["source"], None, None, [], None, piece["error"])
        return
    objects = Given(dict(zip(piece["numbers"], piece["bodies"], strict=True)))
    for number, body in enumerate(piece["pages"], piece["first"] + 1):
        try:
            page = Page(objects, Reader(body).value())
            yield Row(piece["source"], number, page, *page.words(), None)
        except FAULTS as e:
            yield Row(piece["source"], number, None, [], None, f"{type(e).__name__}: {e}")


def pages_of(piece: dict) -> Iterator[dict]:
    """The rows of ``page_rows`` as dicts."""
    for row in page_rows(piece):
        yield from batch_of([row]).to_pylist()


def pdf_pages(files: DataFrame, size: int = PAGES) -> DataFrame:
    """(doc_id, page, width, height, words, rules, bars, error) of the pages of ``files`` (source, content), pages from 1."""
    piece = to_arrow_schema(T.StructType.fromDDL(SLICE))

    def cut(batches):
        each = ((batch.column("source")[k].as_py(), batch.column("content")[k].as_py()) for batch in batches for k in range(batch.num_rows))
        found = (piece for source, data in each for piece in slices_of(source, data, size))
        return together(found, lambda piece: sum(map(len, piece["bodies"])) + sum(map(len, piece["pages"])), lambda pieces: pa.RecordBatch.from_pylist(pieces, schema=piece))

    def read(batches):
        pieces = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        return together((row for found in pieces for row in page_rows(found)), Row.size, batch_of)

    dealt = files.select("source", "content").mapInArrow(cut, SLICE).repartition("source", "first")
    return dealt.mapInArrow(read, PAGE_ROW)


def read_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """``pdf_pages`` of the PDF files right in ``folder``."""
    return pdf_pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(F.col("_metadata.file_name").alias("source"), "content"))


class PageTables(NamedTuple):
    """What ``page_texts`` takes."""

    words: DataFrame
    rules: DataFrame
    pages: DataFrame
    bars: DataFrame


def page_tables(pages: DataFrame) -> PageTables:
    """Words, rules, pages and bars of ``pdf_pages`` as tables; pages with an error are left out."""
    good = pages.where("error IS NULL")
    key = ("doc_id", "page")
    words = good.select(*key, F.posexplode("words").alias("k", "w")).select(*key, F.concat_ws(":", *key, "k").alias("word_id"), "w.*")
    rules = good.select(*key, F.inline("rules"))
    bars = good.select(*key, F.inline("bars"))
    return PageTables(words, rules, good.select(*key, "width", "height"), bars)
