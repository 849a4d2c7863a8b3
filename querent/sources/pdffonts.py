"""Fonts of PDF pages: from the bytes of a string to characters, widths and depths."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from querent.sources.pdfobjects import END, Name, Objects, Operator, PdfError, Reader, Stream

#: Most codes that a font's maps may name.
CODES = 1 << 20
#: Short strings of a slice whose glyphs are kept.
KNOWN = 1 << 14

# Names of glyphs that don't follow from a letter and its accent.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤", "quotedblleft": "“", "guillemotleft": "«", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
    "endash": "–", "emdash": "—", "minus": "−", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "quotedblright": "”", "quoteleft": "‘", "quoteright": "’", "guillemotright": "»", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿",
    "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "dotlessi": "ı", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Euro": "€", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "mu": "µ", "logicalnot": "¬", "brokenbar": "¦", "ordfeminine": "ª", "ordmasculine": "º", "onehalf": "½", "onequarter": "¼", "threequarters": "¾",
    "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "infinity": "∞", "summation": "∑", "arrowright": "→", "arrowleft": "←",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
# The upper half of the standard encoding, by code.
STANDARD = {0x27: "’", 0x60: "‘"} | dict(zip([*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, 0xC1, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB], "¡ ¢ £ ⁄ ¥ ƒ § ¤ ' “ « ‹ › fi fl – † ‡ · ¶ • ‚ „ ” » … ‰ ¿ ` ´ ˆ ˜ ¯ ˘ ˙ ¨ ˚ ¸ ˝ ˛ ˇ — Æ ª Ł Ø Œ º æ ı ł ø œ ß".split(), strict=True))
# Widths of codes 32 to 126 and depths of the fonts that files needn't bring along.
HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
DEPTHS = {"Helvetica": -207, "Arial": -207, "Times": -217, "Courier": -157}


@lru_cache(maxsize=4096)
def glyph_text(name: str) -> str | None:
    """The characters of a glyph's name."""
    bare = name.split(".")[0]
    if name in GLYPHS or bare in GLYPHS:
        return GLYPHS.get(name, GLYPHS.get(bare))
    if len(bare) == 1:
        return bare
    if found := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", bare):
        codes = [int(found[1][k : k + 4], 16) for k in range(0, len(found[1]), 4)] if found[1] else [int(found[2], 16)]
        return "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000) or None
    if bare[0].isalpha() and bare[1:] in ACCENTS:
        return unicodedata.normalize("NFC", bare[0] + ACCENTS[bare[1:]])
    if "_" in bare:
        parts = [glyph_text(p) for p in bare.split("_") if p]
        return "".join(parts) if parts and all(parts) else None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if bare[0].isupper() else 'SMALL'} LETTER {bare.upper()}")
    except KeyError:
        return None


@lru_cache(maxsize=8)
def base_encoding(name: str) -> tuple[str | None, ...]:
    """The characters of codes 0 to 255."""
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(name)
    if codec:
        return tuple(bytes([c]).decode(codec, "replace").replace("�", "") or None if c >= 32 else None for c in range(256))
    return tuple(STANDARD.get(c, chr(c) if 32 <= c < 127 else None) for c in range(256))


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore").replace("\0", "")


#: Pairs of a code and its characters, both of whole bytes.
PAIRS = re.compile(rb"(?:[\0\t\n\f\r ]*+<(?:[0-9A-Fa-f]{2})++>[\0\t\n\f\r ]*+<(?:[0-9A-Fa-f]{2})++>)++")


class CodeMap:
    """A map of codes, of one to four bytes, to characters or to numbers of glyphs."""

    def __init__(self, data: bytes):
        self.text: dict[int, str] = {}
        self.cid: dict[int, int] = {}
        self.spaces: list[tuple[int, bytes, bytes]] = []
        reader, held = Reader(data), []
        while (value := reader.value()) is not END:
            if not isinstance(value, Operator):
                held.append(value)
                continue
            if value == b"beginbfchar" and (found := PAIRS.match(data, reader.at)):
                pairs = found[0].translate(None, b"\0\t\n\f\r <").split(b">")
                self.text |= {int(a, 16): utf16(bytes.fromhex(b.decode())) for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
                reader.at = found.end()
            own = [h for h in held if isinstance(h, bytes | int | list)]
            if value == b"endcodespacerange":
                self.spaces += [(len(a), a, b) for a, b in zip(own[::2], own[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) == len(b)]
            elif value == b"endbfchar":
                self.text |= {int.from_bytes(a, "big"): utf16(b) for a, b in zip(own[::2], own[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value in (b"endbfrange", b"endcidrange"):
                for a, b, c in zip(own[::3], own[1::3], own[2::3], strict=False):
                    self.ranged(a, b, c)
            elif value == b"endcidchar":
                self.cid |= {int.from_bytes(a, "big"): b for a, b in zip(own[::2], own[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, int)}
            held = []

    def ranged(self, a, b, c) -> None:
        if not isinstance(a, bytes) or not isinstance(b, bytes):
            return
        first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
        if last - first + len(self.text) + len(self.cid) > CODES:
            raise PdfError("a map of too many codes")
        for k in range(last - first + 1):
            if isinstance(c, int):
                self.cid[first + k] = c + k
            elif isinstance(c, list):
                if k < len(c) and isinstance(c[k], bytes):
                    self.text[first + k] = utf16(c[k])
            elif c:
                self.text[first + k] = utf16(c[:-2] + ((int.from_bytes(c[-2:], "big") + k) & 0xFFFF).to_bytes(min(len(c), 2), "big") if len(c) > 1 else bytes([0, (c[0] + k) & 255]))

    def codes(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(code, length) of each code of a string."""
        at = 0
        while at < len(raw):
            size = next((n for n, a, b in self.spaces if len(raw) - at >= n and all(x <= y <= z for x, y, z in zip(a, raw[at : at + n], b, strict=True))), min((n for n, _, _ in self.spaces), default=2))
            yield int.from_bytes(raw[at : at + size], "big"), size
            at += size


class Font:
    """What a string's bytes look like: ``glyphs`` gives characters, widths in ems, and whether a code is a single space."""

    def __init__(self, objects: Objects, entries: dict):
        self.kind = entries.get("Subtype")
        self.known: dict[bytes, list[tuple[str, float, bool]]] = {}
        self.seen: dict[tuple[int, int], tuple[str, float, bool]] = {}
        self.scale = 0.001
        stream = objects.get(entries.get("ToUnicode"), Stream)
        self.unicode = CodeMap(objects.bytes_of(stream)).text if stream else {}
        inner = entries
        if self.kind == "Type0":
            below = objects.get(entries.get("DescendantFonts"), list) or []
            inner = objects.get(below[0], dict) if below else None
            inner = inner or {}
            self.composite(objects, entries, inner)
        else:
            self.simple(objects, entries)
        told = objects.get(inner.get("FontDescriptor"), dict) or {}
        name = str(objects.get(entries.get("BaseFont")) or "").split("+")[-1]
        family = next((f for f in DEPTHS if name.startswith(f)), None)
        depth = objects.get(told.get("Descent"), (int, float))
        self.depth = -abs(depth) * 0.001 if depth is not None else DEPTHS.get(family, 0) * 0.001
        if self.kind != "Type0" and not self.widths and self.kind != "Type3":
            table = {"Helvetica": HELVETICA, "Arial": HELVETICA, "Times": TIMES}.get(family)
            self.widths = dict(enumerate(map(float, table.split()), 32)) if table else {}
            self.default = 600.0 if family == "Courier" else self.default or (500.0 if table else 600.0)

    def simple(self, objects: Objects, entries: dict) -> None:
        told = objects.get(entries.get("FontDescriptor"), dict) or {}
        self.default = float(objects.get(told.get("MissingWidth"), (int, float)) or 0)
        first = objects.get(entries.get("FirstChar"), int) or 0
        widths = [objects.get(w, (int, float)) for w in objects.get(entries.get("Widths"), list) or ()]
        self.widths = {first + k: float(w) for k, w in enumerate(widths[:CODES]) if w is not None}
        if self.kind == "Type3":
            matrix = objects.get(entries.get("FontMatrix"), list) or [0.001]
            self.scale = abs(float(objects.get(matrix[0], (int, float)) or 0.001))
        given = objects.get(entries.get("Encoding"))
        base = given if isinstance(given, Name) else objects.get(given.get("BaseEncoding")) if isinstance(given, dict) else None
        symbols = bool((objects.get(told.get("Flags"), int) or 0) & 4) and base is None
        held = list(base_encoding("WinAnsiEncoding" if symbols else str(base or "StandardEncoding")))
        code = 0
        for x in objects.get(given.get("Differences"), list) or () if isinstance(given, dict) else ():
            x = objects.get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name) and 0 <= code < 256:
                held[code] = glyph_text(x) or held[code]
                code += 1
        self.characters = held

    def composite(self, objects: Objects, entries: dict, inner: dict) -> None:
        given = objects.get(entries.get("Encoding"))
        self.map = CodeMap(objects.bytes_of(given)) if isinstance(given, Stream) else None
        self.utf16 = isinstance(given, Name) and ("UCS2" in given or "UTF16" in given)
        width = objects.get(inner.get("DW"), (int, float))
        self.default = 1000.0 if width is None else float(width)
        self.widths, listed, at = {}, [objects.get(x) for x in objects.get(inner.get("W"), list) or ()], 0
        while at + 1 < len(listed) and isinstance(listed[at], int):
            first, then = listed[at], listed[at + 1]
            if isinstance(then, list):
                self.widths |= {first + k: float(w) for k, w in enumerate(map(objects.get, then)) if isinstance(w, int | float)}
                at += 2
            elif isinstance(then, int) and at + 2 < len(listed) and isinstance(listed[at + 2], int | float):
                if then - first + len(self.widths) > CODES:
                    raise PdfError("a font of too many widths")
                self.widths |= dict.fromkeys(range(first, then + 1), float(listed[at + 2]))
                at += 3
            else:
                break

    def glyphs(self, raw: bytes) -> list[tuple[str, float, bool]]:
        if (found := self.known.get(raw)) is not None:
            return found
        if self.kind != "Type0":
            codes = ((code, 1) for code in raw)
        else:
            codes = self.map.codes(raw) if self.map else ((int.from_bytes(raw[k : k + 2], "big"), 2) for k in range(0, len(raw), 2))
        found = [self.glyph(*c) for c in codes]
        if len(raw) <= 64 and len(self.known) < KNOWN:
            self.known[raw] = found
        return found

    @property
    def step(self) -> int:
        """The bytes of every code, or zero where codes differ in length."""
        return 1 if self.kind != "Type0" else 0 if self.map else 2

    def glyph(self, code: int, size: int) -> tuple[str, float, bool]:
        key = (code, size)
        return self.seen[key] if key in self.seen else self.seen.setdefault(key, self.looked_up(code, size))

    def looked_up(self, code: int, size: int) -> tuple[str, float, bool]:
        if self.kind != "Type0":
            return self.unicode.get(code) or self.characters[code] or "", self.widths.get(code, self.default) * self.scale, code == 32
        cid = self.map.cid.get(code, code) if self.map else code
        text = self.unicode.get(code)
        if text is None:
            text = utf16(code.to_bytes(2, "big")) if self.utf16 and code < 1 << 16 else ""
        return text, self.widths.get(cid, self.default) * self.scale, size == 1 and code == 32
