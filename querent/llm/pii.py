"""Personal data by candidate gradient boosting.

Base spans follow fixed patterns and always stay. Generators of high recall propose more spans, which may overlap:
e-mail addresses with a written "at" or "dot", addresses of hosts with fenced dots, card and phone numbers with other
separators or without a plus. Boosted trees score each candidate by its format and its context, and a candidate counts if its
calibrated chance reaches the threshold of its kind; of overlapping ones the likeliest counts, none that touches a base span.

The trees are trained here on a bounded sample of documents: ``sample_docs`` of the smallest hashes of doc_id, and of each a
window of ``sample_chars`` characters that the hash sets anywhere in the text. Made-up personal data, some of it side by
side, and made-up look-alikes (versions, dates, sums, keys, rows of numbers, numbers that fail their check digit) are set
between the words of the windows, and the same generators propose. A candidate is true if it is a made-up item, and false if
it touches a made-up one otherwise; what the window itself held is of unknown truth and left out. Thresholds come from
held-out sampled documents. Scoring runs over every whole text.

Nulls and edges: a null text is empty, an empty text has no spans. Offsets are code points. Equal chances go by the earlier
start, then the longer span. Very long texts and texts of nothing but numbers take linear time: each group of digits starts
six candidates at most. Repeated rows give repeated rows, an empty table none (the trees are then trained on plain words);
other columns, whatever their names, are ignored by ``spans`` and kept by ``redacted``, in which a null text stays null.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.llm.arrow import by_columns
from querent.llm.boosting import Boosted, boosted, threshold

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The base patterns, written so that no start is tried twice. A run of digits that fails from its start fails
# from within, and an address begins at the start of its local part or where the last one ended.
LOCAL_AT_HOST = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := LOCAL_AT_HOST.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind: leftmost, not overlapping, dropped where they fail their check."""
    phones = (m.span() for m in PHONE.finditer(text)) if "+" in text else ()
    return {
        "email": list(emails(text)),
        "ip": [m.span() for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)],
        "phone": [s for s in phones if 9 <= len(digits_of(text[slice(*s)])) <= 15],
    }


# Generators. Each begins at a rare mark, so that plain prose costs one scan.
AT = re.compile(r"[\[({<]\s?(?:at|AT|@)\s?[\])}>]|(?<=\w) (?:AT|@) ?(?=\w)")
HOST = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\.| DOT )\s?[A-Za-z0-9-]{1,63}){1,4}")
NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?\Z")
CLUSTER = re.compile(r"[0-9](?:[0-9 ./()_\[\]-]*[0-9])?")
QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:[\[(]\.[\])]|\.)\s?[0-9]{1,3}){3}(?![0-9.])")
RUN = re.compile(r"[0-9]+")
#: Fewest and most digits of a phone and of a card number, most groups of either, and what parts two groups.
PHONE_DIGITS, CARD_DIGITS, GROUPS = (7, 15), (13, 19), 6
PARTS = re.compile(r"[ ._/-]|\)?[ ./-]?\(?")


def numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """From each group of digits on, the runs of up to GROUPS groups that can be phone or card numbers."""
    groups = [m.span() for m in RUN.finditer(text, start, end)]
    for k, (a, at) in enumerate(groups):
        if text[a - 1 : a] == "(" and text[at : at + 1] == ")":
            a -= 1
        if text[a - 1 : a] == "+":
            a -= 1
        digits = 0
        for n, (x, y) in enumerate(groups[k : k + GROUPS]):
            if n and not (x - at <= 3 and PARTS.fullmatch(text, at, x)):
                break
            digits, at = digits + y - x, y
            if digits > CARD_DIGITS[1]:
                break
            if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                yield "phone", a, y
            if digits >= CARD_DIGITS[0] and "0" <= text[a] <= "9":
                yield "card", a, y


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates of all kinds; they may overlap."""
    for m in AT.finditer(text):
        name, host = NAME.search(text, max(0, m.start() - 66), m.start()), HOST.match(text, m.end())
        if name and host:
            yield "email", name.start(), host.end()
    for c in CLUSTER.finditer(text):
        if c.end() - c.start() >= 7:
            for m in QUAD.finditer(text, c.start(), c.end()):
                yield "ip", *m.span()
            yield from numbers(text, c.start(), c.end())


# Words that tend to stand before personal data, by kind.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "from", "login"),
    "card": ("card", "visa", "credit", "carte", "tarjeta", "karte", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}
# Words and marks that tend to stand before look-alikes.
DECOYS = ("version", "release", "isbn", "issn", "order", "invoice", "section", "page", "id", "no", "nr", "build", "ref", "sku", "=", "#", "$", "€", "v")


WORDS = re.compile(r"[^\W\d_]+|[=#$€]")
NEXT, LAST = re.compile(r"([ ._/()-]{1,3})([0-9]+)"), re.compile(r"([0-9]+)([ ._/()-]{1,3})\Z")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """The format of a candidate, the groups of digits beside it, and its context."""
    span = text[start:end]
    runs = RUN.findall(span)
    digits = "".join(runs)
    sizes = [len(r) for r in runs[:7]] + [0] * 7
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 2]
    words = WORDS.findall(before)[-4:]
    left, right = LAST.search(before, max(0, len(before) - 20)), NEXT.match(text, end, end + 20)
    mark = span[sizes[0]] if len(span) > sizes[0] else ""
    return [
        float(KINDS.index(kind)),
        len(span),
        len(digits),
        len(runs),
        *sizes[:6],
        span.count(" "),
        span.count("."),
        span.count("-"),
        span.count("(") + 3 * span.count("["),
        span.count("_") + span.count("/"),
        span.count("@"),
        float(luhn(digits)) if len(digits) >= CARD_DIGITS[0] else 0.0,
        float(len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs)),
        float(runs[0][:4]) if runs else 0.0,
        float(digits[:1] or 0),
        float(len(set(digits))),
        float(span[:1] == "(") + 2 * float(span[:2] == "00") + 4 * float(span[:1] == "+"),
        float(any(w in CUES[kind] for w in words)),
        float(any(w in DECOYS for w in words)),
        float(before[-1:].isalnum()) + 2 * float(before[-1:] != "" and before[-1:] in "=#$€.,:/-_\"'"),
        float(after[:1].isalnum()) + 2 * float(after[:1] != "" and after[:1] in "%°€$/-_\"'"),
        float(len(left[1])) if left else 0.0,
        float(len(right[2])) if right else 0.0,
        float(left is not None and left[2] == mark) + 2 * float(left is not None and left[2] == " "),
        float(right is not None and right[1] == mark) + 2 * float(right is not None and right[1] == " "),
        float(len(re.split(r"[\s.\])}]+", span)[-1])) if kind == "email" else 0.0,
    ]


Piece = tuple[str, str | None]


def made_up(rnd: random.Random) -> list[Piece]:
    """What is set into a text: pieces of text with the kind of those that are personal data."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(3, 9)))
    octet = lambda: str(rnd.randint(1, 255))

    def number(k, right=True):
        body = rnd.choice("3456") + n(k - 2)
        return next(body + d for d in rnd.sample("0123456789", 10) if luhn(body + d) == right)

    def fours(x, sep):
        return sep.join(x[k : k + 4] for k in range(0, len(x), 4))

    def phone():
        sep = rnd.choice([" ", "-", ".", ") ", ""])
        if rnd.random() < 0.25:
            return "0" + rnd.choice(["", " ", "-"]).join([n(1), *(n(2) for _ in range(4))])
        return rnd.choice(["", "", "00" + rnd.choice(["1", "33", "49", "34"]) + " "]) + ("(" if sep == ") " else "") + n(3) + sep + n(3) + (rnd.choice(["-", " ", "."]) if sep else "") + n(4)

    cue = lambda kind: rnd.choice([rnd.choice(CUES[kind]) + rnd.choice([" ", ": "]), ""]) if rnd.random() < 0.7 else ""
    decoy = lambda: rnd.choice([rnd.choice(DECOYS) + rnd.choice([" ", ": ", ""]), ""])
    pick = rnd.randrange(20)
    if pick == 0:
        host = name() + rnd.choice([".", " [dot] ", "[.]", " DOT ", "(dot)"]) + rnd.choice(["com", "org", "net", "fr", "de", "es"])
        return [(cue("email"), None), (name() + rnd.choice([".", "_", ""]) + n(rnd.randint(0, 2)) + rnd.choice(["@", " [at] ", "[at]", " (at) ", " AT ", "(@)"]) + host, "email")]
    if pick == 1:
        return [(cue("ip"), None), (rnd.choice([".", "[.]", "(.)"]).join(octet() for _ in range(4)), "ip")]
    if pick in (2, 3):
        return [(cue("card"), None), (fours(number(16), rnd.choice(["", " ", "-", ".", "_"])), "card")]
    if pick in (4, 5, 6):
        return [(cue("phone"), None), (phone(), "phone")]
    if pick == 7:  # two side by side
        return [(cue("phone"), None), (phone(), "phone"), (rnd.choice([" ", " ", ", ", " / "]), None), (phone(), "phone")]
    if pick == 8:  # a year or a count right before it
        return [(rnd.choice(["in ", "since ", ""]) + rnd.choice([str(rnd.randint(1950, 2030)), n(rnd.randint(1, 2))]) + " ", None), (phone(), "phone")]
    if pick == 9:
        wrong = number(16, False)
        return [(decoy() + (wrong if rnd.random() < 0.5 else fours(wrong, rnd.choice([" ", "-"]))), None)]
    if pick == 10:
        return [(decoy() + ".".join(str(rnd.randint(0, 20)) for _ in range(rnd.randint(2, 5))), None)]
    if pick == 11:
        date = rnd.choice(["-", "/", "."]).join([n(4), f"{rnd.randint(1, 12):02}", f"{rnd.randint(1, 28):02}"])
        return [(decoy() + date + (f" {rnd.randint(0, 23):02}:{n(2)}:{n(2)}" if rnd.random() < 0.5 else ""), None)]
    if pick == 12:
        return [(decoy() + rnd.choice(["-", " ", "."]).join(n(rnd.randint(1, 5)) for _ in range(rnd.randint(2, 4))), None)]
    if pick == 13:
        return [(decoy() + n(rnd.randint(7, 20)), None)]
    if pick == 14:
        return [(decoy() + (f"{rnd.randint(1, 999)}.{n(3)}.{n(3)}" if rnd.random() < 0.5 else f"{rnd.randint(1, 99)} {n(3)} {n(3)}"), None)]
    if pick == 15:
        return [(rnd.choice(["password=", 'token = "', "key:", "AKIA", "sk-", "ghp_"]) + "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(18, 40))), None)]
    if pick == 16:
        return [(name() + rnd.choice([" @ ", " AT "]) + name() + rnd.choice([" ", ", "]) + name(), None)]
    if pick == 17:
        return [(decoy() + f"97{rnd.choice('89')}-{n(1)}-{n(3)}-{n(5)}-{n(1)}", None)]
    if pick == 18:  # a row of numbers
        return [(rnd.choice([" ", " ", "-"]).join(n(rnd.randint(1, 4)) for _ in range(rnd.randint(4, 12))), None)]
    return [(decoy() + ".".join(str(rnd.choice([octet(), rnd.randint(256, 999)])) for _ in range(3)) + f".{rnd.randint(256, 999)}", None)]


Candidate = tuple[str, int, int]
#: Candidates that are scored at once.
BLOCK = 8192


def winners(scored: list[tuple[float, Candidate]]) -> Iterator[tuple[float, Candidate]]:
    """The candidates of one text, likeliest first, without those that touch a likelier one."""
    taken = bytearray(max((c[2] for _, c in scored), default=0))
    for chance, c in sorted(scored, key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if taken.find(1, c[1], c[2]) < 0:
            taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
            yield chance, c


@dataclass
class Finder:
    model: Boosted
    thresholds: dict[str, float]

    def added(self, texts: list[str], fixed: list[dict[str, list[Span]]]) -> list[list[Candidate]]:
        """The candidates of each text that count, apart from its base spans and from each other."""
        good: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
        held: list[tuple[int, Candidate]] = []
        rows: list[list[float]] = []

        def score():
            for (k, c), chance in zip(held, self.model.chance(np.array(rows)).tolist() if rows else (), strict=True):
                if chance >= self.thresholds[c[0]]:
                    good[k].append((chance, c))
            held.clear()
            rows.clear()

        for k, (text, own) in enumerate(zip(texts, fixed, strict=True)):
            taken = None
            for c in proposed(text):
                if taken is None:
                    taken = bytearray(len(text))
                    for a, b in (s for spans in own.values() for s in spans):
                        taken[a:b] = b"\1" * (b - a)
                if taken.find(1, c[1], c[2]) < 0:
                    held.append((k, c))
                    rows.append(features(text, *c))
                    if len(rows) == BLOCK:
                        score()
        score()
        return [[c for _, c in winners(own)] for own in good]

    def found(self, texts: list[str]) -> list[tuple[dict[str, list[Span]], list[Candidate]]]:
        """The base spans of each text, and all its spans by kind and start."""
        fixed = [base(t) for t in texts]
        both = [[(k, *s) for k in KINDS for s in own[k]] + more for own, more in zip(fixed, self.added(texts, fixed), strict=True)]
        return [(own, sorted(every, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))) for own, every in zip(fixed, both, strict=True)]


def planted(text: str, rnd: random.Random, items: int) -> tuple[str, dict[tuple[str, int, int], bool], bytearray]:
    """``text`` with made-up items between its words, the items that are personal data, and where anything made-up stands."""
    words = text.split(" ")
    gaps = sorted(rnd.randrange(len(words) + 1) for _ in range(items))
    out, at, true, made = [], 0, {}, bytearray()
    for g, word in enumerate([*words, ""]):
        while gaps and gaps[0] == g:
            gaps.pop(0)
            for piece, kind in made_up(rnd):
                if kind:
                    true[kind, at, at + len(piece)] = True
                out.append(piece)
                at += len(piece)
                made += b"\1" * len(piece)
            out.append(" ")
            at, made = at + 1, made + b"\0"
        out += [word, " "]
        at, made = at + len(word) + 1, made + bytes(len(word) + 1)
    return "".join(out), true, made


@dataclass
class Examples:
    """Candidates that touch what was made up: their features, truth, and the number of their text."""

    found: list[Candidate]
    x: np.ndarray
    y: np.ndarray
    owner: np.ndarray


def examples(texts: list[str], seed: int, items: int = 12) -> Examples:
    rnd = random.Random(seed)
    found, x, y, owner = [], [], [], []
    for k, text in enumerate(texts):
        whole, true, made = planted(text or "", rnd, items)
        for c in proposed(whole):
            if made.find(1, c[1], c[2]) >= 0:
                found.append(c)
                x.append(features(whole, *c))
                y.append(c in true)
                owner.append(k)
    return Examples(found, np.array(x).reshape(len(x), -1), np.array(y, bool), np.array(owner))


def thresholds(own: Examples, chance: np.ndarray, precision: float) -> dict[str, float]:
    """For each kind the lowest chance at which the candidates that no likelier one touches are right that often; a half at least."""
    scored: dict[int, list[tuple[float, Candidate]]] = {}
    for k, x, c in zip(own.owner.tolist(), chance.tolist(), own.found, strict=True):
        scored.setdefault(k, []).append((x, c))
    true = {(k, c) for k, c, y in zip(own.owner.tolist(), own.found, own.y.tolist(), strict=True) if y}
    left = [(c[0], x, (k, c) in true) for k, every in scored.items() for x, c in winners(every)]
    out = {}
    for kind in KINDS:
        chances, right = np.array([x for n, x, _ in left if n == kind]), np.array([y for n, _, y in left if n == kind], bool)
        out[kind] = max(0.5, threshold(chances, right, precision))
    return out


def trained(docs: DataFrame, sample_docs: int = 400, sample_chars: int = 4000, precision: float = 0.99, seed: int = 42) -> Finder:
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    room = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    window = F.substring("text", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), room).cast("int") + 1, F.lit(sample_chars))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", window.alias("text")).distinct().orderBy("doc_id", "text").limit(sample_docs).collect()
    texts = [r.text or "" for r in rows] + ["a few plain words of an empty table " * 9] * max(0, 100 - len(rows))
    own = examples(texts, seed)
    held = own.owner % 4 == 0
    model = boosted(own.x, own.y, held, rounds=80, depth=4)
    rest = Examples([c for c, h in zip(own.found, held, strict=True) if h], own.x[held], own.y[held], own.owner[held])
    return Finder(model, thresholds(rest, model.chance(rest.x), precision))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def work():
        def function(rows):
            found = finder.found([t or "" for t in rows["text"]])
            out = {"doc_id": rows["doc_id"], "spans": [joined(s) for _, s in found]}
            out |= {f"n_{k}": [len(f[k]) for f, _ in found] for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(joined([(k, *s) for k in KINDS for s in f[k]]).encode()).hexdigest() for f, _ in found]
            return out

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)


def blanked(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch of spans put as the kind of its first one."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda c: (c[1], -c[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, finder: Finder) -> DataFrame:
    """``docs`` with the spans in ``text`` put as their kinds, and ``n_chars``, if there is one, brought up to date."""
    schema = docs.schema

    def work():
        def function(rows):
            found = finder.found([t or "" for t in rows["text"]])
            texts = [None if t is None else blanked(t, spans) for t, (_, spans) in zip(rows["text"], found, strict=True)]
            out = rows | {"text": texts}
            if "n_chars" in rows:
                out["n_chars"] = [n if t is None else len(t) for n, t in zip(rows["n_chars"], texts, strict=True)]
            return out

        return function

    return by_columns(docs, schema, work)
