"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, by a persistent audit DP.

Rows of a conversation stand in the order of their turn (nulls first), role and text. A row's first fault counts: blank (nothing
but white space), duplicate (role and text of an earlier row), truncated (the last visible character is none of ``.!?``). Keep
costs 0, rerole 1, delete 2, insert 5, a truncated row that stays 5; blank and duplicate rows are deleted.

The audit is the string of the edits' initials. The program runs over four states (nothing yet, after s, after u, after a).
Prefixes of audits are linked nodes that share what they have in common; each knows its ancestors 1, 2, 4, ... letters back and the
rolling hash of its string. Of two prefixes of equal cost in one state the ASCII-least wins: the length of their common prefix is
found by descending over ancestors with unequal hashes, and what the hashes say is verified by the identity of the nodes (an audit
determines rows and state, so equal strings are one node), else letter by letter. For the same reason neither of the two starts
with the other, so what follows can't turn the choice round.

Spark: one exchange sorts all rows by range, so rows of one conversation may run over several partitions. A conversation within a
partition and of at most ``ROWS`` rows and ``TEXT`` characters is judged right there. The others are cut into segments: the first
rows of equal role and text come from an aggregate joined back, each segment gives the best audits from every state to every
state in a task of its own, and a last pass joins segments in order and hashes the repaired texts as they stream by. So no task
holds a conversation; by its definition the digest of a conversation is worked out by one task, and its audit is one cell.

Nulls and edges: null ids, roles and texts are read as one space (a null id stays null in the results and is one conversation);
null turns come first and count for no gap. Rows that are equal in all are duplicates of one another. A role's first character is
its initial, an empty role has none. A conversation without rows left has zeros, an empty audit and the digest of no bytes. Gaps
are at most 2^63 - 1. Long texts are passed on whole. Rows of one conversation, turn and role whose first 64 characters agree
are sorted by one task. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.llm.arrow import memory_returned, slices
from querent.session import stored

#: Rows and characters of a conversation, or a segment of one, that a task holds at once.
ROWS, TEXT = 1024, 1 << 21
#: States of the program, and the state after a user's and after an assistant's message from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
BASE, PRIME = 1_000_003, (1 << 61) - 1
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


class Edit:
    """The last letter of a prefix of an audit."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, parent: Edit | None = None, letter: str = ""):
        self.letter = letter
        self.depth = parent.depth + 1 if parent else 0
        self.hash = (parent.hash * BASE + ord(letter)) % PRIME if parent else 0
        self.up: list[Edit] = []
        while parent is not None:
            k = len(self.up)
            self.up.append(parent)
            parent = parent.up[k] if k < len(parent.up) else None

    def then(self, letters: str) -> Edit:
        node = self
        for letter in letters:
            node = Edit(node, letter)
        return node

    def ancestor(self, depth: int) -> Edit:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))

    def __lt__(self, other: Edit) -> bool:
        x, y = self.ancestor(min(self.depth, other.depth)), other.ancestor(min(self.depth, other.depth))
        if x is y:
            return self.depth < other.depth
        if x.hash == y.hash:
            return self.text() < other.text()
        for k in reversed(range(len(x.up))):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        return x.letter < y.letter if x.up[0] is y.up[0] else self.text() < other.text()


class Piece:
    """A prefix of an audit as the strings of its segments."""

    __slots__ = ("before", "depth", "letters")

    def __init__(self, before: Piece | None = None, letters: str = ""):
        self.before, self.letters = before, letters
        self.depth = before.depth + 1 if before else 0

    def then(self, letters: str) -> Piece:
        return Piece(self, letters)

    def text(self, until: Piece | None = None) -> str:
        found, node = [], self
        while node is not until:
            found.append(node.letters)
            node = node.before
        return "".join(reversed(found))

    def __lt__(self, other: Piece) -> bool:
        x, y = self, other
        while x is not y:
            x, y = x.before if x.depth >= y.depth else x, y.before if y.depth >= x.depth else y
        return self.text(x) < other.text(x)


Best = tuple[int, "Edit | Piece"]


def least(candidates: list[tuple[int, Edit | Piece, str]]) -> Best | None:
    """The cheapest of (cost, prefix, further letters), of equally cheap ones the ASCII-least."""
    if not candidates:
        return None
    cost = min(c[0] for c in candidates)
    return cost, min(prefix.then(letters) if letters else prefix for c, prefix, letters in candidates if c == cost)


def inserted(best: list[Best | None]) -> list[Best | None]:
    """``best`` with messages put in where that is cheaper."""
    user = least([(best[q][0] + INSERT * (q != USER), best[q][1], "I" * (q != USER)) for q in range(4) if best[q]])
    out = [*best]
    out[USER] = user
    if user:
        out[ASSISTANT] = least([(user[0] + INSERT, user[1], "I"), *([(*best[ASSISTANT], "")] if best[ASSISTANT] else [])])
    return out


def edited(best: list[Best | None], initial: str, fixed: bool, cut: bool) -> list[Best | None]:
    """``best`` after a row; ``fixed`` ones can only be deleted."""
    best = inserted(best)
    found: list[list[tuple[int, Edit, str]]] = [[], [], [], []]
    for q, known in enumerate(best):
        if known:
            cost, node = known
            found[q].append((cost + DELETE, node, "D"))
            if not fixed:
                cost += CUT * cut
                found[NEXT[q]].append((cost + REROLE, node, "R"))
                if (to := KEPT.get(initial, {}).get(q)) is not None:
                    found[to].append((cost, node, "K"))
    return [least(f) for f in found]


def closed(best: list[Best | None]) -> Best:
    """The best of the audits that leave a whole conversation."""
    best = inserted(best)
    return least([(*best[q], "") for q in (START, ASSISTANT) if best[q]])


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int


@dataclass
class Tally:
    """Counts of a run of rows, and what is needed to join it to the next run."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def then(self, other: Tally) -> Tally:
        if other.first is None:
            return self
        if self.first is None:
            return other
        return Tally(
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            self.turns + other.turns - (self.high is not None and self.high == other.low),
            other.low if self.low is None else self.low,
            self.high if other.high is None else other.high,
            self.first,
            other.last,
        )

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


@dataclass
class Run:
    """The program over a run of rows, from each of ``starts``."""

    starts: tuple[int, ...]
    tally: Tally = field(default_factory=Tally)
    best: list[list[Best | None]] = field(default_factory=list)

    def __post_init__(self):
        self.best = [[(0, Edit()) if q == start else None for q in range(4)] for start in self.starts]

    def add(self, row: Row, again: bool) -> bool:
        """One copy of a row, ``again`` if it was seen earlier; says whether it can stay."""
        visible, initial = row.text.rstrip(SPACES), row.role[:1]
        blank = not visible
        cut = not blank and not again and visible[-1] not in ".!?"
        self.tally = self.tally.then(Tally(int(blank), int(again and not blank), int(cut), 0, int(row.turn is not None), row.turn, row.turn, initial, initial))
        self.best = [edited(b, initial, blank or again, cut) for b in self.best]
        return not blank and not again


class Repaired:
    """Follows an audit over the rows of a conversation and says which messages come of it."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def new(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.new()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter != "D":
            self.state = NEXT[self.state] if letter == "R" else KEPT[role[0]][self.state]
            yield (NAMES[self.state] if letter == "R" else role), text


class Digest:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, messages: Iterable[tuple[str, str]]) -> None:
        for role, text in messages:
            self.sha.update(b"\n" * self.any + f"{role}:{text}".encode())
            self.any = True


def judged(rows: list[Row]) -> tuple[Tally, int, str]:
    """Counts, cost and audit of a whole conversation that a task holds."""
    run, seen = Run((START,)), set()
    for row in rows:
        for _ in range(row.copies):
            run.add(row, (row.role, row.text) in seen)
            if row.text.strip(SPACES):
                seen.add((row.role, row.text))
    cost, node = closed(run.best[0])
    return run.tally, cost, node.text()


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def found(tally: Tally, cost: int, audit: str, sha: str) -> dict:
    return {"gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def message(k: int, role: str, text: str) -> dict:
    return {"place": k, "role": role, "text": text}


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with made-up faults by the checksum of ``conv_id:turn``; a dropped row stays as one with 0 copies."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    role = F.when(F.col("kind") == 4, "user").otherwise(known("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind")).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def plain(rows: DataFrame) -> DataFrame:
    """``conversations`` as they are, in the columns that the steps below take."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role"), known("text"), F.lit(1).alias("copies"))


def batches_of(rows: Iterable[dict], arrow: pa.Schema, limit: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length and text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("audit") or "")
        if len(held) >= limit or size > TEXT:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)
    memory_returned()


def streamed(rows: DataFrame, schema: T.StructType, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``work`` over the rows of each partition as they come."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        yield from batches_of(work(row for part in slices(batches) for row in part.to_pylist()), arrow)

    return rows.mapInArrow(run, schema)


def results(whole: list[Row], messages: bool) -> Iterator[dict]:
    """What is said of a conversation that a task holds."""
    tally, cost, audit = judged(whole)
    repaired = Repaired(audit)
    said = (m for row in whole for _ in range(row.copies) for m in repaired.row(row.role, row.text))
    if messages:
        k = -1
        for k, (role, text) in enumerate(said):
            yield message(k, role, text)
        for k, (role, text) in enumerate(repaired.new(), k + 1):
            yield message(k, role, text)
        return
    digest = Digest()
    digest.add(said)
    digest.add(repaired.new())
    yield found(tally, cost, audit, digest.sha.hexdigest())


def sorted_pass(messages: bool, most_rows: int, most_text: int) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Judges the conversations that lie within a partition, and passes on the rows of the others by segment and place."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, held, size, segment, n = None, [], 0, 0, 0
        first, long, begun = True, False, False

        def opened() -> Iterator[dict]:
            nonlocal segment, n
            for row in held:
                yield {"conv_id": conv, "part": part, "segment": segment, "at": n, **row._asdict(), "open": True}
                n += 1
            segment += 1

        for row in rows:
            if begun and row["conv_id"] != conv:
                if first or long:
                    yield from opened()
                else:
                    for out in results(held, messages):
                        yield {"conv_id": conv, **out, "open": False}
                first, long, held, size = False, False, [], 0
            elif len(held) >= most_rows or size >= most_text:
                yield from opened()
                long, held, size = True, [], 0
            begun, conv = True, row["conv_id"]
            held.append(Row(row["turn"], row["role"], row["text"], row["copies"]))
            size += len(row["text"])
        if begun:  # the next partition may go on with it
            yield from opened()

    return work


def segment_pass(rows: Iterator[dict]) -> Iterator[dict]:
    """Per segment the best audits between all states, and its rows without the texts of those that must go."""

    def said(key: tuple, run: Run) -> dict:
        best = [[b and (b[0], b[1].text()) for b in own] for own in run.best]
        return {"conv_id": key[0], "part": key[1], "segment": key[2], "at": -1, "summary": json.dumps([vars(run.tally), best])}

    key, run = None, None
    for row in rows:
        own = (row["conv_id"], row["part"], row["segment"])
        if run is None or own != key:
            if run is not None:
                yield said(key, run)
            key, run = own, Run((START, SYSTEM, USER, ASSISTANT))
        for k in range(row["copies"]):
            stays = run.add(Row(row["turn"], row["role"], row["text"], 1), row["seen"] or k > 0)
            yield {"conv_id": own[0], "part": own[1], "segment": own[2], "at": row["at"], "role": row["role"], "text": row["text"] if stays else ""}
    if run is not None:
        yield said(key, run)


def joined_pass(messages: bool) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Joins the segments of each conversation in order; its summaries come before its rows."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        conv, begun, tally, best, repaired, digest, cost, k = None, False, Tally(), [], None, Digest(), 0, 0

        def heard(said: Iterable[tuple[str, str]]) -> Iterator[dict]:
            nonlocal k
            if not messages:
                digest.add(said)
                return
            for role, text in said:
                yield {"conv_id": conv, **message(k, role, text)}
                k += 1

        def opened() -> None:
            nonlocal repaired, cost
            if repaired is None:
                cost, piece = closed(best)
                repaired = Repaired(piece.text())

        def ended() -> Iterator[dict]:
            opened()
            yield from heard(repaired.new())
            if not messages:
                yield {"conv_id": conv, **found(tally, cost, repaired.audit, digest.sha.hexdigest())}

        for row in rows:
            if not begun or row["conv_id"] != conv:
                if begun:
                    yield from ended()
                conv, begun, tally, repaired, digest, k = row["conv_id"], True, Tally(), None, Digest(), 0
                best = [(0, Piece()), None, None, None]
            if row["summary"] is not None:
                counts, moves = json.loads(row["summary"])
                tally = tally.then(Tally(**counts))
                best = [least([(best[p][0] + moves[p][q][0], best[p][1], moves[p][q][1]) for p in range(4) if best[p] and moves[p][q]]) for q in range(4)]
            else:
                opened()
                yield from heard(repaired.row(row["role"], row["text"]))
        if begun:
            yield from ended()

    return work


def ordered(*keys: str) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def passes(rows: DataFrame, messages: bool, most_rows: int, most_text: int) -> DataFrame:
    kind = rows.schema["conv_id"]
    result = T.StructType.fromDDL("place long, role string, text string" if messages else FOUND)
    place = T.StructType([T.StructField(kind.name, kind.dataType)]).add("part", "integer").add("segment", "integer").add("at", "long")
    row = T.StructType([*place.fields]).add("turn", "long").add("role", "string").add("text", "string").add("copies", "integer").add("open", "boolean")
    both = T.StructType([*row.fields, *(f for f in result.fields if f.name not in row.fieldNames())])
    prefix = F.struct(F.substring("role", 1, 64), F.substring("text", 1, 64))
    placed = rows.repartitionByRange(*ordered("conv_id", "turn"), prefix).sortWithinPartitions(*ordered("conv_id", "turn", "role", "text"))
    first = stored(streamed(placed, both, sorted_pass(messages, most_rows, most_text)), "conversations")
    names = [kind.name, *result.fieldNames()]
    cut = first.where("open").drop("open", *(c for c in result.fieldNames() if c not in row.fieldNames()))
    same = (F.col("conv_id"), F.col("role"), F.sha2("text", 256))
    earliest = cut.where("copies > 0").groupBy(same[0].alias("own"), same[1].alias("own_role"), same[2].alias("own_text")).agg(F.min(F.struct("part", "at")).alias("first"))
    on = same[0].eqNullSafe(F.col("own")) & (same[1] == F.col("own_role")) & (same[2] == F.col("own_text"))
    seen = cut.join(earliest, on, "left").withColumn("seen", F.coalesce(F.struct("part", "at") != F.col("first"), F.lit(False)))
    seen = seen.select(*place.fieldNames(), "turn", "role", "text", "copies", "seen").repartition("conv_id", "part", "segment").sortWithinPartitions(*ordered("conv_id", "part", "segment", "at"))
    summary = T.StructType([*place.fields]).add("role", "string").add("text", "string").add("summary", "string")
    parts = streamed(seen, summary, segment_pass).repartition("conv_id").sortWithinPartitions(*ordered("conv_id"), F.col("summary").isNull(), *ordered("part", "segment", "at"))
    return first.where("not open").select(names).unionByName(streamed(parts, T.StructType([place.fields[0], *result.fields]), joined_pass(messages)))


def audited(rows: DataFrame, most_rows: int = ROWS, most_text: int = TEXT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``damaged`` or ``plain``."""
    return passes(rows, False, most_rows, most_text)


def repaired(rows: DataFrame, most_rows: int = ROWS, most_text: int = TEXT) -> DataFrame:
    """(conv_id, place, role, text): the messages of every repaired conversation of ``damaged`` or ``plain``, from place 0."""
    return passes(rows, True, most_rows, most_text)


def sql(conversations: str) -> str:
    """DuckDB SQL for ``audited(damaged(...))``; states are structs of cost, audit and repaired messages, which compare in that order."""
    NEVER = "1000000000000"  # noqa: N806

    def edit(cost: str, audit: str = "''", messages: str = "''") -> str:
        return f"{{c: {cost}, a: {audit}, o: {messages}}}"

    def delete(q: str) -> str:
        return edit(f"{q}.c + {DELETE}", f"{q}.a || 'D'", f"{q}.o")

    def keep(q: str, initial: str) -> str:
        return edit(f"{q}.c + x + CASE WHEN i = '{initial}' THEN 0 ELSE {NEVER} END", f"{q}.a || 'K'", f"{q}.o || chr(10) || role || ':' || text")

    def rerole(q: str, name: str) -> str:
        return edit(f"{q}.c + x + {REROLE}", f"{q}.a || 'R'", f"{q}.o || chr(10) || '{name}:' || text")

    def insert(q: str, name: str) -> str:
        return edit(f"{q}.c + {INSERT}", f"{q}.a || 'I'", f"{q}.o || chr(10) || '{name}:'")

    return rf"""
WITH RECURSIVE steps AS (  -- the table of the checksum, by its rule
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM {conversations}, steps
), rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM rows
), faults AS (
  SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY k), 1) AS pair
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faults GROUP BY conv_id
), walk AS (  -- the best edits that leave nothing, a system, a user's or an assistant's message last
  SELECT conv_id, 0::BIGINT AS k, {edit("0")} AS s0, {edit(NEVER)} AS s1, {edit(NEVER)} AS s2, {edit(NEVER)} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, k, list_min([{delete("s0")}]), list_min([{delete("s1")}, {keep("s0", "s")}]),
         list_min([{delete("u")}, {keep("s0", "u")}, {keep("s1", "u")}, {keep("a", "u")}, {rerole("s0", "user")}, {rerole("s1", "user")}, {rerole("a", "user")}]),
         list_min([{delete("a")}, {keep("u", "a")}, {rerole("u", "assistant")}])
  FROM (SELECT *, list_min([s3, {insert("u", "assistant")}]) AS a
        FROM (SELECT w.conv_id, f.k, s0, s1, s3, list_min([s2, {insert("s0", "user")}, {insert("s1", "user")}, {insert("s3", "user")}]) AS u,
                     role, text, i, CASE WHEN blank OR again THEN {NEVER} WHEN cut THEN 5 ELSE 0 END AS x
              FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = w.k + 1))
), ends AS (
  SELECT conv_id, k, s0, s3, list_min([s2, {insert("s0", "user")}, {insert("s1", "user")}, {insert("s3", "user")}]) AS u FROM walk
), best AS (
  SELECT conv_id, k, list_min([s0, s3, {insert("u", "assistant")}]) AS b FROM ends
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = c.n
"""
