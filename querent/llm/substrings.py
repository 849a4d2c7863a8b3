"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: after end marks, at line feeds, and where a capital follows a small letter without an end
mark, as it does where one text was set into another. What runs on for more than ``LONG`` words is cut at words that its own
content chooses. From each sentence on, the shortest run of ``least`` sentences or more with ``words`` words or more is hashed
without regard to case and white space. A text that is too short for such a run is one run, so that its copies go too. The
hashes of all documents are joined, and a sentence goes if a run that covers it has stood before: earlier in its document,
or in a document with a smaller doc_id. What first occurs stays.

Runs are compared by 64-bit hashes: of n distinct runs about n squared over 2^65 pairs meet by chance (none are to be
expected below 6 x 10^9 runs).

Nulls and edges: a null text stays null, an empty one empty. A doc_id may be of any type that has an order; null comes after all others. Rows of the same
doc_id count as one document: they take nothing from each other, and what a smaller doc_id has goes from all of them.
Very long texts and texts of nothing but end marks take linear time. Repeated rows give repeated rows, an empty table none;
other columns, whatever their names, are ignored by ``spans`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from querent.llm.arrow import by_columns, free_name, slices
from querent.session import stored

#: Fewest sentences and words of a span; words of a sentence before it is cut by content.
LEAST, WORDS, LONG = 2, 15, 24

# End marks are tried from the first of a row only, so that a row that no space follows is read once.
BREAK = re.compile(r"(?<![.!?…])[.!?…]++[\"'»”)\]]*+(?:\s+|\Z)|\n\s*|(?<=[a-zß-ÿ]) (?=[A-ZÀ-Þ])")
WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences; together they are the text."""
    out, at = [], 0
    for end in (*(m.end() for m in BREAK.finditer(text)), len(text)):
        if end <= at:
            continue
        words = text[at:end].lower().split()
        if len(words) > LONG:
            start, own = at, []
            for m in WORD.finditer(text, at, end):
                own.append(m[0].strip().lower())
                if zlib.crc32(own[-1].encode()) % 16 == 0:
                    out.append((start, m.end(), own))
                    start, own = m.end(), []
            if own or start < end:
                out.append((start, end, own))
        else:
            out.append((at, end, words))
        at = end
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def runs(parts: list[tuple[int, int, list[str]]], least: int, words: int) -> list[tuple[int, int, int]]:
    """(hash, first, end) of the span from each sentence on; sentences without words neither start nor count."""
    counted = [k for k, p in enumerate(parts) if p[2]]
    texts = [" ".join(parts[k][2]) for k in counted]
    sizes = [len(parts[k][2]) for k in counted]
    out, end, held = [], 0, 0
    for k in range(len(counted)):
        while end < len(counted) and (held < words or end - k < least):
            held += sizes[end]
            end += 1
        if held < words or end - k < least:
            break
        value = xxh64_intdigest("\n".join(texts[k:end]).encode(), 7)
        out.append((signed(value), counted[k], counted[end - 1] + 1))
        held -= sizes[k]
    if counted and not out:
        out.append((signed(xxh64_intdigest("\n".join(texts).encode(), 7)), 0, len(parts)))
    return out


def removed(text: str, seen_elsewhere: set[int], least: int, words: int) -> tuple[int, list[tuple[int, int]], int]:
    """The number of sentences, the stretches that go, and how many sentences those are."""
    parts = sentences(text)
    gone = bytearray(len(parts))
    known: set[int] = set()
    for value, first, end in runs(parts, least, words):
        if value in known or value in seen_elsewhere:
            gone[first:end] = b"\1" * (end - first)
        known.add(value)
    stretches: list[tuple[int, int]] = []
    for k, (start, end, _) in enumerate(parts):
        if gone[k]:
            if stretches and stretches[-1][1] == start:
                stretches[-1] = (stretches[-1][0], end)
            else:
                stretches.append((start, end))
    return len(parts), stretches, sum(gone)


def occurrences(docs: DataFrame, least: int, words: int) -> DataFrame:
    """(value, doc_id): the distinct spans of each row."""
    schema = T.StructType([T.StructField("value", T.LongType()), docs.schema["doc_id"]])

    def run(batches):
        for part in slices(batches):
            values, rows = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                own = {v for v, _, _ in runs(sentences(text), least, words)} if text else ()
                values += own
                rows += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), part.column("doc_id").take(pa.array(rows, pa.int64()))], ["value", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def seen_before(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(span_doc, span_values): for each document the spans that a document with a smaller doc_id has; null is larger than all."""
    found = stored(occurrences(docs, least, words).withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")), "spans")
    first = found.groupBy("value").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first < final").select("value", "first")
    later = found.join(stored(first, "repeated-spans"), "value").where("place > first")
    return later.groupBy(F.col("doc_id").alias("span_doc")).agg(F.collect_set("value").alias("span_values"))


def with_seen(docs: DataFrame, least: int, words: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans that smaller ids have, and the name of that column."""
    doc, values = free_name("span_doc", docs.columns), free_name("span_values", docs.columns)
    before = stored(seen_before(docs, least, words), "seen").toDF(doc, values)
    return docs.join(before, F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(doc), values


def spans(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed_spans, text): stretches of code points that go, and what is left."""
    own = docs.schema["doc_id"]
    schema = T.StructType([own, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.StringType()), T.StructField("text", T.StringType())])

    rows, values = with_seen(docs.select("doc_id", "text"), least, words)

    def work():
        def function(rows):
            out: dict[str, list] = {c: [] for c in schema.names}
            for doc_id, text, seen in zip(rows["doc_id"], rows["text"], rows[values], strict=True):
                n, stretches, gone = removed(text or "", set(seen or ()), least, words)
                row = (doc_id, n, gone, ",".join(f"{a}:{b}" for a, b in stretches), None if text is None else without(text, stretches))
                for c, v in zip(schema.names, row, strict=True):
                    out[c].append(v)
            return out

        return function

    return by_columns(rows, schema, work)


def without(text: str, stretches: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for start, end in stretches:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def deduplicated(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """``docs`` without repeated spans, with ``n_chars``, if there is one, brought up to date."""
    schema = docs.schema
    rows, values = with_seen(docs, least, words)

    def work():
        def function(rows):
            texts = [None if t is None else without(t, removed(t, set(s or ()), least, words)[1]) for t, s in zip(rows["text"], rows[values], strict=True)]
            out = {c: rows[c] for c in schema.names} | {"text": texts}
            if "n_chars" in schema.names:
                out["n_chars"] = [n if t is None else len(t) for n, t in zip(rows["n_chars"], texts, strict=True)]
            return out

        return function

    return by_columns(rows, schema, work)
