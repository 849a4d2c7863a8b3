"""Counterfactual-regularised toxicity classifier.

A text's features are the distinct byte n-grams of its lower-cased words with the spaces around them, hashed into buckets.
Of a bounded sample of labelled rows the buckets that tell the labels apart best are kept, and a logistic model is fitted
on them. For each sentence of those rows with an identity term, the sentence with the term swapped for another of its group
is the counterfactual: the model pays for the mean square of the change of the score's logit, so a term of a group can't
carry a verdict, and neutral mentions of groups aren't rejected. That square is a quadratic form of the weights, so tasks
sum its matrix over all sentences, and no sentence reaches the driver. The weights then score every whole text in blocks
of bytes. ``Model.counterfactuals`` says how many sentences were swapped.

Labels of documents with crc32(doc_id as text) mod ``folds`` = 0 are held out. The sample is bounded by ``sample_rows``
(the smallest hashes of doc_id), whose whole texts are used; everything else covers all rows. What reaches the driver is
bounded by ``sample_rows`` x ``features`` 16-bit numbers and ``features`` squared sums, whatever the length of the texts.

Nulls and edges: a null text is empty; an empty text has the score of no features. A null doc_id is an empty text for
the fold. Several labels of a document count as toxic if one does; null labels and those of unknown documents are left
out. With labels of one kind or none every score is the smoothed share of toxic labels. Equal buckets are chosen by the
smaller number. Repeated rows give repeated rows, an empty table none. Other columns, whatever their names, are ignored by
``scored`` and kept by ``kept``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.llm.arrow import by_columns, slices
from querent.session import stored

#: Bytes of an n-gram, and log2 of the number of buckets.
GRAM, BUCKET_BITS = 5, 20
#: Bytes of text that are scored at once.
BLOCK = 2 << 20
SPACES = bytes(32 if 9 <= c <= 13 or c == 0 else c for c in range(256))

# Groups of identity terms in English, German, French and Spanish; a term is swapped for the next one of its group.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("immigrant", "native", "refugee", "citizen"),
    ("disabled", "elderly", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("ausländer", "einheimische", "flüchtlinge", "einwanderer"),
    ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "asiáticos", "latinos", "árabes"),
    ("inmigrantes", "nativos", "refugiados", "ciudadanos"),
)
SENTENCE = re.compile(r"[^.!?…\n]+")


def swapper(groups: tuple[tuple[str, ...], ...]) -> Callable[[str], str]:
    """A function that swaps each identity term of a lower-cased text for the next of its group."""
    following = {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)}
    if not following:
        return lambda text: text
    pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")\b")
    return lambda text: pattern.sub(lambda m: following[m[0]], text)


def plain(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode().translate(SPACES) + b" "


def buckets(array: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    n = len(array) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    value = array[:n].astype(np.uint32)
    for k in range(1, GRAM):
        value *= np.uint32(0x01000193)
        value ^= array[k : k + n]
    value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    return value >> np.uint32(32 - BUCKET_BITS)


def gathered(texts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct features of each text; ``index`` has a bucket's feature, -1 for none."""
    rows, features, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        starts = np.cumsum([0, *(len(t) for t in texts[at:end])])
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        step = BLOCK  # one text may be longer than a block
        for a in range(0, len(data), step):
            own = index[buckets(data[a : a + step + GRAM - 1])]
            hit = np.flatnonzero(own >= 0)
            row = np.searchsorted(starts, hit + a, side="right") - 1
            inside = hit + a + GRAM <= starts[row + 1]
            rows.append(row[inside] + at)
            features.append(own[hit[inside]].astype(np.int64))
        at = end
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.concatenate(rows) << 32 | np.concatenate(features))
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Model:
    index: np.ndarray  # feature of each bucket, -1 for none
    weights: np.ndarray
    bias: float
    counterfactuals: int = 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, features = gathered([plain(t) for t in texts], self.index)
        margin = self.bias + np.bincount(rows, self.weights[features], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def in_fold(folds: int) -> Column:
    """Whether a row is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def sampled(docs: DataFrame, labels: DataFrame, folds: int, sample_rows: int) -> DataFrame:
    """(doc_id, toxic, text): labelled rows that aren't held out, at most ``sample_rows``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(folds)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))


def chosen_buckets(rows: DataFrame, features: int, least: int) -> list[int]:
    """The buckets that most change the chance of the label, of those in ``least`` rows or more."""

    def run(batches):
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for part in slices(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[toxic, np.unique(buckets(np.frombuffer(plain(text), np.uint8)))] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, counts[0, used], counts[1, used])], ["bucket", "clean", "toxic"])

    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(totals.t or 0), float(totals.n - (totals.t or 0))
    if not toxic or not clean:
        return []
    counts = rows.select("text", "toxic").mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= least)
    # the square of the difference of shares over its variance
    share = (F.col("clean") + F.col("toxic")) / (toxic + clean)
    apart = (F.col("toxic") / toxic - F.col("clean") / clean) ** 2 / (share * (1 - share) + 1e-3)
    return [r.bucket for r in counts.orderBy(apart.desc(), "bucket").limit(features).select("bucket").collect()]


def examples(rows: DataFrame, index: np.ndarray) -> pa.Table:
    """(toxic, features) of each row; there are fewer than 2^15 features."""

    def work():
        def function(part):
            row, features = gathered([plain(t) for t in part["text"]], index)
            cut = np.searchsorted(row, np.arange(len(part["text"]) + 1))
            return {"toxic": part["toxic"], "features": [features[a:b].astype(np.int16) for a, b in zip(cut, cut[1:], strict=False)]}

        return function

    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.ShortType()))])
    return by_columns(rows.select("text", "toxic"), schema, work).toArrow()


def swapped_sentences(text: str | None, swapped: Callable[[str], str]) -> list[tuple[str, str]]:
    """The sentences of a text that hold an identity term, each with its counterfactual."""
    low = (text or "").lower()
    if swapped(low) == low:
        return []
    return [(own, other) for own in SENTENCE.findall(low) if (other := swapped(own)) != own]


def counterfactuals(rows: DataFrame, index: np.ndarray, size: int, groups: tuple[tuple[str, ...], ...]) -> tuple[int, np.ndarray]:
    """How many sentences have a counterfactual, and the sum over them of d d^T, d the features that the swap takes less those it brings."""

    def run(batches):
        swapped, total, n = swapper(groups), None, 0
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                for pair in swapped_sentences(text, swapped):
                    row, features = gathered([plain(t) for t in pair], index)
                    change = np.zeros(size)
                    change[features[row == 0]] += 1
                    change[features[row == 1]] -= 1
                    own = np.flatnonzero(change)
                    total = np.zeros((size, size)) if total is None else total
                    total[np.ix_(own, own)] += np.outer(change[own], change[own])
                    n += 1
        a, b = np.nonzero(total) if n else (np.empty(0, np.int64),) * 2
        sums = total[a, b] if n else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, -1)), pa.array(np.append(b, -1)), pa.array(np.append(sums, float(n)))], ["a", "b", "sum"])

    found = rows.select("text").mapInArrow(run, "a long, b long, sum double").groupBy("a", "b").agg(F.sum("sum").alias("sum")).toArrow()
    a, b, sums = (found.column(c).to_numpy() for c in ("a", "b", "sum"))
    total = np.zeros((size, size))
    total[a[a >= 0], b[a >= 0]] = sums[a >= 0]
    return int(sums[a < 0].sum()), total


def fitted(found: pa.Table, size: int, swaps: tuple[int, np.ndarray], penalty: float, ridge: float, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted logistic loss, ``penalty`` times the mean squared change of
    counterfactuals and ``ridge`` times the squared weights, by Adam."""
    y = found.column("toxic").to_numpy().astype(float)
    lists = found.column("features").combine_chunks()
    rows = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    cols = lists.flatten().to_numpy().astype(np.int64)
    n, total = swaps
    share = (y.mean() * 0.5) ** 0.5  # of the loss for toxic rows: between their own share and a half
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(rows, w[cols], len(y)), -30, 30)))
        pull = weight * (p - y)
        g = np.append(np.bincount(cols, pull[rows], size) + ridge * w[:-1], pull.sum())
        if n:
            g[:-1] += 2 * penalty / n * (total @ w[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = 20_000, features: int = 2048, least: int = 3, penalty: float = 1.0, ridge: float = 5e-4, groups: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    rows = stored(sampled(docs, labels, folds, sample_rows).repartition(12, "doc_id"), "labelled")
    chosen = chosen_buckets(rows, features, least)
    index = np.full(1 << BUCKET_BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    if not chosen:
        totals = rows.agg(F.sum("toxic"), F.count("*")).first()
        share = ((totals[0] or 0) + 0.5) / (totals[1] + 1 + (0 if totals[1] else 1))
        return Model(index, np.zeros(0), float(np.log(share / (1 - share))))
    swaps = counterfactuals(rows, index, len(chosen), groups)
    return Model(index, *fitted(examples(rows, index), len(chosen), swaps, penalty, ridge), swaps[0])


def scored(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work():
        def function(rows):
            scores = model.scores(rows["text"])
            held = [zlib.crc32(("" if d is None else str(d)).encode()) % folds == 0 for d in rows["doc_id"]]
            return {"doc_id": rows["doc_id"], "held_out": held, "score": scores.tolist(), "predicted": (scores >= 0.5).astype(int).tolist()}

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(model.scores(part.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
