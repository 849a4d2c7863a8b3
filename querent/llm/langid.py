"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters other than letters and marks becomes one space, and a space is put at both
ends. Each run of one to three characters of that is hashed into a bucket. Training counts the buckets of every learned
document in tasks and sums them by (language, bucket); smoothed, they give a matrix of log probabilities with a row per
language, beside the log shares of documents. Tasks score batches of texts as rows of sparse counts against that matrix;
a text is worked through in blocks, so its length costs time alone.

The matrix is what is broadcast and what the driver holds: at most ``CELLS`` numbers, whatever the corpus; with more
languages it has fewer buckets, and more than ``LANGUAGES`` values of lang are an error.

Documents with crc32(doc_id as text) mod ``folds`` = ``fold`` are held out; the others with a lang are learned, all of them,
whole. lang, source and doc_id are no part of a prediction.

Nulls and edges: null and empty texts, those without a letter, and all texts where nothing could be learned are ``und`` with
a score of 0. A null doc_id is an empty text for the fold. A null lang isn't learned, an empty one is a language like others.
Of languages with equal scores the one with the smaller name is predicted. Equal texts fare alike. Repeated rows give
repeated rows, an empty table none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.llm.arrow import by_columns, free_name, memory_returned, slices
from querent.session import stored

#: The longest n-gram, log2 of the number of buckets, most cells of the matrix, most languages.
LONGEST, BITS, CELLS, LANGUAGES = 3, 16, 1 << 23, 8192
#: Characters of a text that are worked through at once, and cells of the batches that are scored at once.
BLOCK, BATCH = 1 << 18, 1 << 20
UNDETERMINED = "und"
SPACE = np.uint64(32)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of every code point, whether it is a letter or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def words(text: str, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The code points of a text as n-grams see them, in blocks."""
    space = False
    for at in range(0, len(text), block):
        codes = np.frombuffer(text[at : at + block].lower().encode("utf-32-le"), np.uint32)
        codes = np.where(letters()[codes], codes, 32).astype(np.uint64)
        gap = codes == SPACE
        codes = codes[~(gap & np.concatenate([[space or at == 0], gap[:-1]]))]
        if at == 0:
            codes = np.concatenate([[SPACE], codes])
        if len(codes):
            space = bool(codes[-1] == SPACE)
            yield codes
    if not space:
        yield np.array([SPACE])


def buckets(codes: np.ndarray, new: int, bits: int) -> np.ndarray:
    """The buckets of the n-grams that end in the last ``new`` of ``codes``."""
    found, rolled = [], np.zeros(len(codes), np.uint64)
    for n in range(LONGEST):
        rolled = (rolled[:-1] if n else rolled) * FACTORS[0] + codes[n:]
        own = rolled[max(len(codes) - new - n, 0) :]
        mixed = (own + FACTORS[1:2] * np.uint64(n + 1)) * FACTORS[2]
        found.append(((mixed ^ (mixed >> np.uint64(29))) * FACTORS[0]) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64)


def counts(text: str, bits: int, block: int = BLOCK) -> np.ndarray:
    """How often a text has an n-gram of each bucket."""
    total, last = np.zeros(1 << bits, np.int64), np.empty(0, np.uint64)
    for codes in words(text, block):
        joined = np.concatenate([last, codes])
        total += np.bincount(buckets(joined, len(codes), bits), minlength=1 << bits)
        last = joined[-(LONGEST - 1) :]
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held(doc_id: Column, fold: int, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass
class Model:
    """``likely[bucket, language]`` is the log probability of a bucket, ``prior`` that of a language."""

    languages: list[str]
    likely: np.ndarray
    prior: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.likely).bit_length() - 1

    def predicted(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability."""
        names, scores, batch = [], [], []
        for text in texts:
            names.append(UNDETERMINED)
            scores.append(0.0)
            if self.languages and has_letter(text):
                total = counts(text, self.bits)
                own = np.flatnonzero(total)
                batch.append((len(names) - 1, own, total[own]))
                if sum(len(b[1]) for b in batch) * len(self.languages) > BATCH:
                    self.judge(batch, names, scores)
                    batch = []
        self.judge(batch, names, scores)
        return names, scores

    def judge(self, batch: list[tuple[int, np.ndarray, np.ndarray]], names: list[str], scores: list[float]) -> None:
        if not batch:
            return
        starts = np.cumsum([0, *(len(b[1]) for b in batch[:-1])])
        cells = self.likely[np.concatenate([b[1] for b in batch])] * np.concatenate([b[2] for b in batch])[:, None]
        logs = np.add.reduceat(cells, starts, axis=0) + self.prior
        best = logs.argmax(axis=1)
        chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for (k, _, _), language, score in zip(batch, best, chance, strict=True):
            names[k], scores[k] = self.languages[language], float(score)


def counted(rows: DataFrame, languages: list[str], bits: int) -> DataFrame:
    """(language, bucket, n) of every task: the n-grams of the rows' texts by the place of their lang in ``languages``."""
    place = {name: k for k, name in enumerate(languages)}
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(*part.to_pydict().values(), strict=True):
                if has_letter(text):
                    own, k = counts(text, bits), place[lang]
                    totals[k] = totals[k] + own if k in totals else own
        for k, total in totals.items():
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(total[own])], schema=schema)
        memory_returned()

    return rows.select("lang", "text").mapInArrow(run, "language int, bucket int, n long")


def trained(docs: DataFrame, folds: int = 3, fold: int = 1, bits: int = BITS, smoothing: float = 0.5) -> Model:
    """The model of the documents that have a lang and aren't held out."""
    rows = docs.where(~held(docs["doc_id"], fold, folds) & docs["lang"].isNotNull()).select("lang", "text")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).toArrow()
    languages = found.column("lang").to_pylist()
    if len(languages) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    while len(languages) << bits > CELLS:
        bits -= 1
    total = np.zeros((1 << bits, len(languages)))
    if languages:
        sums = stored(counted(rows, languages, bits).groupBy("language", "bucket").agg(F.sum("n").alias("n")), "ngrams")
        got = sums.toArrow()
        total[got.column("bucket").to_numpy(), got.column("language").to_numpy()] = got.column("n").to_numpy()
    likely = np.log((total + smoothing) / (total.sum(axis=0) + smoothing * len(total)))
    shares = found.column("n").to_numpy()
    return Model(languages, likely.astype(np.float32), np.log(shares / max(shares.sum(), 1)))


def identified(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work():
        def function(rows):
            names, scores = shared.value.predicted(rows["text"])
            out = [zlib.crc32(("" if d is None else str(d)).encode()) % folds == fold for d in rows["doc_id"]]
            return {"doc_id": rows["doc_id"], "held_out": out, "lang_pred": names, "score": scores}

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)


def labelled(docs: DataFrame, model: Model, column: str = "lang_pred") -> DataFrame:
    """The rows of ``docs`` with their language in a further column, whose name is made longer where it is taken."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(column, docs.columns)

    def run(batches):
        for part in slices(batches):
            found = shared.value.predicted(part.column("text").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, name])
        memory_returned()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
