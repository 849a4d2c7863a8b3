"""Vector columns in double arithmetic, and the default embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions.batches import memory_returned, slices


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Of length one; a zero vector stays. The length is worked out once, as the one element of an array."""
    length = F.array(norm(v))
    return F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


Embed = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=200_000)
def bucket(token: str, size: int) -> tuple[int, float]:
    """The dimension and sign of a token, from its md5."""
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % size, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0


def hash_embed(texts: list[str], size: int = 64) -> np.ndarray:
    """Signed counts of hashed tokens at unit length: the deterministic embedder that needs no model."""
    out = np.zeros((len(texts), size))
    for row, text in enumerate(texts):
        for token in text.lower().split():
            at, sign = bucket(token, size)
            out[row, at] += sign
    lengths = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(lengths == 0, 1, lengths)


def embedded(df: DataFrame, text: str = "text", into: str = "embedding", embed: Embed = hash_embed, batch_rows: int = 1024) -> DataFrame:
    """``df`` with the vector of ``text``; ``embed`` is called with lists of texts, a null text being empty."""
    schema = T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in slices(batches):
            for at in range(0, whole.num_rows, batch_rows):
                part = whole.slice(at, batch_rows)
                vectors = embed([t or "" for t in part.column(text).to_pylist()])
                columns = [pa.array(list(vectors), f.type) if f.name == into else part.column(f.name) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        memory_returned()

    return df.mapInArrow(run, schema)


def words_embedded(df: DataFrame, size: int = 64, into: str = "embedding") -> DataFrame:
    """(id, embedding) of (id, words, counts): what ``hash_embed`` makes of texts with these words, without the texts."""

    def run(batches):
        for batch in slices(batches):
            words = batch.column("words")
            each = words.flatten().dictionary_encode()
            places = np.array([bucket(w, size) for w in each.dictionary.to_pylist()] or np.empty((0, 2)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            code = each.indices.to_numpy()
            cell = row * size + places[code, 0].astype(np.int64)
            out = np.bincount(cell, places[code, 1] * batch.column("counts").flatten().to_numpy(), batch.num_rows * size).reshape(-1, size)
            lengths = np.sqrt((out**2).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out / np.where(lengths == 0, 1, lengths)), pa.list_(pa.float64()))], ["id", into])
        memory_returned()

    return df.select("id", "words", "counts").mapInArrow(run, T.StructType([df.schema["id"], T.StructField(into, T.ArrayType(T.DoubleType()))]))
