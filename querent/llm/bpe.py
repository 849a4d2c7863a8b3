"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the UTF-8 bytes cuts each text where its own content says so, so passages that documents share give
the same chunks wherever they stand. A chunk is encoded once for as long as it stays in the worker's cache, whose size
is bounded. At each join the tokens of the two chunks can be wrong: from the last token that ends where words must part
in the left chunk to the first such token in the right one, the text is encoded again. If a chunk has none, the stretch
goes on into the next chunk. What is kept agrees on both sides with the tokens of the whole text, so the ids are exactly
those of the tokenizer.

Words must part before a space or line feed that follows a visible ASCII character: no pre-token and no added token of
a byte-level tokenizer runs over that place, and neither side depends on the other.

Nulls and edges: a null text is empty; an empty text has no tokens. Very long texts are cut like all others, a stretch
without a place where words must part being one piece; long runs of white space in one are words of their own. Repeated rows give repeated rows, an empty table none; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from querent.functions.tokens import LONG_SPACE, stretches, word_tokens
from querent.llm.arrow import by_columns

#: Bytes of the rolling window (a power of two), log2 of the mean chunk length, most bytes of a chunk, bytes of cached chunks of a worker.
WINDOW, MEAN_BITS, LONGEST, CACHE_BYTES = 32, 10, 1 << 14, 32 << 20
# Fixed value: the pattern by which byte-level BPE files part words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BASE, SPREAD = np.uint32(0x08104225), np.uint32(0x9E3779B1)


def cuts(data: bytes, window: int = WINDOW, mean_bits: int = MEAN_BITS, longest: int = LONGEST) -> list[int]:
    """Where chunks end: after a window whose hash says so, at the start of a character, or ``longest`` bytes on."""
    array = np.frombuffer(data, np.uint8)
    if len(array) <= window:
        return [len(array)] if len(array) else []
    rolled, factor, width = array.astype(np.uint32), BASE, 1
    while width < window:
        rolled = rolled[:-width] * factor + rolled[width:]
        factor, width = np.uint32(int(factor) ** 2 & 0xFFFFFFFF), 2 * width
    starts = (array & 0xC0) != 0x80
    chosen = np.flatnonzero((rolled * SPREAD) >> np.uint32(32 - mean_bits) == 0) + window
    ends = [int(x) for x in chosen if x < len(array) and starts[x]] + [len(array)]
    out, at = [], 0
    for end in ends:
        while end - at > longest:
            at += longest
            while not starts[at]:
                at -= 1
            out.append(at)
        out.append(end)
        at = end
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunk(NamedTuple):
    """Tokens of a chunk; those from ``first`` to ``last`` stand wherever the chunk does, and cover bytes ``start`` to ``end``."""

    ids: np.ndarray
    first: int
    last: int
    start: int
    end: int


class ChunkedBpe:
    """Encoder and decoder for one file of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, **chunking: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in white space")
        letters = byte_alphabet()
        pieces = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.ranks = self.ranked(spec)
        if self.ranks is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        self.chunking, self.cache_bytes = chunking, cache_bytes
        self.cache: OrderedDict[tuple[bytes, bool], Chunk] = OrderedDict()
        self.held = 0
        self.encoded_chunks = self.used_chunks = 0

    def ranked(self, spec: dict):
        """The same merges as a table of ranks, which a faster library runs; none where ids aren't in the order of merges."""
        own = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        vocabulary = spec["model"]["vocab"]
        if any(vocabulary.get("".join(m)) != 256 + k for k, m in enumerate(own)) or sorted(vocabulary.values()) != list(range(256 + len(own))):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {piece: k for k, piece in enumerate(self.pieces[: len(vocabulary)])}
        self.special = frozenset(special)
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def raw(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.ranks is not None:
            return [self.ranked_ids(t.decode()) for t in texts]
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def ranked_ids(self, text: str) -> np.ndarray:
        """The ids of a text, its long runs of white space as the single words that they are."""
        whole = lambda part: self.ranks.encode_to_numpy(part, allowed_special=self.special, disallowed_special=())
        if len(text) < LONG_SPACE:
            return whole(text)
        return np.concatenate([np.array(word_tokens(self.ranks, part), np.uint32) if space else whole(part) for part, space in stretches(text)])

    def chunk(self, data: bytes, ids: np.ndarray) -> Chunk:
        array = np.frombuffer(data, np.uint8)
        parts = np.flatnonzero(((array[1:] == 0x20) | (array[1:] == 0x0A)) & (array[:-1] > 0x20) & (array[:-1] < 0x7F)) + 1
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, parts)
        agreed = ends[np.minimum(at, len(ends) - 1)] == parts if len(ends) else np.zeros(0, bool)
        if not agreed.any():
            return Chunk(ids, -1, -1, -1, -1)
        at, parts = at[agreed] + 1, parts[agreed]
        return Chunk(ids, int(at[0]), int(at[-1]), int(parts[0]), int(parts[-1]))

    def chunks(self, wanted: list[bytes], join: bool = False) -> dict[bytes, Chunk]:
        """Each distinct chunk, from the cache or encoded now; of a join only the ids are needed."""
        found: dict[bytes, Chunk] = {}
        missing = []
        for data in dict.fromkeys(wanted):
            if (known := self.cache.get((data, join))) is not None:
                self.cache.move_to_end((data, join))
                found[data] = known
            else:
                missing.append(data)
        for data, ids in zip(missing, self.raw(missing), strict=True):
            found[data] = self.cache[data, join] = Chunk(ids, -1, -1, -1, -1) if join else self.chunk(data, ids)
            self.held += len(data) + 4 * len(ids) + 300
        if not join:
            self.encoded_chunks += len(missing)
            self.used_chunks += len(wanted)
        while self.held > self.cache_bytes:
            (data, _), old = self.cache.popitem(last=False)
            self.held -= len(data) + 4 * len(old.ids) + 300
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every whole text."""
        whole = [(t or "").encode() for t in texts]
        split = [[data[a:b] for a, b in zip([0, *ends], ends, strict=False)] for data in whole for ends in [cuts(data, **self.chunking)]]
        known = self.chunks([c for own in split for c in own])
        plans = []
        for data, own in zip(whole, split, strict=True):
            plan: list[np.ndarray | bytes] = []  # ids that stay, and stretches to encode again
            open_at, place = 0, 0
            for k, c in enumerate(own):
                chunk = known[c]
                if k == 0 and len(own) == 1:
                    plan.append(chunk.ids)
                    open_at = len(c)
                elif k == 0:
                    if chunk.first >= 0:
                        plan.append(chunk.ids[: chunk.last])
                        open_at = chunk.end
                elif chunk.first >= 0 or k == len(own) - 1:
                    if chunk.first < 0:
                        break  # the rest is encoded again
                    plan.append(data[open_at : place + chunk.start])
                    last = k == len(own) - 1
                    plan.append(chunk.ids[chunk.first : None if last else chunk.last])
                    open_at = len(data) if last else place + chunk.end
                place += len(c)
            if open_at < len(data):
                plan.append(data[open_at:])
            plans.append(plan)
        joins = self.chunks([x for plan in plans for x in plan if isinstance(x, bytes)], join=True)
        return [np.concatenate([joins[x].ids if isinstance(x, bytes) else x for x in plan]) if plan else np.empty(0, np.uint32) for plan in plans]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, added tokens included."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def worker_bpe(path: str) -> ChunkedBpe:
    """One encoder for all tasks of a Python worker."""
    return ChunkedBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): every whole text as token ids."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work():
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [x.astype(np.int32) for x in worker_bpe(path).encode(rows["text"])]}

    return by_columns(docs.select("doc_id", "text"), schema, work)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text of every row of ids; null ids have a null text."""
    schema = T.StructType([tokens.schema["doc_id"], T.StructField("text", T.StringType())])

    def work():
        bpe = worker_bpe(path)
        return lambda rows: {"doc_id": rows["doc_id"], "text": [None if x is None else bpe.decode(np.array(x, np.int64)) for x in rows["ids"]]}

    return by_columns(tokens.select("doc_id", "ids"), schema, work)


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding of every whole text in one pass; the ids too if asked for."""
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([*ids_field, docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def work():
        bpe = worker_bpe(path)

        def function(rows):
            ids = bpe.encode(rows["text"])
            return {
                "ids": [x.astype(np.int32) for x in ids] if with_ids else [],
                "doc_id": rows["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)
