"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Node v stands for the pieces and the rest that greedy longest-match-first
leaves when it has read v's string: ``link[v]`` is the node of the rest once the longest pieces that can be closed are
popped, and ``popped[v]`` says how many that were. Where the trie has no child for the next letter, the popped count is
added and the link followed, so a word takes time linear in its length and no piece is ever built. A link is found from
the parent's, breadth first, by the same steps.

A word-initial piece and a continuation are told apart by a mark: the word is read as a start mark and its bytes. A word
that the vocabulary can't spell counts as ``unknown`` pieces (one, as an unknown token does).

Nulls and edges: a null text is empty; an empty text has no words. Words are parted by white space of ASCII; very long
words and texts take linear time. Repeated rows give repeated rows, an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from querent.llm.arrow import by_columns

#: Words whose counts a worker remembers.
REMEMBERED = 200_000


class Automaton:
    """``initial`` pieces start a word, ``following`` pieces go on with it; both as bytes without marks."""

    START = 256

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes], unknown: int = 1):
        self.unknown = unknown
        self.child: list[dict[int, int]] = [{}, {}]  # node 0: between pieces; node 1: the start mark has been read
        self.child[0][self.START] = 1
        self.link: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for first, pieces in ((1, initial), (0, following)):
            for piece in pieces:
                node = first
                for byte in piece:
                    if (to := self.child[node].get(byte)) is None:
                        to = self.child[node][byte] = len(self.child)
                        self.child.append({})
                        self.link.append(-1)
                        self.popped.append(0)
                    node = to
                if piece:
                    ends.add(node)
        queue = [0, 1]
        for node in queue:
            for byte, to in self.child[node].items():
                if to == 1:
                    continue
                queue.append(to)
                if to in ends:  # a whole piece is popped, nothing is left
                    self.link[to], self.popped[to] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and byte not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[to], self.popped[to] = self.child[at][byte], count

    def count(self, word: bytes) -> int:
        """The number of pieces of a word."""
        if not word:
            return 0
        child, link, popped = self.child, self.link, self.popped
        node, total = 1, 0
        for byte in word:
            while (to := child[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return self.unknown
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return self.unknown
        return total


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and following pieces of a public byte-level file: pieces with a leading space start words."""
    import json

    from querent.llm.bpe import byte_alphabet

    letters = byte_alphabet()
    with open(path, encoding="utf-8") as file:
        vocabulary = [bytes(letters[c] for c in piece) for piece in json.load(file)["model"]["vocab"]]
    return [p[1:] for p in vocabulary if p[:1] == b" " and len(p) > 1], [p for p in vocabulary if p[:1] != b" "]


@lru_cache(maxsize=2)
def worker_count(path: str) -> Callable[[bytes], int]:
    """The piece count of a word, by one automaton for all tasks of a Python worker."""
    automaton = Automaton(*pieces_of(path))
    known: dict[bytes, int] = {}

    def count(word: bytes) -> int:
        if (found := known.get(word)) is None:
            found = automaton.count(word)
            if len(known) < REMEMBERED and len(word) <= 64:
                known[word] = found
        return found

    return count


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text, with the pieces of a public byte-level vocabulary file."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work():
        count = worker_count(path)

        def function(rows):
            words = [(t or "").encode().split() for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_words": list(map(len, words)), "n_tokens": [sum(map(count, w)) for w in words]}

        return function

    return by_columns(docs.select("doc_id", "text"), schema, work)
