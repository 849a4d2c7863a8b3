"""Tokens of byte-level rank files."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

#: Characters of a run of white space from which on it is kept from the pattern that parts words, which would step back through all of it.
LONG_SPACE = 4096
# Fixed value: white space as the patterns of byte-level rank files know it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{SPACES}]{{{LONG_SPACE},}}")


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order: what the pattern has to part, and long runs of white space, which are one word each.

    The last character of a run goes with what follows, as in the pattern, and belongs to the run at the end of a text.
    """
    at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


@lru_cache(maxsize=2)
def public_encoding(path: str):
    """A byte-level encoding from a rank file of public tokenizers, read once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_tokens(encoding, word: str) -> list[int]:
    """The tokens of one word, whatever its length."""
    return encoding._encode_single_piece(word)


def ordinary_tokens(encoding, text: str) -> list[int]:
    """The tokens of a text without special ones."""
    if len(text) < LONG_SPACE:
        return encoding.encode_ordinary(text)
    return [t for part, space in stretches(text) for t in (word_tokens(encoding, part) if space else encoding.encode_ordinary(part))]
