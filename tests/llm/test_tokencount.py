import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, initial, following, unknown=1):
    """The longest piece each time."""
    at = n = 0
    while at < len(word):
        pieces = following if n else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return unknown
        at, n = end, n + 1
    return n


piece = st.text(alphabet="abc", min_size=1, max_size=5).map(str.encode)


@settings(max_examples=500, deadline=None)
@given(st.sets(piece, max_size=12), st.sets(piece, max_size=12), st.lists(st.text(alphabet="abcd", max_size=14).map(str.encode), max_size=10))
def test_counts_are_those_of_greedy_longest_match(initial, following, words):
    automaton = tokencount.Automaton(initial, following)
    for w in words:
        assert automaton.count(w) == greedy(w, initial, following)


def test_public_vocabulary():
    initial, following = map(set, tokencount.pieces_of(PATH))
    automaton = tokencount.Automaton(sorted(initial), sorted(following))
    rnd = random.Random(1)
    for _ in range(400):
        word = "".join(rnd.choice(["the", "tion", "é", "ß", "日", "x", "12", "!", "ing", "un"]) for _ in range(rnd.randint(1, 9))).encode()
        assert automaton.count(word) == greedy(word, initial, following)
    assert automaton.count(b"a" * 100_000) > 1000


def test_query(spark):
    initial, following = map(set, tokencount.pieces_of(PATH))
    texts = [None, "", " \n", "the thing", "Ärger  über\tÖl", "x" * 3000, "the thing", "word " * 20000]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.counted(docs, PATH).collect()}
    for k, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[k] == (len(words), sum(greedy(w, initial, following) for w in words))
    assert tokencount.counted(docs.limit(0), PATH).collect() == []
