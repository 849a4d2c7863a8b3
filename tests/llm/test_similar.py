import random

import pytest

from querent.llm import similar, simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def planted(seed=3, pairs=120):
    """(text, edited copy) at similarities of 0.8 to 0.95."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    out = []
    while len(out) < pairs:
        base = [word() for _ in range(rnd.randint(40, 300))]
        own = list(base)
        for _ in range(rnd.randint(1, max(1, len(base) // 45))):
            own[rnd.randrange(len(own))] = word()
        if 0.8 <= jaccard(" ".join(base), " ".join(own)) <= 0.95:
            out.append((" ".join(base), " ".join(own)))
    return out


def test_planted_copies_go_that_four_bits_keep(spark):
    pairs = planted()
    docs = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.kept(docs).collect()) == [2 * k for k in range(len(pairs))]
    assert simhash.kept(docs).count() > 1.5 * len(pairs)


@pytest.mark.parametrize("cell_rows", [512, 4])
def test_groups_equal_those_of_all_pairs(spark, cell_rows):
    rnd = random.Random(8)
    texts = [t for p in planted(5, 20) for t in p]
    for base in texts[:4]:  # chains of edits, whose ends are not similar, and copies just below the bound
        own = base.split()
        for _ in range(12):
            own[rnd.randrange(len(own))] = "edit" + str(rnd.randrange(10**6))
            texts.append(" ".join(own))
    texts += ["", "one", "One", "two three", texts[0].upper()]
    rnd.shuffle(texts)
    low = [t.lower() for t in texts]
    root = list(range(len(low)))
    for i in range(len(low)):
        for j in range(i):
            if jaccard(low[i], low[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.kept(docs, cell_rows=cell_rows).collect()) == sorted(set(root))


def test_a_long_chain_sends_each_set_a_bounded_number_of_times(spark):
    """Sets of a chain in which neighbours are similar and others aren't: what is sent doesn't grow with the chain."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    sent = {}
    for n in (40, 400):
        words, docs = [word() for _ in range(60)], []
        for k in range(n):
            words = [*words[2:], word(), word()]
            docs.append((k, " ".join(words)))
        own = spark.createDataFrame(docs, "doc_id long, text string")
        assert [r.doc_id for r in similar.kept(own).collect()] == [0]
        flip, factor = similar.functions(42)
        sets = [(similar.key_of(s), len(s), similar.bands(s, flip, factor)) for s in (similar.shingled(t, 5, 42) for _, t in docs)]
        met = similar.bucketed(spark.createDataFrame(sets, "fp string, size long, bands array<long>"))
        sent[n] = (met.where("fp != first").select("fp", "first").distinct().count() + met.count()) / n
    assert sent[400] < 1.3 * sent[40]


def test_many_near_copies_are_joined_by_their_first(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(300):
        own = list(base)
        own[rnd.randrange(200)] = f"edit{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in similar.kept(docs, cell_rows=16).collect()] == [0]


def test_blocks_of_a_text_give_its_shingles():
    rnd = random.Random(6)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "Bé", " ", "\n", "\x0b", "word"]) for _ in range(rnd.randint(0, 60)))
        whole = [h for block in simhash.shingle_hashes(text, 3, 42) for h in block.tolist()]
        parts = [h for block in simhash.shingle_hashes(text, 3, 42, 5) for h in block.tolist()]
        assert whole == parts


def test_fingerprints_link_what_sets_do_not(spark):
    """Operator 10's links count too: texts of one repeated phrase have one fingerprint, though their sets of shingles differ."""
    phrase = "alpha beta gamma " * 200
    rows = [(3, phrase + "one two three four five six"), (4, phrase + "seven eight nine ten eleven twelve"), (5, "a text of its own")]
    assert [r.doc_id for r in similar.kept(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [3, 5]
