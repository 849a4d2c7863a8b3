import random

import numpy as np
import pytest
import xxhash

from querent.llm import simhash


def plain(text):
    """The contract's words, one bit at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in rows]


def texts(seed, groups, copies):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(1, 150))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


def test_fingerprint_is_that_of_the_contract():
    for t in [None, "", " \t\n", "one", "One TWO", "a b c d", "É ß ẞ İ x y", "a b c d e " * 300, *texts(1, 20, 2)]:
        assert simhash.fingerprint(t) == plain(t)


@pytest.mark.parametrize("cell_rows", [8192, 8])
def test_components_equal_those_of_all_pairs(spark, cell_rows):
    rows = list(enumerate([None, "", "", "one", *texts(2, 60, 6)]))
    rows += [(3, "one"), (None, ""), (None, "only a null id has this text of seven words"), (-5, texts(2, 60, 6)[7])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs, cell_rows=cell_rows).collect()
    want = brute([(d, plain(t)) for d, t in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("index", [[16, 16, 16, 16], [22, 21, 21], [32, 32]])
def test_links_lose_none_for_any_thresholds(spark, monkeypatch, index):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(8)}
    bits = list(range(64))
    rnd.shuffle(bits)
    parts, spare = [], 5 - len(index)
    for size in index:
        t = min(spare, 2)
        spare -= t
        parts.append(simhash.Partition(sum(1 << bits.pop() for _ in range(size)), t))
    assert sum(p.threshold + 1 for p in parts) == 5
    monkeypatch.setattr(simhash, "planned", lambda *_: parts)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute([(simhash.signed(f), f) for f in fps])
    got = {}
    for d, _, _ in want:
        got.setdefault(roots.get(d, d), set()).add(d)
    expected = {}
    for d, _, c in want:
        expected.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_plan_spends_the_distance_and_covers_the_bits():
    sample = np.random.default_rng(1).integers(0, 2**63, 500).astype("u8")
    for total in (10, 10**5, 10**8, 10**10):
        index = simhash.planned(sample, total, 4)
        assert sum(p.threshold + 1 for p in index) == 5
        assert sum(p.mask for p in index) < 2**64
    assert len(simhash.planned(sample, 10**10, 4)) < len(simhash.planned(sample, 10**4, 4))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
