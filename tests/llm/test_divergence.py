import random
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import divergence, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, least=3, most=200):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(source, Counter(TERM.findall(lowered(text)))) for ln, source, text in docs if ln == lang]
        documents = Counter(t for _, words in own for t in words)
        kept = [t for t, n in documents.items() if n >= least]
        of = {s: Counter() for s, _ in own}
        for s, words in own:
            of[s].update({t: n for t, n in words.items() if t in set(kept)})
        total = sum(of.values(), Counter())

        def shares(counts):
            n = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // n for t in kept}

        p, q = {s: shares(c) for s, c in of.items()}, shares(total)
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in of if o != s]
            telling = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(telling)[:most])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBé_1 \n@[`{ß", max_size=60), st.integers(1, 9))
def test_terms_in_blocks(text, block):
    assert {t.decode(): n for t, n in divergence.terms(text.encode(), block).items()} == Counter(TERM.findall(lowered(text)))


def rows(seed, n=400):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "été", "x1y", "gamma-delta", "Ω", "z" * 300, *(f"w{chr(97 + k)}" for k in range(26))]
    out = []
    for _ in range(n):
        source = rnd.choice(["hot"] * 5 + ["a", "B", "ä", None, "", "c" * 70])
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        out.append((lang, source, rnd.choice([None, "", "12 34"]) if rnd.random() < 0.1 else " ".join(rnd.choice(words[: rnd.randint(3, len(words))]) for _ in range(rnd.randint(1, 40)))))
    return out + [("fr", "one", "seul"), ("fr", "two", None), ("it", "alone", "parola parola parola")] + [out[0]] * 5


def table(spark, docs):
    return spark.createDataFrame([(*d, 5, "x") for d in docs], "lang string, source string, text string, p int, term string").repartition(6)


def test_against_brute_force(spark, monkeypatch):
    docs = rows(1)
    for entries, widest, pairs in ((divergence.ENTRIES, divergence.WIDEST, divergence.PAIRS), (40, 2, 7)):
        monkeypatch.setattr(divergence, "WIDEST", widest)
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = divergence.audited(table(spark, docs), most=9, entries=entries)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute(docs, most=9)


def test_edges(spark):
    assert divergence.audited(table(spark, rows(2)).limit(0)).collect() == []
    long = "many words of One text " * 400_000
    docs = [("en", "a", long), ("en", "b", long + "more"), ("en", "c", "one text"), ("en", "a", "more"), ("en", "b", "more")]
    assert sorted(map(tuple, divergence.audited(table(spark, docs)).collect())) == brute(docs)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES["op11_divergence"])
    got = queries.op11_divergence(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
