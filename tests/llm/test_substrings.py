import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import substrings


def brute(rows, least=substrings.LEAST, words=substrings.WORDS):
    """Sentences covered by a span that an earlier place has, comparing the words themselves."""
    spans = {}
    for d, text in set(rows):
        parts = substrings.sentences(text or "")
        counted = [k for k, p in enumerate(parts) if p[2]]
        for k in range(len(counted)):
            for e in range(k + least, len(counted) + 1):
                own = [parts[j][2] for j in counted[k:e]]
                if sum(map(len, own)) >= words:
                    spans.setdefault((d, text), []).append((tuple(map(tuple, own)), counted[k], counted[e - 1] + 1))
                    break
        if counted and (d, text) not in spans:
            spans[d, text] = [(tuple(tuple(parts[k][2]) for k in counted), 0, len(parts))]
    last = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for (d, _), own in spans.items():
        for s, _, _ in own:
            first[s] = min(last(d), first.get(s, 2**64))
    out = []
    for d, text in rows:
        parts = substrings.sentences(text or "")
        gone, known = set(), set()
        for s, a, b in spans.get((d, text), []):
            if s in known or first[s] < last(d):
                gone |= set(range(a, b))
            known.add(s)
        out.append((d, len(parts), len(gone), None if text is None else "".join(text[a:b] for k, (a, b, _) in enumerate(parts) if k not in gone)))
    return out


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(1, 12))).capitalize() + rnd.choice([". ", "! ", ".\n", " ", '." '])
    passages = [[sentence() for _ in range(rnd.randint(5, 14))] for _ in range(5)]
    rows = []
    for k in range(n):
        text = [sentence() for _ in range(rnd.randint(0, 20))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(text))
            text[at:at] = rnd.choice(passages)
        rows.append((k, "".join(text)))
    return rows + [(3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (7, rows[7][1]), (100, None), (101, ""), (102, "Is onhe. " * 300), (103, "x " * 3000), (-1, rows[9][1].upper()), (110, "Short one."), (111, "short  ONE."), (112, "Short one"), (113, " \n ")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abÉé .!\n\"?Z  ")), max_size=120))
def test_sentences_are_the_whole_text(text):
    parts = substrings.sentences(text)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert [w for _, _, own in parts for w in own] == text.lower().split()


def test_long_sentences_part_alike_wherever_they_stand():
    rnd = random.Random(2)
    tail = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(600))
    a, b = (substrings.sentences(head + tail) for head in ("", "other words before it "))
    assert len(a) > 20 and [w for *_, w in a][3:] == [w for *_, w in b][-len(a) + 3 :]


def test_rows_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash", [1]) for d, t in rows], "doc_id long, text string, removed_spans string, value array<int>")
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.text) for r in substrings.spans(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    for r in substrings.spans(docs).collect():
        assert (r.n_removed == 0) == (r.removed_spans == "")


def test_deduplicated_keeps_columns(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, "en", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, n_chars long")
    want = {repr((d, t)) for d, _, _, t in brute(rows)}
    got = substrings.deduplicated(docs).collect()
    assert len(got) == len(rows) and {repr((r.doc_id, r.text)) for r in got} == want
    assert all(r.lang == "en" and r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_planted_passage_goes_from_later_documents_only(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    prose = lambda n: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    passage = prose(7)
    docs = spark.createDataFrame([(5, f"{prose(4)} and then {passage} {prose(3)}"), (9, f"{passage} {prose(5)}"), (11, prose(12)), (12, f"{prose(1)} so {passage}")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.spans(docs).collect()}
    assert got[5].n_removed == got[11].n_removed == 0
    assert passage not in got[9].text and passage not in got[12].text
    assert got[9].n_removed == 7 and got[12].n_removed == 7


def test_hostile_texts_take_linear_time():
    for text in ["." * 1_000_000, ".x" * 300_000, '."' * 300_000, "!)" * 300_000 + "x", "\n " * 300_000, "a B" * 200_000, "." * 500_000 + '"' * 500_000 + "x"]:
        began = time.perf_counter()
        parts = substrings.sentences(text)
        substrings.runs(parts, 2, 15)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert time.perf_counter() - began < 10


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Same short text.", 5, [1], "x"), (2, "Same short text.", 6, [2], "y")], "doc_id long, text string, span_doc long, Span_Values array<int>, value string")
    got = sorted(tuple(r) for r in substrings.deduplicated(docs).collect())
    assert got == [(1, "Same short text.", 5, [1], "x"), (2, "", 6, [2], "y")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.spans(docs).collect() == [] == substrings.deduplicated(docs).collect()


def test_ids_of_any_type(spark):
    passage = "One sentence of several words stands here. And another one of several words follows it."
    rows = [("b", passage), ("a", f"Before it. {passage}"), (None, f"{passage} And after it."), (None, passage)]
    got = substrings.spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in got) == [("None", True), ("None", True), ("a", False), ("b", True)]
    left = substrings.deduplicated(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sum(passage in (r.text or "") for r in left.collect()) == 1
