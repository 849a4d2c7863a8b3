import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.functions import prompts, text
from querent.operators import chunking, grids


def values(spark, rows, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}").orderBy("k").select(fn(F.col("v"))).collect()]


def test_strip_takes_all_white_space(spark):
    rows = ["  a b \n", "\t", "", None, "x"]
    assert values(spark, rows, text.stripped) == ["a b", "", "", None, "x"]


def test_numbers(spark):
    rows = ["40.4", "[20]", "(79k", "-3", "+1", "a1", "", " 7 ", "3 4", "[x"]
    assert values(spark, rows, text.is_number) == [True, True, True, True, True, False, False, True, True, False]
    assert values(spark, rows, text.is_clean_number) == [True, True, True, True, True, False, False, True, False, False]


def test_labels_and_units(spark):
    assert values(spark, ["NQ", "QQP 363k", "EM 1.2m ", "EN-DE", "plain", " MNLI 393k"], text.expanded) == ["NaturalQuestions NQ", "QQP", "Exact Match EM", "English-German EN-DE", "plain", "MNLI"]
    rows = spark.createDataFrame([("Query latency (ms)", "4"), ("Size (M)", " 110 "), ("NQ", "41.5"), ("Odd (xy)", "1"), ("NQ (%)", "9")], "l string, v string")
    assert [r[0] for r in rows.select(text.fact_pair(F.col("l"), F.col("v"))).collect()] == ["Query latency 4 ms", "Size 110 M", "NaturalQuestions NQ 41.5", "Odd (xy) 1", "NaturalQuestions NQ 9 %"]


def test_notation_and_cleanup(spark):
    assert values(spark, ["3.3· | 1018 FLOPs", "3.3 · 1018", "d = 2048. ff", "d 512 ff", "add 512 ff"], text.repaired) == ["3.3·10^18 FLOPs", "3.3·10^18", "d_ff = 2048", "d_ff = 512", "add 512 ff"]
    assert values(spark, ["a hyphen-\n ated  word\nPAGE 3 end ", "Page12 x"], text.cleaned) == ["a hyphenated word end", "x"]


def test_keyword_slots(spark):
    rows = spark.createDataFrame([("The Cat sat", [["cat"], ["sat", "ran"]]), ("a cat", [["cat"], ["sat"]]), ("x", []), ("Top-K", [["top-k"]])], "a string, k array<array<string>>")
    assert [r[0] for r in rows.select(text.keyword_score(F.col("a"), F.col("k"))).collect()] == [True, False, True, True]
    assert values(spark, [" yes.", "No", "YES", ""], text.is_yes) == [True, False, True, False]
    assert values(spark, ["a.pdf + b.pdf", "c.md", " + "], text.sources_in) == [["a.pdf", "b.pdf"], ["c.md"], []]


def test_cache_key_depends_on_question_and_settings(spark):
    df = spark.createDataFrame([("q",)], "q string")
    key = lambda q, *c: df.select(text.cache_key(F.lit(q), *c)).first()[0]
    a = key("q", F.lit(1).alias("k"))
    assert a == key("q", F.lit(1).alias("k")) != key("r", F.lit(1).alias("k"))
    assert a != key("q", F.lit(2).alias("k")) and re.fullmatch("[0-9a-f]{32}", a)


def test_prompts(spark):
    df = spark.createDataFrame([("why?", [("user", "hi"), ("assistant", "ho"), ("system", "s")])], "q string, h array<struct<role:string,text:string>>")
    out = df.select(prompts.filled(prompts.RAG, query=F.col("q"), context=F.lit("c1\n\nc2")).alias("rag"), prompts.filled(prompts.CONDENSE, query=F.col("q"), history=prompts.history_text(F.col("h"))).alias("con"), prompts.history_text(F.array_repeat(F.col("h")[0], 20)).alias("h")).first()
    assert "Context:\n\nc1\n\nc2\n\nQuestion:\n\nwhy?\n\nAnswer:" in out.rag
    assert "User: hi\nAssistant: ho\nSystem: s" in out.con and "Follow-up question: why?" in out.con
    assert out.h.count("User: hi") == 6


MD = """# Models

Intro prose. More.
| Model | Kind | NQ | Latency (ms) |
|---|:--:|---|---|
| A | small | 41.5 | 4 |
| B | large | 44.5 | 9 |

## Late
closing
| x | y |
|---|---|
"""


def test_segments_equal_those_of_one_text(spark):
    texts = [MD, "", "only prose", "|a|\n|b|", "  | a\nx\n\n \n|c", "# h\n\n# " + "k" * 100 + "\n|t|", "\n\n|t|\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.segments(docs).orderBy("doc_id", "seg").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text))
    assert got == {k: s for k, t in enumerate(texts) if (s := chunking.text_segments(t or ""))}
    heads = {(r.doc_id, r.seg): r.heading for r in chunking.segments(docs).collect()}
    assert heads[0, 0] == "# Models" and heads[0, 1] == "# Models" and heads[0, 2] == heads[0, 3] == "## Late"
    assert heads[5, 1] == "# " + "k" * 78 and heads[3, 0] is None


def test_markdown_facts(spark):
    docs = spark.createDataFrame([(1, MD)], "doc_id long, text string")
    own = grids.markdown_grids(chunking.lines(docs))
    facts = {r.fact for r in grids.row_facts(own).collect()} | {r.fact for r in grids.column_facts(own).collect()}
    assert facts == {"Models A: Kind small, NaturalQuestions NQ 41.5, Latency 4 ms.", "Models B: Kind large, NaturalQuestions NQ 44.5, Latency 9 ms.", "Models NaturalQuestions NQ: A 41.5, B 44.5.", "Models Latency (ms): A 4, B 9."}


def test_grid_rendering_and_plausibility(spark):
    rows = [("g", 0, ["a", None]), ("g", 1, ["x\ny", " z "])]
    assert grids.markdown(spark.createDataFrame(rows, "grid_id string, row_no int, cells array<string>")).first().markdown == "| a |  |\n| --- | --- |\n| x y | z |"
    tables = [[["a", "b", "c"]] * 3, [["a", "b"]] * 3, [["a", "b", "c"]] * 2, [["x" * 90] * 3] * 3, [["", None, ""]] * 3]
    df = spark.createDataFrame([(t,) for t in tables], "t array<array<string>>")
    assert [r[0] for r in df.select(grids.is_plausible(F.col("t"))).collect()] == [True, False, False, False, False]


def test_naive_chunks(spark):
    docs = spark.createDataFrame([(1, "0123456789" * 10), (2, ""), (3, None), (4, "short"), (5, "x" * 60)], "doc_id long, text string")
    got = {}
    for r in chunking.naive_chunks(docs, 60, 20).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    whole = "0123456789" * 10
    assert got == {1: [whole[0:60], whole[40:100], whole[80:]], 4: ["short"], 5: ["x" * 60, "x" * 20]}


def reference_sentence_chunks(sentences, size, least):
    out, held = [], []
    for s in sentences:
        n = sum(map(len, held))
        if n + len(s) > size and n >= least:
            out.append(held)
            held = []
        held = held + [s]
    return [" ".join(c) for c in out + [held] if c]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=30).map(str.strip).filter(bool), max_size=20))
def test_sentence_chunks(sentences):
    got = chunking.sentence_chunks("", 50, 30, split=lambda _: sentences)
    assert got == reference_sentence_chunks(sentences, 50, 30)
    assert " ".join(got).split() == " ".join(sentences).split()


WORDS = {}


def encode(t):
    return [WORDS.setdefault(w, len(WORDS)) for w in re.findall(r"\S+\s*", t)]


def decode(tokens):
    names = {v: k for k, v in WORDS.items()}
    return "".join(names[t] for t in tokens)


def cut(t, budget, overlap):
    return chunking.TokenChunker(encode, decode, budget, overlap).chunks(t)


def test_token_chunks_of_prose():
    assert cut("", 8, 2) == [] and cut("short text", 8, 2) == ["short text"]
    sentences = [f"A{k} b c." for k in range(12)]
    chunks = cut(" ".join(sentences), 8, 3)
    assert all(len(c.split()) <= 12 for c in chunks)
    assert chunks[0] == "A0 b c. A1 b c." and chunks[1].startswith("A1 b c.") and sentences[-1] in chunks[-1]
    assert all(len(c.split()) <= 8 for c in cut(" ".join(sentences), 8, 0))


def test_token_chunks_of_a_long_sentence_leave_a_tail():
    chunks = cut("w " * 300, 64, 16)
    assert [len(c.split()) for c in chunks] == [64, 64, 64, 64, 44, 16]
    assert [len(c.split()) for c in cut("w " * 300, 64, 999)][-1] == 32  # the overlap is half a budget at most


def test_token_chunks_keep_tables_and_headings():
    table = "| h1 | h2 |\n| --- | --- |\n" + "\n".join(f"| r{k} | {k} |" for k in range(3))
    chunks = cut(f"# Head\n\nSome prose.\n{table}\nAfter.", 40, 5)
    assert any("# Head\n| h1" in c for c in chunks)
    long = "| h1 | h2 |\n| --- | --- |\n" + "\n".join(f"| r{k} | {k} |" for k in range(40))
    pieces = cut(f"# Head\nProse.\n{long}", 20, 5)
    rows = [p for p in pieces if "| r" in p]
    assert len(rows) > 4 and all(p.startswith("# Head\n| h1 | h2 |\n| --- |") for p in rows)
    assert sorted(int(x) for p in rows for x in re.findall(r"\| r(\d+) ", p)) == list(range(40))


def test_token_chunk_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Hello world. " * 50, "s", 9), (2, None, "s", 9), (3, "", "s", 9), (4, MD, "t", 9)], "doc_id long, text string, source string, pos int")
    rows = chunking.token_chunks(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 32, 8).collect()
    assert {r.doc_id for r in rows} == {1, 4} and all(r.source == {1: "s", 4: "t"}[r.doc_id] for r in rows)
    assert all(r.n_tokens <= 48 for r in rows if r.doc_id == 1)
    assert sorted(r.pos for r in rows if r.doc_id == 1) == list(range(sum(r.doc_id == 1 for r in rows)))


def test_public_encoding_round_trip():
    import public_tokenizers

    e = chunking.public_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert e.decode(e.encode_ordinary("été 12 <|endoftext|>")) == "été 12 <|endoftext|>"


@pytest.mark.parametrize("title,body,want", [("T", "x", "T x"), (None, "x", "x"), ("T", None, "T"), (None, None, "")])
def test_titles(spark, title, body, want):
    df = spark.createDataFrame([(title, body)], "a string, b string")
    assert df.select(text.titled(F.col("a"), F.col("b"))).first()[0] == want


def test_white_space_is_that_of_any_script(spark):
    odd = ["\u00a0A\u2003b\x1cC\u3000", "\x85 x\u200b y\u2028", "", "\x0b\x0c", " plain\ttext\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    for r in df.select("k", text.stripped(F.col("t")).alias("s"), text.tokens(F.col("t")).alias("w"), text.titled(F.lit("\u00a0"), F.col("t")).alias("titled")).collect():
        assert (r.s, r.w, r.titled) == (odd[r.k].strip(), odd[r.k].lower().split(), odd[r.k].strip())


def test_long_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    from querent.functions.tokens import ordinary_tokens

    e = chunking.public_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for run in (" " * 5000, "\n" * 5001, "\t \n" * 3000, "\u3000" * 4500, " \x85" * 2500, " " * 4095):
        for t in (run, f"Some prose.{run}More of it.", f"{run}x", f"x{run}", f"a{run}b{run}\n1"):
            assert ordinary_tokens(e, t) == library.encode(t, add_special_tokens=False).ids
    for run in (" " * 10**7, "\n" * 10**7):
        ids = ordinary_tokens(e, f"Some prose.{run}More of it.")
        assert e.decode(ids) == f"Some prose.{run}More of it."


def test_chunks_of_long_white_space(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, " " * 10**6), (2, "Some prose" + "\n" * 10**6 + "and more. The end."), (3, "Some prose" + " " * 10**6 + "and more. The end.")], "doc_id long, text string")
    rows = chunking.token_chunks(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert {r.doc_id for r in rows} == {2, 3} and all(r.n_tokens <= 200 for r in rows)
