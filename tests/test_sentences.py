import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.operators import chunking, sentences

MARKS = ".!?…"


def plain_token(token):
    """(word, kind, case) letter by letter."""
    a, b = 0, len(token)
    good = lambda c: c in MARKS or sentences.regex.fullmatch(r"[\p{L}\p{N}]", c)
    while a < b and not good(token[a]):
        a += 1
    while b > a and not good(token[b - 1]):
        b -= 1
    end = b
    while end > a and token[end - 1] in MARKS:
        end -= 1
    core, mark = token[a:end], token[end:b]
    if not core and not mark:
        return None
    kind = "end" if not core else "none" if not mark else "period" if mark == "." else "ellipsis" if set(mark) <= set(".…") else "end"
    number = core[:1] in tuple("0123456789") and all(c in "0123456789.," for c in core)
    case = "upper" if core and sentences.UPPER.match(core) else "lower" if core and sentences.LOWER.match(core) else "other"
    return ("##" if number else core.lower()), kind, case


def plain_counts(texts):
    out = Counter()
    for text in texts:
        last = None
        for t in filter(None, map(plain_token, (text or "").split())):
            if t[0]:
                out[(last[0] if last and last[1] == "period" else "", last[1] if last else "start", *t)] += 1
            last = t
    return out


def xlog(x, p):
    return x * math.log(p) if x > 0 else 0.0


def llr(a, b, both, n):
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return -2 * (xlog(both, p) + xlog(a - both, 1 - p) + xlog(b - both, p) + xlog(n - a - b + both, 1 - p) - xlog(both, p1) - xlog(a - both, 1 - p1) - xlog(b - both, p2) - xlog(n - a - b + both, 1 - p2))


def letters(w):
    return bool(w) and bool(sentences.regex.fullmatch(r"\p{L}+", w))


def plain_model(counts):
    n, periods, starts = Counter(), Counter(), Counter()
    for (_, _, w, kind, _), k in counts.items():
        n[w] += k
        periods[w] += k * (kind == "period")
    total, dots = n.total(), periods.total()
    short = {}
    for w, k in periods.items():
        if k and w != "##" and any(map(letters, w)):
            inner, without = w.count("."), n[w] - k
            length = len(w) - inner
            ratio = -2 * (xlog(k, dots / total) + xlog(without, 1 - dots / total) - k * math.log(0.99) - without * math.log(0.01))
            score = ratio * math.exp(-length) * (inner + 1) * float(length) ** -without
            if score >= 0.3:
                short[w] = score
    initial = lambda w: len(w) == 1 and letters(w)
    for (before, ends, w, _, _), k in counts.items():
        if ends == "end" or ends == "period" and before not in short and before != "##" and not initial(before):
            starts[w] += k
    first = {w for w, k in starts.items() if letters(w) and starts.total() < total and total / starts.total() > n[w] / k and llr(starts.total(), n[w], k, total) >= 30}
    pairs = Counter()
    for (before, ends, w, _, _), k in counts.items():
        if ends == "period" and (before in short or before == "##" or initial(before)) and letters(w) and w not in first:
            pairs[before, w] += k
    pairs = {(a, b) for (a, b), k in pairs.items() if k > 1 and n[a] < total and total / n[a] > n[b] / k and llr(n[a], n[b], k, total) >= 7.88}
    case = {}
    for w in {key[2] for key in counts if key[1] in ("period", "ellipsis")}:
        own = {key: k for key, k in counts.items() if key[2] == w}
        case[w] = tuple(any(c == key[4] and test(key[1]) for key in own) for c, test in (("upper", lambda e: e == "none"), ("upper", lambda e: e in ("start", "end")), ("lower", lambda e: e not in ("start", "end")), ("lower", lambda e: e in ("start", "end"))))
    return short, first, pairs, case


def plain_split(text, model):
    """Sentences as lists of their tokens."""
    short, first, pairs, case = model
    out = []
    for token in text.split():
        if not out:
            out.append([token])
            continue
        last, here = plain_token(out[-1][-1]), plain_token(token) or ("", "", "other")
        after = (here[0], here[2])
        if last is None or last[1] == "none":
            end = False
        elif last[1] == "end":
            end = True
        else:
            w = last[0]
            initial = len(w) == 1 and w.isalpha()
            if not (last[1] == "ellipsis" or w in short or w == "##" or initial):
                end = True
            elif token[0] in ",;:.!?…" or (w, after[0]) in pairs:
                end = False
            else:
                ui, uf, li, lf = case.get(after[0], (False,) * 4)
                if after[1] == "upper" and (li or lf) and not ui:
                    end = True
                elif after[1] == "lower" and (ui or uf or not lf):
                    end = False
                else:
                    end = after[1] == "upper" and after[0] in first and not initial or w == "##"
        if end:
            out.append([token])
        else:
            out[-1].append(token)
    return out


def texts_of(seed, n=250):
    rnd = random.Random(seed)
    names = ["Smith", "Jones", "Brown"]
    plain = ["the", "house", "was", "Old", "in", "many", "places", "however", "we", "saw", "it", "1999", "3", "u.s", "ärzte"]
    out = [None, "", " \n ", "no end", "...", "! ?", "A. B. Cee went"]
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(1, 12)):
            own = [rnd.choice(plain) for _ in range(rnd.randint(2, 9))]
            if rnd.random() < 0.5:
                own[1:1] = [rnd.choice(["Dr.", "etc.", "e.g.", "J.", "No."]), rnd.choice([*names, "the", "3"])]
            own[0] = own[0].capitalize()
            own[-1] += rnd.choice([".", ".", ".", "!", "?", "...", ".)", '."', "…", "?!", ""])
            words += own
        out.append(rnd.choice([" ", "\n", "  ", "　"]).join(words))
    return out


def test_counts_model_and_ends_against_brute_force(spark):
    texts = texts_of(1)
    docs = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, n int").repartition(5)
    want = plain_counts(texts)
    table = sentences.counts(docs)
    assert {tuple(r)[:5]: r.n for r in table.collect()} == want
    short, first, pairs, case = plain_model(want)
    assert {"dr", "etc", "e.g"} <= short.keys()
    found = {r.word: r.score for r in sentences.abbreviations(table).collect()}
    assert found.keys() == short.keys() and all(math.isclose(found[w], short[w], rel_tol=1e-9) for w in short)
    model = sentences.trained(docs)
    assert (model.short, model.first, model.pairs, model.case) == (short.keys(), first, pairs, case)
    for text in texts:
        if text is not None:
            got = model.split(text)
            assert [s.split() for s in got] == plain_split(text, (short, first, pairs, case))
            assert all(s == s.strip() and s in text for s in got)
    assert model.split("He saw Dr. Smith in the house. The house was old.") == ["He saw Dr. Smith in the house.", "The house was old."]
    rows = {r.doc_id: r.sentences for r in sentences.split_texts(docs, model).collect()}
    assert rows == {k: model.split(t) if t is not None else [] for k, t in enumerate(texts)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.!…,( )\nÉ-", max_size=30))
def test_words_are_those_of_the_plan(text):
    assert list(sentences.words_of(text)) == [t for t in map(plain_token, text.split()) if t]


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = sentences.trained(docs)
    assert model == sentences.Splitter() and model.split("") == [] and model.split("Dr. Smith. x") == ["Dr.", "Smith.", "x"]
    few = spark.createDataFrame([(1, "one")], docs.schema)
    assert sentences.trained(few).split("one") == ["one"]
    assert len(sentences.Splitter().split("Word goes here. " * 300_000)) == 300_000
    assert sentences.trained(spark.createDataFrame([(k, "a b. c") for k in range(9)], docs.schema), most=1).short <= {"b"}


def test_chunks_by_the_learned_sentences(spark):
    import public_tokenizers

    texts = texts_of(2, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentences.trained(docs)
    got = {}
    for r in chunking.token_chunks(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 64, 16, model).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    e = chunking.public_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    cut = chunking.TokenChunker(e.encode_ordinary, e.decode, 64, 16, model)
    assert got == {k: c for k, t in enumerate(texts) if t and (c := cut.chunks(t))}
    assert docs.where(F.col("text").isNotNull()).count() > len(got)


def test_the_model_holds_more_than_a_hundred_thousand_words(spark):
    docs = spark.range(100_500).select(F.concat(F.lit("so w"), "id", F.lit(" is… W"), "id", F.lit(" goes")).alias("text"))
    model = sentences.trained(docs)
    assert all(len(model.split(f"so w{k} is… W{k} goes")) == 2 for k in (0, 1234, 99_999, 100_499))


def test_the_decisive_model_splits_its_texts_as_the_whole_one(spark):
    texts = texts_of(5)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    whole, lean = sentences.trained(docs), sentences.trained(docs, decisive=True)
    assert len(lean.case) < len(whole.case) and all(lean.split(t) == whole.split(t) for t in texts if t is not None)


def test_tasks_of_a_table_are_of_bounded_size(spark, tmp_path, monkeypatch):
    from querent import tables

    spark.range(40_000).selectExpr("id", "sha2(string(id), 256) AS text").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 16)
    rows = tables.spread(tables.table(spark, str(tmp_path), "t"))
    assert rows.rdd.getNumPartitions() > 8 and rows.count() == 40_000
