import pytest

from querent.plans import answering
from querent.plans.config import PRESETS, Config, as_sources, configured, flat

TEXTS = ["Cats are small animals. They purr.", "Dogs are loyal animals.", "Neural networks learn features.", "Gradient descent trains neural networks."]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, t, f"{'abcd'[k]}.txt") for k, t in enumerate(TEXTS)], "id long, text string, source string")


def ask(spark, *texts, history=None):
    if history is None:
        return spark.createDataFrame(list(enumerate(texts)), "qid long, qtext string")
    return spark.createDataFrame([(k, t, history) for k, t in enumerate(texts)], "qid long, qtext string, history array<struct<role:string,text:string>>")


def test_presets_and_groups():
    assert len(PRESETS) == 12 and configured(None) == PRESETS["best"] and configured("bm25").retriever == "bm25"
    assert PRESETS["best"].top_k == 20 and PRESETS["lightweight"].chunk_max_tokens == 64 and PRESETS["faiss"].index_type == "ivf"
    assert configured({"top_k": 3, "alpha": None, "unknown": 1}) == Config(top_k=3)
    assert configured(flat(PRESETS["gpt"])) == PRESETS["gpt"]
    for bad in ("nope", {"fusion": "x"}, {"store": "x"}):
        with pytest.raises(ValueError):
            configured(bad)
    assert as_sources(None) is None and as_sources("a") == {"a"} and as_sources([]) == set()


@pytest.mark.parametrize("config", [Config(), Config(retriever="bm25"), Config(retriever="hybrid"), Config(retriever="hybrid", fusion="weighted", alpha=0.7), Config(store="faiss", index_type="ivf"), Config(store="qdrant")])
def test_every_retriever_answers(spark, chunks, config):
    index = answering.build_index(chunks, config)
    got = {r.qid: r for r in answering.answered(index, ask(spark, "which networks learn features", "small cats"), config).collect()}
    assert got[0].chunks[0].text == TEXTS[2] and got[0].answer == TEXTS[2]
    assert got[1].chunks[0].source == "a.txt" and got[1].hyde_doc is None and got[1].standalone_query is None


def test_sources_restrict_retrieval(spark, chunks):
    for retriever in ("dense", "bm25", "hybrid"):
        index = answering.build_index(chunks, Config(retriever=retriever))
        for source, want in ((("b.txt", "d.txt"), {"b.txt", "d.txt"}), ((), set())):
            got = answering.answered(index, ask(spark, "cats"), Config(retriever=retriever, source=source)).first()
            assert {c.source for c in got.chunks} == want


def test_reranking_widens_and_cuts(spark, chunks):
    seen = []

    def scorer(q, t):
        seen.append(1)
        return answering.fusion.overlap(q, t)

    config = Config(retriever="bm25", rerank=True, top_k=1)
    got = answering.answered(answering.build_index(chunks, config), ask(spark, "loyal dogs"), config, scorer=scorer).first()
    assert seen and len(got.chunks) == 1 and got.chunks[0].score == 1.0


def test_history_hyde_and_prompts(spark, chunks):
    def generate(texts):
        return ["gradient descent" if t.rstrip().endswith(("Standalone question:", "Passage:")) else t for t in texts]

    history = [("user", f"m{k}") for k in range(20)]
    config = Config(retriever="bm25", top_k=1, hyde=True)
    got = answering.answered(answering.build_index(chunks, config), ask(spark, "and how?", history=history), config, generate).first()
    assert got.hyde_doc == got.standalone_query == "gradient descent" and got.chunks[0].text == TEXTS[3]
    assert "and how?" in got.answer and "User: m19" in got.answer and "User: m13" not in got.answer and TEXTS[3] in got.answer
    bare = answering.answered(None, ask(spark, "and how?", history=history), Config(no_rag=True), lambda ts: ts).first()
    assert "Conversation so far:" in bare.answer and bare.chunks == [] and bare.standalone_query is None
    with pytest.raises(ValueError):
        answering.answered(None, ask(spark, "x"), Config())


def test_answers_come_from_the_cache(spark, chunks, tmp_path):
    path, config, built = f"{tmp_path}/answers", Config(retriever="bm25", top_k=1), []

    def build():
        built.append(1)
        return answering.build_index(chunks, config)

    run = lambda *q, **k: {r.qid: (r.answer, r.cached) for r in answering.answered_through_cache(build, ask(spark, *q), config, path, **k).collect()}
    assert run("loyal dogs") == {0: (TEXTS[1], False)}
    assert run("loyal dogs") == {0: (TEXTS[1], True)} and len(built) == 1
    assert run("loyal dogs", "networks learn") == {0: (TEXTS[1], True), 1: (TEXTS[2], False)}
    assert run("loyal dogs", fresh=True) == {0: (TEXTS[1], False)}


def test_what_a_model_raises_stays_with_its_row(spark):
    def generate(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no answer")
        return ["fine"] * len(texts)

    asked = ask(spark, "good", "bad", "better")
    got = {r.qid: (r.answer, r.error) for r in answering.answered(None, asked, Config(no_rag=True), generate, error="error").collect()}
    assert got == {0: ("fine", None), 1: (None, "ValueError: no answer"), 2: ("fine", None)}
    with pytest.raises(Exception, match="no answer"):
        answering.answered(None, asked, Config(no_rag=True), generate).collect()


def test_extractive_generator():
    assert answering.extractive(["Reference answer: 4 ms\nCandidate answer: about 4 ms\n\nDoes it?", "Reference answer: 4 ms\nCandidate answer: no\n\nDoes it?", "Question:\n\nwhy\n\nAnswer:\n"]) == ["YES", "NO", "I am not sure."]
