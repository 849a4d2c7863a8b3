"""Queries on texts, tables in texts, prompts, evaluation and page layout, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions import prompts, text
from querent.operators import chunking, evaluation, grids, layout, vector
from querent.plans.search_queries import K, arms_sql, lexical_hits, text_queries, vector_queries, vectors
from querent.tables import spread, table


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# Sources ------------------------------------------------------------------------------------------------------------


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"), md5(F.col("text")).alias("text_md5"))


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().orderBy("source")


def source_filter_semi(spark: SparkSession, sf: str) -> DataFrame:
    allow = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"))
    return table(spark, sf, "documents").join(allow, "source", "left_semi").select("doc_id", "source")


def doc_blank_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("text", text.stripped(F.concat(F.lit(" \n"), F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("text")), F.lit("\t "))))
    return rows.where("text != ''").select("conv_id", "turn", md5(F.col("text")).alias("text_md5"))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")]
    rows = [table(spark, sf, n).select(F.lit(k).alias("src_order"), F.col(i).alias("id"), md5(F.col(t)).alias("text_md5")) for k, (n, i, t) in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def jsonl_title_text(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON lines and back, title and text in one; every third has no title."""
    line = F.to_json(F.struct(F.col("page_id").alias("_id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("title"), F.col("html").alias("text")))
    rows = table(spark, sf, "pages").select(F.from_json(line, "_id long, title string, text string").alias("r"))
    return rows.select(F.col("r._id").alias("id"), md5(text.titled(F.col("r.title"), F.col("r.text"))).alias("text_md5"))


# Chunks and tables --------------------------------------------------------------------------------------------------


def chunk_naive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.naive_chunks(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("pos").cast("int").alias("pos"), md5(F.col("text")).alias("text_md5"))


def chunk_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunked(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), lambda: chunking.sentence_chunks).drop("n_tokens")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.token_chunks(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), rank_file())


COLUMNS = ("order", "status", "price (M)", "EM", "priority 12k")


def order_cells() -> Column:
    return F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), (F.col("o_orderkey") % 100).cast("string"), F.col("o_orderpriority"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown report (doc_id, text) of each customer's orders."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("| "), F.array_join(order_cells(), " | "), F.lit(" |")).alias("line")))), lambda x: x.line).alias("rows"))
    rows = rows.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    head = F.array(F.concat(F.lit("# Report of "), "c_name"), F.concat(F.lit("Some words on "), "c_mktsegment", F.lit(" here.")), F.lit(""), F.lit("| " + " | ".join(COLUMNS) + " |"), F.lit("| --- | --- | --- | --- | --- |"))
    return rows.select(F.col("c_custkey").alias("doc_id"), F.array_join(F.concat(head, "rows", F.array(F.lit("Closing words."))), "\n").alias("text"))


def segment_table_prose(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.segments(reports(spark, sf)).select("doc_id", F.col("seg").cast("int").alias("seg"), "kind", md5(F.col("text")).alias("text_md5"), "heading")


def last_heading(spark: SparkSession, sf: str) -> DataFrame:
    heads = chunking.lines(reports(spark, sf)).where(text.is_heading(F.col("line")))
    return heads.groupBy("doc_id").agg(F.max_by(F.rtrim(F.substring(text.stripped(F.col("line")), 1, chunking.HEADING_CHARS)), "line_no").alias("heading"))


def md_table_render(spark: SparkSession, sf: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("grid_id"), F.row_number().over(own).alias("row_no"), order_cells().alias("cells"))
    head = rows.select("grid_id").distinct().select("grid_id", F.lit(0).alias("row_no"), F.array(*map(F.lit, COLUMNS)).alias("cells"))
    return grids.markdown(head.unionByName(rows)).select("grid_id", md5(F.col("markdown")).alias("text_md5"))


def md_table_facts_rows(spark: SparkSession, sf: str) -> DataFrame:
    facts = grids.row_facts(grids.markdown_grids(chunking.lines(reports(spark, sf))))
    return facts.select("grid_id", F.col("row_no").cast("int").alias("row_no"), "fact")


def md_table_facts_cols(spark: SparkSession, sf: str) -> DataFrame:
    facts = grids.column_facts(grids.markdown_grids(chunking.lines(reports(spark, sf))))
    return facts.select("grid_id", F.col("col").cast("int").alias("col"), "fact")


LABELS = ("NQ", "WQ", "TQA", "CT", "EM", "QQP", "EN-DE", "EN-FR", "other", "x 12")


def label_expand_join(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS) + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size"), F.lit("k "))).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", text.expanded(label).alias("label"))


def number_token(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(words, text.is_number)).cast("long").alias("numbers"), F.size(F.filter(words, text.is_clean_number)).cast("long").alias("clean_numbers"))


def text_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("text"), F.lit(" hyphen-\n ated page "), F.col("doc_id"), F.lit(" Page12 \t end\n"))
    return table(spark, sf, "documents").select("doc_id", md5(text.cleaned(raw)).alias("text_md5"))


def notation_repair(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("text"), F.lit(" 3.3· | 10"), F.col("doc_id"), F.lit(" and 7 ·1018, d = 2048. ff, d 512 ff"))
    return table(spark, sf, "documents").select("doc_id", md5(text.repaired(raw)).alias("text_md5"))


# Page layout --------------------------------------------------------------------------------------------------------

WIDTH = 600.0


def words(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' words set on pages of 40 lines and two columns, every 17th word small and low."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("i", "text"))
    rows = rows.withColumn("page", F.expr("CAST(i DIV 400 AS INT)")).withColumn("k", F.col("i") % 400)
    x0 = 40.0 + (F.col("k") % 10) * 50.0 + F.when(F.col("k") % 10 >= 5, F.lit(20.0)).otherwise(F.lit(0.0))
    small = F.col("i") % 17 == 0
    top = 50.0 + F.expr("k DIV 10") * 14.0 + (F.col("i") * 7 % 3) * 0.25 + F.when(small, F.lit(4.0)).otherwise(F.lit(0.0))
    rows = rows.withColumn("x0", x0).withColumn("top", top)
    return rows.select("doc_id", "page", "i", "text", "x0", (F.col("x0") + F.least(F.length("text"), F.lit(8)) * 5.0).alias("x1"), "top", (F.col("top") + 9.0).alias("bottom"), F.when(small, F.lit(6.0)).otherwise(F.lit(10.0)).alias("size"))


def line_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lines(words(spark, sf)).select("doc_id", "page", "line", md5(F.col("text")).alias("text_md5"))


def gutter_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return layout.gutter_bins(words(spark, sf), WIDTH).select("doc_id", "page", "bin", F.col("n").cast("long").alias("n"))


def gutter_split(spark: SparkSession, sf: str) -> DataFrame:
    return layout.gutters(words(spark, sf), WIDTH)


def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_bounds(words(spark, sf)).select("doc_id", "page", F.col("n").cast("int").alias("n"), F.col("x").cast("double").alias("x"))


def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    own = words(spark, sf)
    headers = own.where((F.col("i") % 400).between(2, 6))
    return layout.anchored(own, headers).groupBy("doc_id", "page", "col").agg(F.count("*").alias("n"))


def word_bbox_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Words outside the box that each page has in its middle."""
    own = words(spark, sf)
    boxes = own.groupBy("doc_id", "page").agg((F.min("x0") + 100).alias("bx0"), (F.max("x1") - 100).alias("bx1"), (F.min("top") + 28).alias("btop"), (F.max("bottom") - 28).alias("bbottom"))
    return layout.outside(own, boxes).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


def number_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of numbers among the normal words of pages, two of three words put as their lengths."""
    own = words(spark, sf).where("size > 6").withColumn("text", F.when(F.length("text") % 3 > 0, F.length("text").cast("string")).otherwise(F.col("text")))
    return layout.number_bands(own).select("doc_id", "page", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "n")


# Evaluation ---------------------------------------------------------------------------------------------------------


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the query's label are relevant; the judgements are counted by label, never listed by pairs."""
    queries = vector_queries(spark, sf)
    run = vector.exact_top_k(queries, vectors(spark, sf), evaluation.DEPTH)
    hits = run.join(vectors(spark, sf).select("id", "label"), "id").join(queries.select("qid", F.col("label").alias("asked")), "qid")
    hits = hits.select("qid", "id", "score", (F.col("label") == F.col("asked")).cast("int").alias("rel"))
    counts = vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return evaluation.ir_metrics(hits, queries.join(counts, "label").select("qid", F.lit(1).alias("rel"), "n"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("qid", *(F.round(n, 6).alias(n) for n in names))


def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), "ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10")


def recall_100(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), "recall")


def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), "rr")


def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), "ap")


def ir_macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    own = evaluation.macro(metrics(spark, sf))
    return own.select("queries", *(F.round(c, 6).alias(c) for c in own.columns if c != "queries"))


def slots() -> Column:
    words = (("the", "der", "les", "que"), ("and", "und", "et"), ("tion", "ung", "ción"))
    return F.array(*(F.array(*map(F.lit, w)) for w in words))


def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.keyword_score(F.col("text"), slots()).alias("right"))


def qa_accuracy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords against the quality labels as the judge, by language and source with subtotals."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "source", text.keyword_score(F.col("text"), slots()).alias("right"), (F.col("quality") == 1).alias("judge"))
    own = evaluation.accuracy(rows, "lang", "source")
    return own.select("lang", "source", "n", F.round("accuracy", 6).alias("accuracy"), F.round("judge_accuracy", 6).alias("judge_accuracy"), "disagreements")


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    own = evaluation.latencies(table(spark, sf, "events"), "event_type", "value")
    return own.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")), "n")


def latest_run_per_config(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return evaluation.unpivoted(rows, ["p_partkey"], ["size", "price"])


# Conversations and prompts ------------------------------------------------------------------------------------------


def with_history(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with the text of the up to six messages before them."""
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-prompts.HISTORY, -1)
    return table(spark, sf, "conversations").withColumn("history", prompts.history_text(F.collect_list(F.struct("role", "text")).over(own)))


def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return with_history(spark, sf).select("conv_id", "turn", md5(F.col("history")).alias("text_md5"))


def prompt_of(template: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = with_history(spark, sf).where("role = 'user'")
        return rows.select("conv_id", "turn", md5(prompts.filled(template, query=F.col("text"), history=F.col("history"))).alias("text_md5"))

    return query


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The best three texts of each item, in their order, between blank lines."""
    hits = lexical_hits(spark, sf, 3).groupBy("qid").agg(grids.ordered(F.col("text"), "rank", "\n\n").alias("context"))
    return text_queries(spark, sf).join(hits, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))


def prompt_rag(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(spark, sf).select("qid", md5(prompts.filled(prompts.RAG, query=F.col("qtext"), context=F.col("context"))).alias("text_md5"))


def prompt_rag_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = contexts(spark, sf).join(with_history(spark, sf).where("role = 'user'"), F.col("qid") == F.col("conv_id"))
    return rows.select("conv_id", "turn", md5(prompts.filled(prompts.RAG_CHAT, query=F.col("text"), history=F.col("history"), context=F.col("context"))).alias("text_md5"))


def prompt_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the next message as the candidate and the one after it as the reference."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(own)).withColumn("expected", F.lead("text", 2).over(own)).where("role = 'user' AND expected IS NOT NULL")
    return rows.select("conv_id", "turn", md5(prompts.filled(prompts.JUDGE, question=F.col("text"), expected=F.col("expected"), answer=F.col("answer"))).alias("text_md5"))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("key", text.cache_key(F.col("text"), F.lit("best").alias("preset"), F.lit(20).alias("top_k")))


def answer_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(spark, sf).select("conv_id", "turn", "key")


def cache_miss_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Questions without an answer among those of the first turns."""
    cached = keyed(spark, sf).where("turn <= 1").select("key").distinct()
    return keyed(spark, sf).where("role = 'user'").join(cached, "key", "left_anti").select("conv_id", "turn", "key")


def stream_events_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as lines of JSON: a meta event, then a token event for each word; empty words are left out."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    meta = rows.select("conv_id", "turn", F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("meta").alias("type"), F.col("role").alias("config"))).alias("line"))
    token = rows.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    token = token.select("conv_id", "turn", (F.col("pos") + 1).alias("seq"), F.to_json(F.struct(F.lit("token").alias("type"), F.col("word").alias("text"))).alias("line"))
    return meta.unionByName(token)


PROMPTS = {"prompt_no_rag": prompts.NO_RAG, "prompt_hyde": prompts.HYDE, "prompt_condense": prompts.CONDENSE, "prompt_no_rag_chat": prompts.NO_RAG_CHAT}
NAMED = (scan_documents, source_list, source_filter_semi, doc_blank_filter, union_sources, jsonl_title_text, chunk_naive, chunk_sentence, chunk_tokens, segment_table_prose, last_heading, md_table_render, md_table_facts_rows, md_table_facts_cols, label_expand_join, number_token, text_cleanup, notation_repair, line_assembly, gutter_histogram, gutter_split, column_gaps, nearest_anchor, word_bbox_anti, number_bands, ndcg_at_k, recall_100, mrr, mean_average_precision, ir_macro_mean, keyword_score, qa_accuracy_rollup, latency_percentiles, latest_run_per_config, unpivot_metrics, history_window, prompt_rag, prompt_rag_chat, prompt_judge, answer_cache_key, cache_miss_anti, stream_events_ndjson)
QUERIES = {**{f.__name__: f for f in NAMED}, **{n: prompt_of(t) for n, t in PROMPTS.items()}}


def quoted(template: str, **columns: str) -> str:
    """A prompt as an SQL concatenation."""
    out = "'" + template.replace("'", "''") + "'"
    for name, column in columns.items():
        out = out.replace("{" + name + "}", f"' || {column} || '")
    return out


STRIP = "regexp_replace({t}, '^" + text.SPACE.replace("{", "{{").replace("}", "}}") + "+|" + text.SPACE.replace("{", "{{").replace("}", "}}") + "+\\z', '', 'g')"
CELLS = "[o_orderkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(15,2)::VARCHAR, (o_orderkey % 100)::VARCHAR, o_orderpriority]"
HEADS = "['" + "', '".join(COLUMNS) + "']"
REPORTS = f"r AS (SELECT o_custkey, list('| ' || array_to_string({CELLS}, ' | ') || ' |' ORDER BY o_orderkey) AS rows FROM orders GROUP BY o_custkey), reports AS (SELECT c_custkey AS doc_id, '# Report of ' || c_name AS head, 'Some words on ' || c_mktsegment || ' here.' AS prose, rows FROM r JOIN customer ON o_custkey = c_custkey)"
LABEL = "list_extract(['" + "', '".join(LABELS) + "'], (p_partkey % 10 + 1)::INTEGER)"
NAMES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.EXPANSIONS.items()) + "}"
PAGE_WORDS = r"""t AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)),
 p AS (SELECT *, i % 400 AS k FROM t), b AS (SELECT *, 40.0::DOUBLE + (k % 10) * 50.0::DOUBLE + CASE WHEN k % 10 >= 5 THEN 20.0::DOUBLE ELSE 0 END AS x0, 50.0::DOUBLE + (k // 10) * 14.0::DOUBLE + (i * 7 % 3) * 0.25::DOUBLE + CASE WHEN i % 17 = 0 THEN 4.0::DOUBLE ELSE 0 END AS top FROM p),
 words AS (SELECT doc_id, (i // 400)::INTEGER AS page, i, text, x0, x0 + least(length(text), 8) * 5.0::DOUBLE AS x1, top, top + 9 AS bottom, CASE WHEN i % 17 = 0 THEN 6.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM b)"""
BINS = f"{PAGE_WORDS}, bins AS (SELECT doc_id, page, least(floor(((x0 + x1) / 2 - 180) / 2), 120)::INTEGER AS bin, count(*) AS n FROM words WHERE (x0 + x1) / 2 BETWEEN 180 AND 420 GROUP BY ALL), hist AS (SELECT e.doc_id, e.page, e.bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT doc_id, page, unnest(range(121))::INTEGER AS bin FROM bins) e LEFT JOIN bins USING (doc_id, page, bin))"
METRICS = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
 s AS (SELECT q.id AS qid, c.id, round(list_dot_product(q.e, c.e) / (q.n * c.n), 6) AS score, (q.label = c.label)::INTEGER AS rel, q.label FROM u q JOIN u c ON q.id % 50 = 0),
 run AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 100),
 o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR DESC) AS place FROM run),
 w AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY place) AS seen FROM o), c AS (SELECT label, count(*) AS n FROM v GROUP BY label),
 d AS (SELECT unnest(range(1, 11)) AS r), m AS (SELECT qid, any_value(c.n) AS n, """ + ", ".join(f"coalesce(sum(rel / log2(place + 1)) FILTER (place <= {k}), 0) / (SELECT sum(1 / log2(r + 1)) FROM d WHERE r <= least({k}, any_value(c.n))) AS ndcg_{k}" for k in evaluation.CUTS) + """,
 coalesce(sum(rel) FILTER (place <= 100), 0) / any_value(c.n)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(place) FILTER (rel > 0), 0) AS rr, coalesce(sum(seen / place::DOUBLE) FILTER (rel > 0), 0) / any_value(c.n)::DOUBLE AS ap FROM w JOIN c USING (label) GROUP BY qid)"""
SLOTS = " AND ".join("(" + " OR ".join(f"contains(lower(text), '{a}')" for a in s) + ")" for s in (("the", "der", "les", "que"), ("and", "und", "et"), ("tion", "ung", "ción")))
TURNS = "turns AS (SELECT *, coalesce(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations)"
CONTEXTS = f"{arms_sql(K)}, ctx AS (SELECT q.qid, q.qtext, coalesce(string_agg(p.text, chr(10) || chr(10) ORDER BY p.rank), '') AS context FROM q LEFT JOIN lex_p p ON p.qid = q.qid AND p.rank <= 3 GROUP BY ALL)"
KEY = "md5(to_json({{'config': {{'preset': 'best', 'top_k': 20}}, 'query': {t}}})::VARCHAR)"
FACTS = f"""{REPORTS}, g AS (SELECT o_custkey AS doc_id, o_orderkey, {CELLS} AS cells, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
 f AS (SELECT g.*, 'Report of ' || c_name || ' ' AS caption, cells[1] || ' ' || cells[2] AS label FROM g JOIN customer ON doc_id = c_custkey WHERE size >= 2)"""

ORACLES = {
    "scan_documents": "SELECT doc_id, source, length(text)::BIGINT AS n, md5(text) AS text_md5 FROM documents",
    "source_list": "SELECT DISTINCT source FROM documents",
    "source_filter_semi": "SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)",
    "doc_blank_filter": "SELECT conv_id, turn, md5(t) AS text_md5 FROM (SELECT conv_id, turn, " + STRIP.format(t="text") + " AS t FROM conversations WHERE turn % 3 <> 0) WHERE t <> ''",
    "union_sources": "SELECT 0::INTEGER AS src_order, doc_id AS id, md5(text) AS text_md5 FROM documents UNION ALL SELECT 1, page_id, md5(html) FROM pages UNION ALL SELECT 2, item_id, md5(text) FROM benchmark",
    "jsonl_title_text": "SELECT page_id AS id, md5(" + STRIP.format(t="CASE WHEN page_id % 3 <> 0 THEN url ELSE '' END || ' ' || html") + ") AS text_md5 FROM pages",
    "chunk_naive": "SELECT doc_id, pos::INTEGER AS pos, md5(substr(text, pos * 480 + 1, 500)) AS text_md5 FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 0 THEN (length(text) - 1) // 480 + 1 ELSE 0 END)) AS pos FROM documents)",
    "segment_table_prose": f"WITH {REPORTS} SELECT doc_id, 0::INTEGER AS seg, 'prose' AS kind, md5(head || chr(10) || prose) AS text_md5, substr(head, 1, 80) AS heading FROM reports UNION ALL SELECT doc_id, 1, 'table', md5('| {' | '.join(COLUMNS)} |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || array_to_string(rows, chr(10))), substr(head, 1, 80) FROM reports UNION ALL SELECT doc_id, 2, 'prose', md5('Closing words.'), substr(head, 1, 80) FROM reports",
    "last_heading": f"WITH {REPORTS} SELECT doc_id, rtrim(substr(head, 1, 80)) AS heading FROM reports",
    "md_table_render": f"SELECT o_custkey AS grid_id, md5('| {' | '.join(COLUMNS)} |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || array_to_string({CELLS}, ' | ') || ' |', chr(10) ORDER BY o_orderkey)) AS text_md5 FROM orders GROUP BY o_custkey",
    "md_table_facts_rows": f"WITH {FACTS} SELECT doc_id || ':1' AS grid_id, row_no::INTEGER AS row_no, caption || label || ': price ' || cells[3] || ' M, Exact Match EM ' || cells[4] || ', priority ' || cells[5] || '.' AS fact FROM f",
    "md_table_facts_cols": f"WITH {FACTS} SELECT doc_id || ':1' AS grid_id, c.col::INTEGER AS col, any_value(caption) || any_value(c.name) || ': ' || string_agg(label || ' ' || cells[c.col + 1], ', ' ORDER BY row_no) || '.' AS fact FROM f, (VALUES (2, 'price (M)'), (3, 'Exact Match EM'), (4, 'priority')) c(col, name) WHERE c.col <> 4 OR regexp_matches(cells[5], '^[0-9]\\S*$') GROUP BY doc_id, c.col HAVING count(*) >= 2",
    "label_expand_join": f"SELECT p_partkey, coalesce(({NAMES})[bare], bare) AS label FROM (SELECT p_partkey, trim(regexp_replace(trim({LABEL} || CASE WHEN p_size % 2 = 0 THEN ' ' || p_size || 'k ' ELSE '' END), '\\s+[0-9][0-9.]*[km]?\\s*$', '')) AS bare FROM part)",
    "number_token": r"WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[\[(]?[-+]?[0-9]')))::BIGINT AS numbers, len(list_filter(w, lambda x: regexp_matches(x, '^[\[(]?[-+]?[0-9]')))::BIGINT AS clean_numbers FROM t",
    "text_cleanup": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text || ' hyphen-' || chr(10) || ' ated page ' || doc_id || ' Page12 ' || chr(9) || ' end' || chr(10), '-\s*\n\s*', '', 'g'), '\bPage\s*[0-9]+\b', ' ', 'gi'), '\s+', ' ', 'g'))) AS text_md5 FROM documents",
    "notation_repair": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text || ' 3.3· | 10' || doc_id || ' and 7 ·1018, d = 2048. ff, d 512 ff', '([0-9][0-9.]*)\s*·\s*\|?\s*10([0-9]+)', '\1·10^\2', 'g'), '\bd\s*=?\s*([0-9]{3,5})\.?\s*ff\b', 'd_ff = \1', 'g')) AS text_md5 FROM documents",
    "line_assembly": f"WITH {PAGE_WORDS}, m AS (SELECT doc_id, page, median(size) AS mid FROM words GROUP BY ALL), s AS (SELECT w.*, mid, size < mid * 0.85 AS small FROM words w JOIN m USING (doc_id, page)), tops AS (SELECT DISTINCT doc_id, page, top AS t FROM s WHERE NOT small), near AS (SELECT s.doc_id, s.page, s.i, arg_min(t, struct_pack(a := abs(t - top), b := t)) AS near FROM s JOIN tops USING (doc_id, page) WHERE small GROUP BY ALL), x AS (SELECT s.*, (round_even(CASE WHEN small AND abs(near - top) <= mid * 0.6 THEN near ELSE top END / 3, 0) * 3)::INTEGER AS line FROM s LEFT JOIN near USING (doc_id, page, i)) SELECT doc_id, page, line, md5(string_agg(text, ' ' ORDER BY x0, top, text)) AS text_md5 FROM x GROUP BY doc_id, page, line",
    "gutter_histogram": f"WITH {BINS} SELECT doc_id, page, bin, n FROM hist",
    "gutter_split": f"WITH {BINS}, e AS (SELECT *, n <= max(n) OVER (PARTITION BY doc_id, page) * 0.10::DOUBLE AS empty FROM hist), i AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page, empty ORDER BY bin) AS island FROM e), r AS (SELECT doc_id, page, min(bin) AS a, count(*) AS l FROM i WHERE empty GROUP BY doc_id, page, island HAVING min(bin) > 0 AND min(bin) + count(*) <= 120 AND count(*) * 2 >= 6), x AS (SELECT doc_id, page, 180 + (2 * a + l) / 2 * 2.0::DOUBLE AS split FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY l DESC, a) = 1), s AS (SELECT doc_id, page, min((x0 + x1) / 2) AS lo, max((x0 + x1) / 2) AS hi FROM words GROUP BY ALL) SELECT doc_id, page, split FROM x JOIN s USING (doc_id, page) WHERE hi <= lo OR abs(split - (lo + hi) / 2) <= (hi - lo) / 2 * 0.25",
    "column_gaps": f"WITH {PAGE_WORDS}, s AS (SELECT DISTINCT doc_id, page, round_even(x0, 0) AS x FROM words), g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS p FROM s), i AS (SELECT doc_id, page, x - 5 AS x FROM g WHERE x - p > 24), e AS (SELECT doc_id, page, min(x0) - 5 AS a, max(x1) + 5 AS z FROM words WHERE (doc_id, page) IN (SELECT (doc_id, page) FROM i) GROUP BY ALL), a AS (SELECT doc_id, page, a AS x, 0 AS o FROM e UNION ALL SELECT doc_id, page, x, 1 FROM i UNION ALL SELECT doc_id, page, z, 2 FROM e) SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY o, x) - 1)::INTEGER AS n, x FROM a",
    "nearest_anchor": f"WITH {PAGE_WORDS}, h AS (SELECT doc_id, page, (x0 + x1) / 2 AS hx, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) AS c FROM words WHERE i % 400 BETWEEN 2 AND 6), f AS (SELECT doc_id, page, min_by(hx, c) AS first_x FROM h GROUP BY ALL), x AS (SELECT w.doc_id, w.page, w.i, CASE WHEN (w.x0 + w.x1) / 2 < any_value(first_x) - 15 THEN 0 ELSE arg_min(h.c, struct_pack(a := abs(hx - (w.x0 + w.x1) / 2), b := h.c)) END AS col FROM words w JOIN h USING (doc_id, page) JOIN f USING (doc_id, page) GROUP BY w.doc_id, w.page, w.i, w.x0, w.x1) SELECT doc_id, page, col::INTEGER AS col, count(*) AS n FROM x GROUP BY ALL",
    "word_bbox_anti": f"WITH {PAGE_WORDS}, box AS (SELECT doc_id, page, min(x0) + 100 AS a, max(x1) - 100 AS b, min(top) + 28 AS c, max(bottom) - 28 AS d FROM words GROUP BY ALL) SELECT doc_id, page, count(*) AS n, sum(i)::BIGINT AS places FROM words JOIN box USING (doc_id, page) WHERE NOT ((x0 + x1) / 2 BETWEEN a AND b AND (top + bottom) / 2 BETWEEN c AND d) GROUP BY ALL",
    "number_bands": f"WITH {PAGE_WORDS}, l AS (SELECT doc_id, page, (round_even(top / 3, 0) * 3)::INTEGER AS line, count(*) FILTER (length(text) % 3 > 0 OR regexp_matches(text, '^[\\[(]?[-+]?[0-9]')) AS k FROM words WHERE size > 6 GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - row_number() OVER (PARTITION BY doc_id, page, k >= 2 ORDER BY line) AS g FROM l) SELECT doc_id, page, min(line) AS first, max(line) AS last, count(*) AS n FROM i WHERE k >= 2 GROUP BY doc_id, page, g HAVING count(*) >= 4 AND max(k) >= 3",
    "ndcg_at_k": f"WITH {METRICS} SELECT qid, {', '.join(f'round(ndcg_{k}, 6) AS ndcg_{k}' for k in evaluation.CUTS)} FROM m",
    "recall_100": f"WITH {METRICS} SELECT qid, round(recall, 6) AS recall FROM m",
    "mrr": f"WITH {METRICS} SELECT qid, round(rr, 6) AS rr FROM m",
    "mean_average_precision": f"WITH {METRICS} SELECT qid, round(ap, 6) AS ap FROM m",
    "ir_macro_mean": f"WITH {METRICS} SELECT count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in (*(f'ndcg_{k}' for k in evaluation.CUTS), 'recall', 'rr', 'ap'))} FROM m",
    "keyword_score": f'SELECT doc_id, {SLOTS} AS "right" FROM documents',
    "qa_accuracy_rollup": f"SELECT lang, source, count(*) AS n, round(avg(r::INTEGER), 6) AS accuracy, round(avg(j::INTEGER), 6) AS judge_accuracy, count(*) FILTER (r <> j) AS disagreements FROM (SELECT lang, source, {SLOTS} AS r, quality = 1 AS j FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang, source)",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type",
    "latest_run_per_config": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "unpivot_metrics": "SELECT p_partkey, 'size' AS metric, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    "history_window": f"WITH {TURNS} SELECT conv_id, turn, md5(history) AS text_md5 FROM turns",
    **{n: f"WITH {TURNS} SELECT conv_id, turn, md5({quoted(t, query='text', history='history')}) AS text_md5 FROM turns WHERE role = 'user'" for n, t in PROMPTS.items()},
    "prompt_rag": f"WITH {CONTEXTS} SELECT qid, md5({quoted(prompts.RAG, query='qtext', context='context')}) AS text_md5 FROM ctx",
    "prompt_rag_chat": f"WITH {CONTEXTS}, {TURNS} SELECT conv_id, turn, md5({quoted(prompts.RAG_CHAT, query='text', history='history', context='context')}) AS text_md5 FROM ctx JOIN turns ON qid = conv_id WHERE role = 'user'",
    "prompt_judge": f"SELECT conv_id, turn, md5({quoted(prompts.JUDGE, question='text', expected='expected', answer='answer')}) AS text_md5 FROM (SELECT *, lead(text) OVER w AS answer, lead(text, 2) OVER w AS expected FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND expected IS NOT NULL",
    "answer_cache_key": f"SELECT conv_id, turn, {KEY.format(t='text')} AS key FROM conversations",
    "cache_miss_anti": f"WITH k AS (SELECT *, {KEY.format(t='text')} AS key FROM conversations) SELECT conv_id, turn, key FROM k WHERE role = 'user' AND key NOT IN (SELECT key FROM k WHERE turn <= 1)",
    "stream_events_ndjson": "SELECT conv_id, turn, 0::INTEGER AS seq, to_json({'type': 'meta', 'config': role})::VARCHAR AS line FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, pos::INTEGER, to_json({'type': 'token', 'text': word})::VARCHAR FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'))",
}
