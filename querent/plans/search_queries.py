"""Search queries over the tables, with the SQL that checks them.

Vector queries ask with every embedding whose vec_id is divisible by 50, text queries with every benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions.text import SPACE
from querent.functions.vectors import embedded, normalised, words_embedded
from querent.operators import fusion, graph, lexical, postings, vector
from querent.session import stored
from querent.tables import spread, table

K, POOL = 10, 30


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("src"), F.col("label")).alias("source"), "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source"))


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))


def hit_columns(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "id", "score")


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).select("id", F.posexplode(normalised(F.col("embedding"))).alias("pos", "x"))
    return rows.groupBy("id").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("length"), F.round(F.sum(F.col("x") * (F.col("pos") + 1)), 6).alias("moment"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(vector.exact_top_k(vector_queries(spark, sf), vectors(spark, sf), K))


def cosine_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter sits below the top-k, so it reaches the scan."""
    return hit_columns(vector.exact_top_k(vector_queries(spark, sf), vectors(spark, sf).where(F.col("label").isin(1, 3, 5)), K))


def faiss_flat_ip(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(vector.exact_top_k(vector_queries(spark, sf), vectors(spark, sf), K, cosine=False))


def cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = vectors(spark, sf).select("id", "embedding")
    centroids = vector.first_centroids(own, vector.cell_count(own.count()))
    return centroids, vector.assigned(own, centroids)


def ivf_assign(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf)[1].select("id", "cell_id")


def probing(spark: SparkSession, sf: str) -> DataFrame:
    centroids, filed = cells(spark, sf)
    centroids, filed = stored(centroids, "centres"), stored(filed, "cells")
    return vector.ivf_top_k(vector_queries(spark, sf), filed, centroids, K, vector.fitted_probes(filed, centroids, K))


def ivf_probe_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(probing(spark, sf))


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    found = probing(spark, sf)
    exact = vector.exact_top_k(vector_queries(spark, sf), vectors(spark, sf), K)
    return vector.recall(found, exact, K).select("qid", F.round("recall", 6).alias("recall"))


def ivf_kmeans_recall(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf).select("id", "embedding")
    centroids = vector.trained_centroids(own, vector.cell_count(own.count()))
    filed = stored(vector.assigned(own, centroids), "cells")
    found = vector.ivf_top_k(vector_queries(spark, sf), filed, centroids, K, vector.fitted_probes(filed, centroids, K))
    return vector.recall(found, vector.exact_top_k(vector_queries(spark, sf), own, K), K)


def lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(vector.lsh_top_k(vector_queries(spark, sf), vectors(spark, sf), K))


def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf).select("id", "embedding")
    return vector.recall(vector.lsh_top_k(vector_queries(spark, sf), own, K), vector.exact_top_k(vector_queries(spark, sf), own, K), K)


def graph_search(spark: SparkSession, sf: str) -> graph.Found:
    """Through the graph of neighbours; a query's own row takes no part, as a query from outside has none."""
    built = graph.knn_graph(vectors(spark, sf))
    return graph.graph_top_k(vector_queries(spark, sf), built, K, apart=True)


def graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(graph_search(spark, sf).hits)


def graph_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's recall against an exact search, and the share of the rows that a query looked at on average."""
    found = graph_search(spark, sf)
    exact = vector.exact_top_k(vector_queries(spark, sf), vectors(spark, sf), K + 1).where("qid != id")
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return vector.recall(found.hits, exact, K).withColumn("looked", F.lit(round(found.looked, 6)))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedded(chunks(spark, sf).select("id", "text")).select("id", F.posexplode("embedding").alias("pos", "x"))
    return rows.where("x != 0").select("id", "pos", F.round("x", 6).alias("x"))


def bm25_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.indexed(chunks(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_columns(lexical.top_k(text_queries(spark, sf), lexical.indexed(chunks(spark, sf)), K))


def blocks_search(spark: SparkSession, sf: str) -> postings.Hits:
    return postings.top_k(text_queries(spark, sf), postings.built(lexical.indexed(chunks(spark, sf))), K)


def bm25_blocks_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of ``bm25_topk`` from postings in blocks."""
    return hit_columns(blocks_search(spark, sf).hits)


def bm25_blocks_read(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks each item read of those that hold a term of it."""
    return blocks_search(spark, sf).read


def allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Each item may use three sources."""
    return text_queries(spark, sf).select("qid", F.explode(F.array(*(F.concat(F.lit("src"), F.pmod(F.col("qid") + n, F.lit(20))) for n in (0, 7, 13)))).alias("source"))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics come from all chunks, candidates from the allowed sources."""
    return hit_columns(lexical.top_k(text_queries(spark, sf), lexical.indexed(chunks(spark, sf)), K, allowed(spark, sf)))


def with_texts(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    """Hits with their texts: stored first, so that Spark knows their size, and sends them to the texts if they are few."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return stored(found, "hits").join(docs, "id").select("qid", "id", "text", "source", "score", "rank")


def lexical_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return with_texts(spark, sf, lexical.top_k(text_queries(spark, sf), lexical.indexed(chunks(spark, sf)), k))


def both_hits(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits by vectors and by BM25 with their texts: words are counted in one pass, vectors come from the counts, and texts are read once more for all hits."""
    index = lexical.indexed(chunks(spark, sf))
    dense = vector.exact_top_k(embedded(text_queries(spark, sf), "qtext", "qvec"), words_embedded(index.chunks), k)
    found = dense.withColumn("dense", F.lit(True)).unionByName(lexical.top_k(text_queries(spark, sf), index, k).withColumn("dense", F.lit(False)))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    whole = stored(stored(found, "hits").join(docs, "id").select("qid", "id", "text", "source", "score", "rank", "dense"), "hit-texts")
    return whole.where("dense").drop("dense"), whole.where("NOT dense").drop("dense")


def result_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "score", *more)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return result_columns(fusion.rrf(*both_hits(spark, sf, POOL), K))


def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return result_columns(fusion.weighted(*both_hits(spark, sf, POOL), K, 0.7))


def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return result_columns(fusion.reranked(lexical_hits(spark, sf, POOL).drop("id"), text_queries(spark, sf), K))


def two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of nine times k are fused to three times k, which the pair scorer cuts to k."""
    wide = fusion.rrf(*both_hits(spark, sf, 9 * K), 3 * K)
    return result_columns(fusion.reranked(wide, text_queries(spark, sf), K))


def compare_configs(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda df: df.select("qid", "rank", "text", "source", "score")
    return result_columns(fusion.compared(*map(own, both_hits(spark, sf, K)), ("dense", "bm25")), "side")


QUERIES = {f.__name__: f for f in (l2_normalize, cosine_topk, cosine_topk_filtered, faiss_flat_ip, ivf_assign, ivf_probe_topk, recall_at_k, ivf_kmeans_recall, lsh_topk, lsh_recall, graph_topk, graph_recall, hash_embed, bm25_index_terms, bm25_topk, bm25_blocks_topk, bm25_blocks_read, bm25_filtered, hybrid_rrf, hybrid_weighted, rerank_overlap, two_stage, compare_configs)}

# The SQL below is put together from named parts; each query adds its own last step.
VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v)"
SCORED = f"{VECTORS}, s AS (SELECT q.id AS qid, c.id, round(list_dot_product(q.e, c.e) / (q.n * c.n), 6) AS score, c.label FROM u q JOIN u c ON q.id % 50 = 0)"
TOP = "SELECT qid, rank, id, score FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM {s}) WHERE rank <= {k}"
CELLS = f"{VECTORS}, n AS (SELECT floor(sqrt(count(*)))::INTEGER AS cells FROM v), c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cell_id, e FROM v QUALIFY cell_id < (SELECT cells FROM n)), filed AS (SELECT v.id, v.e, c.cell_id, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.e, c.e), 6) DESC, c.cell_id) AS r FROM v CROSS JOIN c QUALIFY r = 1)"
#: The fewest cells whose recall@10 is 0.93 over the 256 vectors of the smallest md5 of their id.
PROBES = "sample AS (SELECT id, e FROM v ORDER BY md5(id::VARCHAR), id LIMIT 256), reached AS (SELECT s.id AS qid, c.cell_id, row_number() OVER (PARTITION BY s.id ORDER BY round(list_dot_product(s.e, c.e), 6) DESC, c.cell_id) AS r FROM sample s CROSS JOIN c), near AS (SELECT s.id AS qid, v.id, row_number() OVER (PARTITION BY s.id ORDER BY round(list_dot_product(s.e, v.e) / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(v.e, v.e))), 6) DESC, v.id) AS rank FROM sample s CROSS JOIN v QUALIFY rank <= 10), hit AS (SELECT reached.r FROM near JOIN filed f USING (id) JOIN reached USING (qid, cell_id)), probes AS (SELECT min(r) AS probes FROM (SELECT DISTINCT r, count(*) OVER (ORDER BY r) AS seen FROM hit) WHERE seen >= 0.93::DOUBLE * (SELECT count(*) FROM hit))"
PROBED = f"{CELLS}, {PROBES}, p AS (SELECT v.id AS qid, v.e, c.cell_id, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.e, c.e), 6) DESC, c.cell_id) AS r FROM v CROSS JOIN c WHERE v.id % 50 = 0 QUALIFY r <= (SELECT probes FROM probes)), found AS (SELECT p.qid, f.id, round(list_dot_product(p.e, f.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(f.e, f.e))), 6) AS score FROM p JOIN filed f USING (cell_id))"

WORDS = "list_filter(string_split_regex(lower(coalesce({t}, '')), '" + SPACE.replace("{", "{{").replace("}", "}}") + "+'), lambda x: x <> '')"
POSTINGS = f"d AS (SELECT doc_id AS id, text, source, {WORDS.format(t='text')} AS w FROM documents), post AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY ALL), corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM d), raw AS MATERIALIZED (SELECT term, count(*)::BIGINT AS df, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, corpus GROUP BY term, n), mean AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM raw), terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean_raw ELSE raw END AS idf FROM raw, mean)"
LEXICAL = f"{POSTINGS}, q AS (SELECT item_id AS qid, text AS qtext, {WORDS.format(t='text')} AS qw FROM benchmark), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(qw) AS term FROM q) GROUP BY ALL), m AS (SELECT qt.qid, post.id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.w) / avgdl))), 6) AS score FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN d USING (id), corpus GROUP BY ALL), lex AS (SELECT q.qid, d.id, coalesce(m.score, 0) AS score, d.source FROM q CROSS JOIN d LEFT JOIN m ON m.qid = q.qid AND m.id = d.id)"


def embedded_sql(name: str, key: str, source: str, words: str) -> str:
    """The hash embedder over rows of ``source`` with ``key`` and word lists."""
    return f"{name}_t AS (SELECT {key}, unnest({words}) AS t FROM {source}), {name}_h AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM {name}_t), {name}_s AS (SELECT {key}, b, sum(s) AS s FROM {name}_h GROUP BY ALL), {name}_n AS (SELECT {key}, sqrt(sum(s * s)) AS n FROM {name}_s GROUP BY {key}), {name} AS (SELECT {key}, b, s / CASE WHEN n = 0 THEN 1 ELSE n END AS x FROM {name}_s JOIN {name}_n USING ({key}))"


HYBRID = f"{LEXICAL}, {embedded_sql('de', 'id', 'd', 'w')}, {embedded_sql('qe', 'qid', 'q', 'qw')}, dots AS (SELECT qid, id, sum(qe.x * de.x) AS s FROM qe JOIN de USING (b) GROUP BY ALL), dense AS (SELECT q.qid, d.id, round(coalesce(s, 0), 6) + 0 AS score FROM q CROSS JOIN d LEFT JOIN dots ON dots.qid = q.qid AND dots.id = d.id)"


def arms_sql(pool: int) -> str:
    """Both pools with ranks, and one row per query and text of either."""
    pools = ", ".join(f"{n}_p AS (SELECT x.*, text, source FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {t} QUALIFY rank <= {pool}) x JOIN d USING (id))" for n, t in (("dense", "dense"), ("lex", "lex")))
    scaled = ", ".join(f"{n}_m AS (SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS unit FROM {n}_p WINDOW w AS (PARTITION BY qid))" for n in ("dense", "lex"))
    both = "both_arms AS (SELECT 0 AS arm, * FROM dense_m UNION ALL SELECT 1, * FROM lex_m)"
    one = "arms AS (SELECT qid, text, min(arm * 1000 + rank) AS seen, arg_min(source, arm * 1000 + rank) AS source, max(rank) FILTER (arm = 0) AS d_rank, max(rank) FILTER (arm = 1) AS l_rank, arg_max(unit, rank) FILTER (arm = 0) AS d_unit, arg_max(unit, rank) FILTER (arm = 1) AS l_unit FROM both_arms GROUP BY qid, text)"
    return f"{HYBRID}, {pools}, {scaled}, {both}, {one}"


def fused_sql(pool: int, score: str, k: int) -> str:
    return f"{arms_sql(pool)}, fused AS (SELECT qid, text, source, round({score}, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 6) DESC, seen) AS rank FROM arms QUALIFY rank <= {k})"


RRF = "coalesce(1.0::DOUBLE / (60 + d_rank), 0) + coalesce(1.0::DOUBLE / (60 + l_rank), 0)"
RESULT = "SELECT qid, rank::INTEGER AS rank, md5(text) AS text_md5, source, score FROM "
OVERLAP = "SELECT x.qid, x.text, x.source, round(len(list_intersect(list_distinct(q.qw), {w}))::DOUBLE / len(list_distinct(q.qw)), 6) AS score, row_number() OVER (PARTITION BY x.qid ORDER BY round(len(list_intersect(list_distinct(q.qw), {w}))::DOUBLE / len(list_distinct(q.qw)), 6) DESC, x.rank) AS place FROM {s} x JOIN q USING (qid) QUALIFY place <= 10"

ORACLES = {
    "l2_normalize": f"WITH {VECTORS}, x AS (SELECT id, unnest(list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)) AS x, unnest(range(1, len(e) + 1)) AS pos FROM u) SELECT id, round(sum(x * x), 6) AS length, round(sum(x * pos), 6) AS moment FROM x GROUP BY id",
    "cosine_topk": f"WITH {SCORED} {TOP.format(s='s', k=K)}",
    "cosine_topk_filtered": f"WITH {SCORED}, f AS (SELECT * FROM s WHERE label IN (1, 3, 5)) {TOP.format(s='f', k=K)}",
    "faiss_flat_ip": f"WITH {VECTORS}, s AS (SELECT q.id AS qid, c.id, round(list_dot_product(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.id % 50 = 0) {TOP.format(s='s', k=K)}",
    "ivf_assign": f"WITH {CELLS} SELECT id, cell_id FROM filed",
    "ivf_probe_topk": f"WITH {PROBED} {TOP.format(s='found', k=K)}",
    "recall_at_k": f"WITH {PROBED}, u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v), s AS (SELECT q.id AS qid, c.id, round(list_dot_product(q.e, c.e) / (q.n * c.n), 6) AS score FROM u q JOIN u c ON q.id % 50 = 0), a AS ({TOP.format(s='s', k=K)}), b AS ({TOP.format(s='found', k=K)}) SELECT a.qid, round(count(b.id) / count(*)::DOUBLE, 6) AS recall FROM a LEFT JOIN b ON a.qid = b.qid AND a.id = b.id GROUP BY a.qid".replace("u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v), n AS", "n AS"),
    "hash_embed": f"WITH d AS (SELECT doc_id AS id, {WORDS.format(t='text')} AS w FROM documents), {embedded_sql('de', 'id', 'd', 'w')} SELECT id, b::INTEGER AS pos, round(x, 6) AS x FROM de WHERE x <> 0",
    "bm25_index_terms": f"WITH own AS MATERIALIZED (SELECT doc_id AS id, unnest(list_distinct({WORDS.format(t='text')})) AS term FROM documents), counted AS MATERIALIZED (SELECT term, count(*)::BIGINT AS df FROM own GROUP BY term), rated AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents)::DOUBLE - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM counted) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM rated) ELSE raw END, 6) AS idf FROM rated",
    "bm25_topk": f"WITH {LEXICAL} {TOP.format(s='lex', k=K)}",
    "bm25_filtered": f"WITH {LEXICAL}, f AS (SELECT lex.* FROM lex WHERE source IN ('src' || (qid % 20), 'src' || ((qid + 7) % 20), 'src' || ((qid + 13) % 20))) {TOP.format(s='f', k=K)}",
    "hybrid_rrf": f"WITH {fused_sql(POOL, RRF, K)} {RESULT} fused",
    "hybrid_weighted": f"WITH {fused_sql(POOL, '0.7::DOUBLE * coalesce(d_unit, 0) + (1 - 0.7::DOUBLE) * coalesce(l_unit, 0)', K)} {RESULT} fused",
    "rerank_overlap": f"WITH {arms_sql(POOL)} {RESULT.replace('rank::INTEGER', 'place::INTEGER')} ({OVERLAP.format(w=WORDS.format(t='x.text'), s='lex_p')})",
    "two_stage": f"WITH {fused_sql(9 * K, RRF, 3 * K)} {RESULT.replace('rank::INTEGER', 'place::INTEGER')} ({OVERLAP.format(w=WORDS.format(t='x.text'), s='fused')})",
    "compare_configs": f"WITH {arms_sql(K)} SELECT qid, rank::INTEGER AS rank, md5(text) AS text_md5, source, score, 'dense' AS side FROM dense_p UNION ALL SELECT qid, rank::INTEGER, md5(text), source, score, 'bm25' FROM lex_p",
}
ORACLES["bm25_blocks_topk"] = ORACLES["bm25_topk"]
