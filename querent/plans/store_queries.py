"""Queries through stores, judgements, compound sources and page rules, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import borders, grids, layout, vector
from querent.operators import pages as whole_pages
from querent.plans.search_queries import ORACLES as SEARCHED
from querent.plans.search_queries import K, VECTORS, cells, hit_columns, vector_queries, vectors
from querent.plans.text_queries import CELLS, COLUMNS, HEADS, PAGE_WORDS, STRIP, md5, order_cells, words
from querent.session import stored_dir
from querent.sources import files, stores
from querent.sources.versions import KeyedStore
from querent.tables import table


def place(spark: SparkSession, kind: str) -> str:
    return f"{stored_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every other document is stored, then all are added: texts that are stored already don't come again."""
    path, own = place(spark, "chunks"), documents(spark, sf)
    stores.save_chunks(own.where("id % 2 = 0"), path)
    stores.add_chunks(spark, own, path)
    return stores.load_chunks(spark, path).select("id", "source", md5(F.col("text")).alias("text_md5"))


def chunk_store_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path, own = place(spark, "chunks"), documents(spark, sf)
    stores.save_chunks(own, path)
    stores.save_chunks(own.where("id % 3 = 0"), path)
    return stores.load_chunks(spark, path).select("id", "source", md5(F.col("text")).alias("text_md5"))


def keyed(spark: SparkSession, sf: str) -> KeyedStore:
    """Documents of even ids put by id; those divisible by 3 under another source; those divisible by 5 deleted; all of them added; those divisible by 7 under a third source, between two compactions."""
    store, own = KeyedStore(spark, place(spark, "keyed"), "id"), documents(spark, sf)
    store.put(own.where("id % 2 = 0"))
    store.put(own.where("id % 3 = 0").withColumn("source", F.lit("second")))
    store.delete(own.where("id % 5 = 0").select("id"))
    store.compact()
    store.add(own)
    store.put(own.where("id % 7 = 0").withColumn("source", F.lit("third")))
    store.compact()
    return store


def keyed_store(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(spark, sf).read().select("id", "source", md5(F.col("text")).alias("text_md5"))


def keyed_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, ids and sources of each version, read after all writes."""
    store, found = keyed(spark, sf), None
    for number in store.numbers():
        rows = store.read(number).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
        rows = rows.select(F.lit(number).alias("version"), "source", "n", "ids")
        found = rows if found is None else found.unionByName(rows)
    return found


def answer_store(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of first turns, then those of the third where there is one: the latest answer of a key counts."""
    path, turns = place(spark, "answers"), table(spark, sf, "conversations")
    key = F.col("conv_id").cast("string").alias("key")
    for turn in (0, 2):
        stores.cache_answers(turns.where(F.col("turn") == turn).select(key, F.col("text").alias("answer")), path)
    return stores.cached_answers(spark, path).select("key", md5(F.col("answer")).alias("answer_md5"))


def dense_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors built once for their configuration, and read from the cache the second time."""
    root = stores.cache_path(place(spark, "dense"), "vectors", {"embed_model": "given/64", "chunk_max_tokens": 128})
    own = table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    stores.loaded_or_built(spark, root, lambda: own, "label")
    return stores.loaded_or_built(spark, root, lambda: own.limit(0)).select("vec_id", F.col("label").cast("int").alias("label"), "size")


def judged_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that a document with a label of quality stands for."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    judged = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("qid"))
    return files.judged_only(asked, judged).select("qid", md5(F.col("text")).alias("text_md5"))


def judge_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_yes(F.concat(F.lit(" \n"), F.col("text"))).alias("yes"))


def compound_sources(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.concat(F.col("source"), F.lit(" + "), F.col("lang"), F.lit("+ +x "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.sources_in(whole), "|").alias("sources"))


def plausible_tables(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(order_cells()).alias("rows"))
    return own.select("o_custkey", grids.is_plausible(F.col("rows")).alias("plausible"))


def footnote_top(spark: SparkSession, sf: str) -> DataFrame:
    """Every 23rd word of a page is taken for a rule of its place."""
    own = words(spark, sf)
    pages = own.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(700.0).alias("height"))
    rules = own.where("i % 23 = 0").select("doc_id", "page", "x0", (F.col("x0") + F.col("i") % 100).alias("x1"), "top", (F.col("i") % 3).cast("double").alias("height"))
    return layout.footnote_tops(pages, rules)


def header_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells under the page's first words are one bare number, two of three words put as their lengths."""
    own = words(spark, sf).withColumn("text", F.when(F.length("text") % 3 > 0, F.length("text").cast("string")).otherwise(F.col("text")))
    return layout.alignment(own, own.where((F.col("i") % 400).between(2, 6))).select("doc_id", "page", F.round("score", 6).alias("score"))


#: Labels of the tables without lines.
SHORT = ("st", "price", "EM", "pri")


def sheets(spark: SparkSession, sf: str, a_page: int) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders as words in rows 14 points apart and columns 100 points apart below a line of labels, and the last row of each page."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf, "orders").withColumn("i", F.row_number().over(own) - 1)
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.expr(f"CAST(i DIV {a_page} AS INT)").alias("page"), (F.col("i") % a_page + 1).alias("row"), order_cells().alias("cells"))
    pages = rows.groupBy("doc_id", "page").agg(F.max("row").alias("last"))
    rows = rows.unionByName(pages.select("doc_id", "page", F.lit(0).alias("row"), F.array(*map(F.lit, COLUMNS)).alias("cells")))
    at = rows.select("doc_id", "page", "row", F.posexplode(F.transform("cells", lambda c: F.replace(c, F.lit(" "), F.lit("_")))).alias("col", "text"))
    x0, top = F.col("col") * 100.0 + 55.0, F.col("row") * 14.0 + 103.0
    number = F.xxhash64("doc_id", "page", "row", "col").alias("word_id")
    return at.select("doc_id", "page", number, "text", x0.alias("x0"), (x0 + F.length("text") * 3.0).alias("x1"), top.alias("top"), (top + 9.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit(True).alias("upright")), pages


def level_lines(at: DataFrame, row: Column) -> DataFrame:
    """Rules above ``row``, each drawn in two pieces a point apart."""
    half = lambda x, end, by: at.select("doc_id", "page", F.lit(x).alias("x0"), F.lit(end).alias("x1"), (row * 14.0 + 100.0 + by).alias("top"), F.lit(0.5).alias("height"))
    return half(50.0, 300.0, 0.0).unionByName(half(299.0, 550.0, 1.0))


def borders_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = level_lines(pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("r")), F.col("r"))
    bars = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"), F.lit(100.0).alias("top"), (F.col("last") * 14.0 + 114.0).alias("bottom"))
    return rules, bars.select("doc_id", "page", (F.col("c") * 100.0 + 50.0).alias("x"), "top", "bottom")


def bordered_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with borders, 20 rows a page, read back from their words and lines."""
    words, pages = sheets(spark, sf, 20)
    grid, _ = borders.bordered_tables(words, *borders_of(pages))
    return grid.select("doc_id", "page", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def ruled_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with a rule above and below the labels and one at the end, ten rows a page."""
    words, pages = sheets(spark, sf, 10)
    rules = pages.select("doc_id", "page", F.explode(F.array(F.lit(0), F.lit(1), F.col("last") + 1)).alias("r"))
    rules = rules.select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(550.0).alias("x1"), (F.col("r") * 14.0 + 100.0).alias("top"), F.lit(0.5).alias("height"))
    size = pages.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    grid, _ = whole_pages.ruled_tables(words, rules, size)
    return grid.select("doc_id", "page", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def unruled_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows without lines, with short labels over all columns but the first, and priorities by their word."""
    words = sheets(spark, sf, 10)[0]
    label = F.element_at(F.array(*map(F.lit, ("", *SHORT))), ((F.col("x0") - 55.0) / 100.0 + 1.0).cast("int"))
    text = F.when(F.col("top") == 103.0, label).when(F.col("x0") == 455.0, F.substring_index("text", "-", -1)).otherwise(F.col("text"))
    grid, _ = whole_pages.unruled_tables(words.withColumn("text", text).where("text != ''"))
    return grid.select("doc_id", "page", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def paper(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words, rules, sizes and bars of pages of a table with borders and a line of text below."""
    words, pages = sheets(spark, sf, 20)
    tail = pages.select("doc_id", "page", F.xxhash64("doc_id", "page").alias("word_id"), F.concat(F.lit("rows"), "last").alias("text"), F.lit(55.0).alias("x0"), F.lit(90.0).alias("x1"), F.lit(500.0).alias("top"), F.lit(509.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit(True).alias("upright"))
    size = pages.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    rules, bars = borders_of(pages)
    return words.unionByName(tail), rules, size, bars


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    words, rules, size, bars = paper(spark, sf)
    return whole_pages.page_texts(words, rules, size, 600.0, bars).select("doc_id", "page", md5(F.col("text")).alias("text_md5"))


def ivf_stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The search by cells through an index that was written and read again."""
    path = place(spark, "ivf")
    stores.save_cells(*reversed(cells(spark, sf)), path)
    filed, centres = stores.load_cells(spark, path)
    return hit_columns(vector.ivf_top_k(vector_queries(spark, sf), filed, centres, K, vector.fitted_probes(filed, centres, K)))


def vector_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first 300 vectors of odd ids as the base and the first 20 of even ids as the queries, at length one."""
    own = vectors(spark, sf)
    parts = stores.first_vectors(own.where("id % 2 = 1"), own.where("id % 2 = 0"), 300, 20)
    rows = [p.select(F.lit(side).alias("side"), "id", F.posexplode("embedding").alias("pos", "x")) for side, p in zip(("base", "query"), parts, strict=True)]
    return rows[0].unionByName(rows[1]).groupBy("side", "id").agg(F.round(F.sum(F.col("x") * (F.col("pos") + 1)), 6).alias("moment"))


QUERIES = {f.__name__: f for f in (chunk_store, chunk_store_overwrite, keyed_store, keyed_versions, answer_store, dense_cache, judged_queries, judge_verdict, compound_sources, plausible_tables, footnote_top, header_alignment, bordered_tables, ruled_tables, unruled_tables, page_texts, ivf_stored_topk, vector_split)}

WHOLE = f"list_transform({CELLS}, lambda c: replace(c, ' ', '_'))"


def sheets_sql(a_page: int) -> str:
    """The rows that ``sheets`` sets on pages."""
    return f"o AS (SELECT o_custkey AS doc_id, (i // {a_page})::INTEGER AS page, (i % {a_page} + 1)::INTEGER AS row_no, {WHOLE} AS cells FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)), p AS (SELECT doc_id, page, max(row_no) AS last FROM o GROUP BY ALL), s AS (SELECT * FROM o UNION ALL SELECT doc_id, page, 0, list_transform({HEADS}, lambda c: replace(c, ' ', '_')) FROM p)"


#: The rows of each version of ``keyed``.
KEYED = """o AS (SELECT doc_id AS id, source, text FROM documents), r(version, rule) AS (VALUES (1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5), (7, 5)),
v AS (SELECT version, id, text, CASE WHEN rule = 5 AND id % 7 = 0 THEN 'third' WHEN rule >= 2 AND id % 3 = 0 AND (rule < 4 OR id % 5 <> 0) THEN 'second' ELSE source END AS source
  FROM o, r WHERE rule >= 4 OR ((id % 2 = 0 OR rule >= 2 AND id % 3 = 0) AND (rule < 3 OR id % 5 <> 0)))"""
NUMBER = "^[\\[(]?[-+]?[0-9]"
ORACLES = {
    "bordered_tables": f"WITH {sheets_sql(20)} SELECT doc_id, page, row_no, array_to_string(cells, '|') AS cells FROM s",
    "ruled_tables": f"WITH {sheets_sql(10)} SELECT doc_id, page, row_no, array_to_string(cells, '|') AS cells FROM s JOIN p USING (doc_id, page) WHERE last >= 2",
    "unruled_tables": f"WITH {sheets_sql(10)} SELECT doc_id, page, row_no, CASE WHEN row_no = 0 THEN '|{'|'.join(SHORT)}' ELSE array_to_string(cells[1:4], '|') || '|' || split_part(cells[5], '-', 2) END AS cells FROM s JOIN p USING (doc_id, page) WHERE last >= 4",
    "page_texts": f"WITH {sheets_sql(20)} SELECT doc_id, page, md5(string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN row_no = 0 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row_no) || chr(10) || chr(10) || 'rows' || max(last)) AS text_md5 FROM s JOIN p USING (doc_id, page) GROUP BY doc_id, page",
    "ivf_stored_topk": SEARCHED["ivf_probe_topk"],
    "vector_split": f"WITH {VECTORS}, s AS (SELECT 'base' AS side, * FROM u WHERE id % 2 = 1 ORDER BY id LIMIT 300), t AS (SELECT 'query' AS side, * FROM u WHERE id % 2 = 0 ORDER BY id LIMIT 20), x AS (SELECT side, id, unnest(list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)) AS x, unnest(range(1, len(e) + 1)) AS pos FROM (SELECT * FROM s UNION ALL SELECT * FROM t)) SELECT side, id, round(sum(x * pos), 6) AS moment FROM x GROUP BY side, id",
    "chunk_store": "SELECT doc_id AS id, source, md5(text) AS text_md5 FROM documents WHERE doc_id % 2 = 0 OR md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)",
    "chunk_store_overwrite": "SELECT doc_id AS id, source, md5(text) AS text_md5 FROM documents WHERE doc_id % 3 = 0",
    "keyed_store": f"WITH {KEYED} SELECT id, source, md5(text) AS text_md5 FROM v WHERE version = 7",
    "keyed_versions": f"WITH {KEYED} SELECT version, source, count(*) AS n, sum(id)::BIGINT AS ids FROM v GROUP BY ALL",
    "answer_store": "SELECT conv_id::VARCHAR AS key, md5(arg_max(text, turn)) AS answer_md5 FROM conversations WHERE turn IN (0, 2) GROUP BY conv_id",
    "dense_cache": "SELECT vec_id, label::INTEGER AS label, len(embedding)::INTEGER AS size FROM embeddings",
    "judged_queries": "SELECT item_id AS qid, md5(text) AS text_md5 FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "judge_verdict": f"SELECT conv_id, turn, starts_with(upper({STRIP.format(t='text')}), 'Y') AS yes FROM conversations",
    "compound_sources": "SELECT doc_id, array_to_string(list_filter([trim(source), trim(lang), '', 'x'], lambda x: x <> ''), '|') AS sources FROM documents",
    "plausible_tables": f"SELECT o_custkey, count(*) >= 3 AND avg(list_sum(list_transform({CELLS}, lambda c: length(c))) / 5.0::DOUBLE) < 80 AS plausible FROM orders GROUP BY o_custkey",
    "footnote_top": f"WITH {PAGE_WORDS} SELECT doc_id, page, coalesce(min(top) FILTER (i % 23 = 0 AND i % 3 < 2 AND top > 420 AND i % 100 > 60), 700.0::DOUBLE) AS footnote_top FROM words GROUP BY doc_id, page",
    "header_alignment": f"WITH {PAGE_WORDS}, h AS (SELECT doc_id, page, (x0 + x1) / 2 AS hx, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) AS c FROM words WHERE i % 400 BETWEEN 2 AND 6), f AS (SELECT doc_id, page, min_by(hx, c) AS first_x FROM h GROUP BY ALL), x AS (SELECT w.doc_id, w.page, (round_even(w.top / 3, 0) * 3)::INTEGER AS line, w.text, CASE WHEN (w.x0 + w.x1) / 2 < any_value(first_x) - 15 THEN 0 ELSE arg_min(h.c, struct_pack(a := abs(hx - (w.x0 + w.x1) / 2), b := h.c)) END AS col FROM words w JOIN h USING (doc_id, page) JOIN f USING (doc_id, page) GROUP BY w.doc_id, w.page, w.i, w.x0, w.x1, w.top, w.text), g AS (SELECT doc_id, page, line, col, count(*) AS n, bool_and(length(text) % 3 > 0 OR regexp_matches(text, '{NUMBER}')) AS clean FROM x WHERE col > 0 GROUP BY ALL) SELECT doc_id, page, round(avg((n = 1 AND clean)::INTEGER), 6) AS score FROM g GROUP BY ALL",
}
