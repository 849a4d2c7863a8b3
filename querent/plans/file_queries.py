"""Queries through files of documents that tables are written to, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import SPACE
from querent.operators import pages as whole_pages
from querent.plans.store_queries import ORACLES as STORED
from querent.plans.store_queries import paper
from querent.plans.text_queries import PAGE_WORDS, md5, words
from querent.session import stored
from querent.sources import pdf, pdfwrite


def numbered(tables: pdf.PageTables) -> pdf.PageTables:
    """The tables with the numbers that they were written with: ids, and pages from 0."""
    back = lambda rows: rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "page": F.col("page") - 1})
    return pdf.PageTables(*map(back, tables))


def pdf_words(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' words written as PDF files and read back, by page and place; places are quarters of points."""
    word = F.when(~F.col("text").rlike(SPACE), F.struct(*pdfwrite.WORD)).alias("word")
    none = [F.lit(None).cast(f"struct<{', '.join(f'{c}: double' for c in columns)}>").alias(n) for n, columns in (("rule", pdfwrite.RULE), ("bar", pdfwrite.BAR))]
    own = words(spark, sf).select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(700.0).alias("height"), word, *none)
    found = pdf.pdf_pages(pdfwrite.drawn(own)).where("size(words) > 0")
    quarters = lambda c: F.round(c * 4).cast("int")
    placed = F.transform("words", lambda w: F.struct(quarters(w.top).alias("top"), quarters(w.x0).alias("x0"), F.concat_ws(":", w.text, quarters(w.x0), quarters(w.x1), quarters(w.top)).alias("word")))
    listed = F.array_join(F.transform(F.array_sort(placed), lambda w: w["word"]), " ")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("page") - 1).alias("page"), F.size("words").cast("long").alias("words"), md5(listed).alias("words_md5"))


def pdf_page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of ``page_texts`` written as PDF files, and the texts of what is read back."""
    own, rules, size, bars = paper(spark, sf)
    found = stored(pdf.pdf_pages(pdfwrite.pdf_files(own, rules, size, bars)), "pdf-pages")
    back = numbered(pdf.page_tables(found))
    return whole_pages.page_texts(back.words, back.rules, back.pages, 600.0, back.bars).select("doc_id", "page", md5(F.col("text")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (pdf_words, pdf_page_texts)}
ORACLES = {
    "pdf_words": f"WITH {PAGE_WORDS}, q AS (SELECT doc_id, page, text, round(x0 * 4)::INTEGER AS x0, round(x1 * 4)::INTEGER AS x1, round(top * 4)::INTEGER AS top FROM words WHERE NOT regexp_matches(text, '{SPACE}')) SELECT doc_id, page, count(*) AS words, md5(string_agg(text || ':' || x0 || ':' || x1 || ':' || top, ' ' ORDER BY top, x0)) AS words_md5 FROM q GROUP BY doc_id, page",
    "pdf_page_texts": STORED["page_texts"],
}
