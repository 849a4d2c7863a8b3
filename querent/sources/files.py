"""Documents from folders of files: Markdown, plain text, DOCX and PDF.

Readers give (text, source) rows; blank files are left out. Bytes are read by Spark, so any store that it opens will do.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import stripped, titled
from querent.operators.chunking import lines
from querent.operators.grids import column_facts, markdown_grids, ordered, row_facts
from querent.operators.pages import page_texts
from querent.session import stored
from querent.sources.pdf import page_tables, read_pdf

#: Extensions that are documents.
EXTENSIONS = (".pdf", ".md", ".txt", ".docx")


def file_texts(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(text, source) of the files with ``extension`` right in ``folder``, without white space at the ends."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{extension}")
    rows = rows.select(stripped(F.col("value")).alias("text"), F.col("_metadata.file_name").alias("source"))
    return rows.where("text != ''")


def table_facts(docs: DataFrame) -> DataFrame:
    """(text, source): a sentence for each row and column of the Markdown tables of ``docs``; a source is one document."""
    grids = markdown_grids(lines(docs.select(F.col("source").alias("doc_id"), "text")))
    source = F.regexp_replace("grid_id", ":[0-9]+$", "").alias("source")
    facts = row_facts(grids).select(F.col("fact").alias("text"), source).unionByName(column_facts(grids).select(F.col("fact").alias("text"), source))
    return facts.where("text != ''")


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    return file_texts(spark, folder, ".txt")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each file as one document, and each fact of its tables as one."""
    docs = file_texts(spark, folder, ".md")
    return docs.unionByName(table_facts(docs))


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in their order; headings and titles as Markdown headings, tables as Markdown tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD_NS}body")
        styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else ElementTree.Element("none")
    names = {s.get(f"{WORD_NS}styleId"): s.find(f"{WORD_NS}name").get(f"{WORD_NS}val", "") for s in styles.iter(f"{WORD_NS}style") if s.find(f"{WORD_NS}name") is not None}

    def text_of(paragraph) -> str:
        marks = {f"{WORD_NS}t": lambda e: e.text or "", f"{WORD_NS}tab": lambda e: "\t", f"{WORD_NS}br": lambda e: "\n"}
        return "".join(marks[e.tag](e) for e in paragraph.iter() if e.tag in marks)

    out = []
    for block in body if body is not None else ():
        if block.tag == f"{WORD_NS}p" and text_of(block).strip():
            style = block.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
            key = style.get(f"{WORD_NS}val", "") if style is not None else ""
            name = names.get(key, key)
            out.append(f"## {text_of(block).strip()}" if name.lower().startswith("heading") or name.lower() == "title" else text_of(block))
        elif block.tag == f"{WORD_NS}tbl":
            for k, row in enumerate(block.findall(f"{WORD_NS}tr")):
                cells = ["\n".join(text_of(p) for p in c.findall(f"{WORD_NS}p")).replace("\n", " ").strip() for c in row.findall(f"{WORD_NS}tc")]
                out.append(f"| {' | '.join(cells)} |")
                if k == 0:
                    out.append(f"| {' | '.join(['---'] * len(cells))} |")
    return "\n".join(out)


def read_docx(spark: SparkSession, folder: str, errors: bool = False) -> DataFrame:
    """(text, source) of the folder's DOCX files; files that can't be read are left out, or listed with their error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder).select("content", F.col("_metadata.file_name").alias("source"))

    def run(batches):
        for batch in batches:
            texts, faults = [], []
            for data in batch.column("content").to_pylist():
                try:
                    texts.append(docx_text(data))
                    faults.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    texts.append(None)
                    faults.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("source"), pa.array(faults, pa.string())], ["text", "source", "error"])

    rows = files.mapInArrow(run, "text string, source string, error string")
    return rows if errors else rows.where("text IS NOT NULL AND text != ''").drop("error")


def pdf_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(text, source): each PDF file's pages as one document, tables as Markdown, and each fact of its tables as one. Unreadable files are left out."""
    tables = page_tables(stored(read_pdf(spark, folder), "pdf-pages"))
    pages = page_texts(tables.words, tables.rules, tables.pages, None, tables.bars)
    docs = pages.groupBy(F.col("doc_id").alias("source")).agg(stripped(ordered(F.col("text"), "page", "\n\n")).alias("text")).where("text != ''")
    docs = stored(docs.select("text", "source"), "pdf-texts")
    return docs.unionByName(table_facts(docs))


def read_documents(spark: SparkSession, folder: str, pdf: DataFrame | None = None) -> DataFrame:
    """(src_order, text, source) of all kinds: PDF files (or the texts that are handed over for them), Markdown, text, DOCX."""
    parts = [pdf if pdf is not None else pdf_documents(spark, folder), read_markdown(spark, folder), read_text(spark, folder), read_docx(spark, folder)]
    rows = [p.select(F.lit(k).alias("src_order"), "text", "source") for k, p in enumerate(parts)]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """The sorted names of the folder's documents."""
    names = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("source"))
    return names.where(F.lower("source").rlike(r"\.(pdf|md|txt|docx)$")).distinct().orderBy("source")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON lines with ``_id``, ``title`` and ``text``."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("id"), titled(F.col("title"), F.col("text")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, id, rel) of a table with tabs and a header."""
    rows = spark.read.schema("`query-id` string, `corpus-id` string, score int").csv(path, sep="\t", header=True)
    return rows.toDF("qid", "id", "rel")


def judged_only(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")
