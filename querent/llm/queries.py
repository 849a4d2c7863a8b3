"""The queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import bpe, divergence, langid, mixing, pii, repair, simhash, substrings, tiff, tokencount, topk, toxicity, warc
from querent.tables import table


def vocabulary() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a one-page TIFF file, and the digests of what is read back from it."""
    files = tiff.tiff_written(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.tiff_pages(files, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    kind = docs.schema["doc_id"].dataType
    return pages.select(
        F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(kind)).otherwise(F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"), vocabulary())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.trained(docs))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.spans(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.trained(docs))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_tiff": op3_tiff,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_substrings": op9_substrings,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_langid": op12_langid,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.SQL.format(vectors="embeddings"),
    "op5_mixing": mixing.SQL.format(documents="documents"),
    "op6_warc": warc.SQL.format(pages="pages"),
    "op11_divergence": divergence.SQL.format(documents="documents"),
    "op13_repair": repair.sql("conversations"),
}
