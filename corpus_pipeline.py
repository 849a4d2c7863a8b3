"""The corpus pipeline: toxic documents and near-duplicates go, personal data is blanked, sources are mixed, texts become tokens.

Nulls and edges: every stage takes null texts as empty, and empty texts, null or repeated ids, repeated rows, very long
texts and empty tables as rows like others; an empty table gives an empty one. Other columns, whatever their names, pass
through all stages but the last, which has columns of its own. What each stage decides is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querent.llm import bpe, mixing, pii, similar, toxicity
from querent.llm.queries import vocabulary
from querent.session import stored
from querent.tables import table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``docs``, doesn't reject.

    Equal texts fare alike; empty and null ones have the score of no features. Whole texts are scored. Without labels all
    documents stay.
    """
    return toxicity.kept(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, null ids last; of rows with one id and text the one
    with the smallest hash of its columns. Near-duplicates are what the fingerprints of operator 10 link, and pairs of a Jaccard similarity
    of 0.8. Texts without words are copies of each other; whole texts are compared.
    """
    return similar.kept(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the personal data in their whole texts put as its kind and n_chars as the new length; a null text stays null."""
    return pii.redacted(docs, pii.trained(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts without words have no size and are repeated like others of
    their source, once where it holds no words. A null source is one of its own. Repeated rows are placed side by side in a seeded order, so reruns agree.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; a text without tokens has an empty list."""
    return bpe.digests(docs, vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mix),
    ("bpe", tokens),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
