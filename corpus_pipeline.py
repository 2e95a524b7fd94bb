"""From raw documents to encoded training text: quality, exact and near copies, mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemine.llm import exact, mixing, pieces, quality, simhash
from tracemine.llm.common import DOCUMENT_COLUMNS, table, written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled ones of docs that are not held out.

    Null and empty texts are scored like others; rows that repeat are scored alike. Without labels all score 0.5, so none stays.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).select(*DOCUMENT_COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays: one row, also where that row repeats. Null equals empty; a null doc_id is the smallest."""
    return exact.exact_dedup(docs).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the first document by doc_id stays, null last; rows are told apart by doc_id and text, and of rows that repeat one stays. Texts without words stay. An empty table stays empty."""
    return simhash.near_dedup(docs).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to three times, or not at all. Texts without words are not taken; a null source is one of its own."""
    return mixing.mixed(docs).select(*DOCUMENT_COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each copy that the mix takes. Rows that repeat are encoded each."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The fitted classifier, the fingerprints' links and the random rounding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; empty tables give an empty result.

    What a stage keeps is written once, as a table in the checkpoint folder, so the next one's several passes do not evaluate it again, and
    each reads the columns that it needs.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
