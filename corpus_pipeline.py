"""A training corpus from ``documents``: filter, deduplicate, pack.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the packed pieces. No stage before the last changes a row. An empty table passes all
stages empty. Columns beside ``doc_id``, ``text`` and ``lang`` are carried and may have any name.

A null text is empty: the language stage drops it. A null id is an id as any other. Rows that repeat an id are one document
in the deduplicating stages, which keep or drop all of them by their id: where an id has several texts, a row stays if
any row of its id is kept, and rows that are equal throughout stay together. The language and toxicity stages judge each row by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.exact_dedup import exact_duplicates
from fleetlens.llm.language import fit_languages, held_out, in_known_language
from fleetlens.llm.minhash import near_duplicates
from fleetlens.llm.packing import packed_documents
from fleetlens.llm.toxicity import fit_toxicity, not_toxic
from fleetlens.session import stored

NOISE_MARGIN = 128.0  # bits by which a text's code must exceed eight bits a byte to be taken for noise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _only(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id ``marked`` keeps; a null id is an id as any other."""
    kept = marked.filter("kept").select(marked["doc_id"].alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop text in no language: null, without a letter, or longer in each learned language's code than as plain bytes.

    The margin keeps text that is too short to tell. Learns from the documents that are not held out.
    """
    return in_known_language(docs, fit_languages(docs.filter(~held_out("doc_id", 3, 1))), margin=NOISE_MARGIN)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.3 or more. Learns from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    return not_toxic(docs, fit_toxicity(docs, labels), limit=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest id."""
    return _only(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, keep the one with the smallest id."""
    return _only(docs, near_duplicates(docs, percent=85))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 tokens."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# Language models and tokenizers are not SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
