"""A corpus pipeline of five stages, each over all that the one before kept.

Toxic documents go, exact copies go, one document of each near-duplicate group
stays, sources are mixed to their target weights, and the mix is packed into
sequences. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmart.llm import exact_dedup, mixing, near_copies, packing, toxicity
from feedmart.llm.common import table
from feedmart.llm.queries import tokenizer_files


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic. A score depends on the text alone, so rows are found again by it: ids may repeat or be null."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), with_text_key=True)
    bad = scored.filter("predicted = 1").select("text_key").distinct()
    return docs.join(bad, toxicity.text_key("text") == bad["text_key"], "left_anti").select(*docs.columns)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.distinct_rows(docs, keep="max")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) one document stays, the one with the smallest id."""
    return near_copies.distinct_rows(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in their sequences, by id; the texts and other columns go no further."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("near dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scoring, tokenization and random places cannot be said in SQL; tests/llm holds the operators of all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
