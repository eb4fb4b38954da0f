"""The corpus pipeline: quality rules, near duplicates, repeated substrings,
packing. Each stage takes (spark, docs, sf_dir) and works on all that the one
before kept; all but the last return the columns of documents.

Rows are not joined by position, so stages accept nulls, empty and repeated
rows and further columns as their operators do. A document whose text is
wholly repeated stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import jaccard, packing, quality, suffix
from callweave.llm.common import cut, drop_since, read, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the one with the
    smallest id."""
    return jaccard.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings that start in a smaller document too."""
    out = suffix.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("repeated substrings", drop_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        name = name.replace(" ", "-")
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_since(before, name)  # what the stage has read and written on its way
    return STAGES[-1][1](spark, docs, sf_dir)
