"""From raw documents to packed training pieces, in five stages.

Each stage works on all rows that its predecessor kept. The first four return the columns of
documents; the last returns one row per piece of a packed sequence, with its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from tracemill.llm.common import Scratch, ship
from tracemill.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the classifier learns from the labelled ones among all documents."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines or more stay where they occur first. Every document stays, empty ones too."""
    ship(spark)
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints of three-word shingles at 2 bits or fewer the document with the smallest id stays."""
    ship(spark)
    return simhash.keep_one(docs, words=3)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out. Every document stays."""
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: A trained classifier, tokenization and hashed candidates have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every result but the last is stored in the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return after
        after = scratch.save(after)
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = after
    return docs


def registered(queries: dict, oracle: dict) -> tuple[dict, dict]:
    """The operators' queries and SQL with the pipeline's."""
    return queries | {"pipeline": run}, oracle | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
