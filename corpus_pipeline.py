"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.common import Scratch, fresh, table
from tarnweave.llm.decontaminate import drop_contaminated
from tarnweave.llm.exact_dedup import drop_exact_duplicates
from tarnweave.llm.mixing import mix
from tarnweave.llm.quality import fit, score
from tarnweave.llm.simhash import drop_near_duplicates

#: A document stays from this quality on.
GOOD = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier (fitted to the labels of ``docs``) rejects.

    Null and empty texts are scored as one empty line, very long ones whole; repeated rows share
    their fate; a score of exactly GOOD stays; without labels all rows stay; an empty table stays empty.
    """
    name = fresh(docs, "_quality")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) >= GOOD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays.

    Null counts as empty; a null doc_id only stays where all of the text's rows have none; of rows
    that repeat doc_id and text one stays; very long texts are compared whole; an empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity of 0.8 or more stays, the one with the smallest doc_id.

    Texts without words (null, empty) are one group; a null doc_id only stays where its whole
    group has none; wholly repeated rows stay or go together; very long texts are read whole; an
    empty table stays empty.
    """
    return drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, edited or not.

    Null and empty texts, and items without words, match nothing; repeated rows are judged alike;
    very long texts are read whole; an empty table or benchmark drops nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (how often the mix takes the document) and taken words of every document in the mix.

    Null and empty texts have size 0; a null source is one of its own, last in order; rows of equal
    hash are interchangeable; an empty table gives an empty mix.
    """
    mixed = mix(docs)
    return mixed.where("epochs > 0").select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: No stage but exact dedup is expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = scratch.cut(after)
            if k:
                scratch.drop(docs)
        docs = after
    return docs
