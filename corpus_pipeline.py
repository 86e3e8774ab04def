"""A corpus pipeline over the documents table, from language to packed sequences.

Each stage is ``(name, function)``; a function takes the session, the documents
its predecessor kept, and the table folder, and returns a DataFrame. All stages
but the last return the columns of the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import exact_dedup, jaccard, language_id, packing, suffix_dedup
from quillstone.llm.common import discard, recorded, ship_package, stored, table

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[str, list[str]] = {}  # per application: the intermediate tables that the last stage's result reads


def _after_another(stage: Stage) -> Stage:
    """A stage that first deletes what the stage before has left: its documents are stored by now."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_LEFT.pop(spark.sparkContext.applicationId, []))
        return _recording(stage)(spark, docs, sf_dir)
    return run_stage


def _recording(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with recorded() as places:
            out = stage(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = places
        return out
    return run_stage


@_recording
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Texts that are NULL, empty or without a letter go; equal rows are judged
    alike; an empty table, or one without labels to learn from, gives no rows.
    """
    ship_package(spark)
    return language_id.keep_known_languages(docs, language_id.fit_language_model(docs))


@_after_another
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the most code points, then the least id.

    NULL and empty texts are one group; NULL and repeated ids are rows of their
    own; an empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


@_after_another
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by similar shingle sets.

    Texts without words have no links and stay, NULL ones too; NULL and repeated
    ids are rows of their own; an empty table stays empty.
    """
    ship_package(spark)
    return jaccard.keep_one_of_each(docs)


@_after_another
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also occur elsewhere.

    A text that is all repeats stays as an empty one, NULL stays NULL; rows that
    repeat each other lose what they share; an empty table stays empty.
    """
    ship_package(spark)
    return suffix_dedup.drop_repeats(docs)


@_after_another
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: at least one of each document, NULL and empty texts included, by the end mark."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
