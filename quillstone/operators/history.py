"""Per-user history: newest first, newest k, and the display line.

Only the columns a history needs are selected; document texts are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_decimal, or_default

HISTORY_TOP = 30


def _newest_first() -> list:
    return [F.col("created_at").desc(), F.col("doc_id").desc()]


def history(docs: DataFrame, user_id: int) -> DataFrame:
    """All documents of one user, newest first, ids breaking ties."""
    return docs.filter(F.col("user_id") == user_id).orderBy(*_newest_first())


def history_top(docs: DataFrame, user_id: int, k: int = HISTORY_TOP) -> DataFrame:
    """The newest ``k`` documents of one user (a top-k report)."""
    return history(docs, user_id).limit(k)


def history_top_all(docs: DataFrame, k: int = HISTORY_TOP) -> DataFrame:
    """The newest ``k`` documents of every user, with their rank.

    The rank limit is pushed below the shuffle, so each task sends at most
    ``k`` rows per user, however many one user has.
    """
    newest = Window.partitionBy("user_id").orderBy(*_newest_first())
    return docs.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def history_view(docs: DataFrame) -> DataFrame:
    """Display line: file name, language, upload time, confidence with one decimal."""
    conf = one_decimal(F.coalesce(F.col("confidence"), F.lit(0.0)))
    return docs.select(
        "doc_id", "user_id", "filename",
        or_default(F.col("language"), "–").alias("language"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded"),
        F.concat(conf, F.lit("%")).alias("confidence"),
    )
