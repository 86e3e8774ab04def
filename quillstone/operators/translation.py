"""Preparation of translation batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import languages
from ..functions.text import effective_text, is_blank
from .lookup import find_documents

CHUNK_LIMIT = 4500


def translation_chunks(docs: DataFrame, text: str = "text", limit: int = CHUNK_LIMIT) -> DataFrame:
    """Add ``chunk, truncated, error``.

    The service accepts ``limit`` code points per call; ``truncated`` says that
    the text was longer. Blank texts carry an error and no chunk.
    """
    t, blank = F.col(text), is_blank(F.col(text))
    return docs.withColumns({
        "error": F.when(blank, "No text to translate"),
        "chunk": F.when(~blank, F.substring(t, 1, limit)),
        "truncated": ~blank & (F.length(t) > limit),
    })


def translation_parts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHUNK_LIMIT,
) -> DataFrame:
    """``key, chunk_no, chunk``: the whole text as chunks of at most ``limit`` code points, in order.

    Joined in order they equal the text. Blank texts have none.
    """
    visible = F.when(~is_blank(F.col(text)), F.col(text))
    parts = F.regexp_extract_all(visible, F.lit(rf"(?s).{{1,{limit}}}"), 0)
    return docs.select(key, F.posexplode(parts).alias("chunk_no", "chunk"))


def with_target_names(df: DataFrame, target: str = "target") -> DataFrame:
    """Add ``target_name, supported`` for a target-code column.

    The language dimension (eighteen fixed rows) is broadcast.
    """
    known = languages(df.sparkSession).select(
        F.col("code").alias(target), F.col("name").alias("target_name"))
    named = df.join(F.broadcast(known), target, "left")
    return named.withColumn("supported", F.col("target_name").isNotNull())


def translation_requests(
    docs: DataFrame, target: str = "target", text: str = "text", limit: int = CHUNK_LIMIT,
) -> DataFrame:
    """Chunks and target names for documents that carry their target code."""
    return with_target_names(translation_chunks(docs, text, limit), target)


def translate_requested(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Prepare ``doc_id, user_id, target`` requests for stored documents.

    ``status`` is 404 for a missing document and 500 where there is no text.
    Only requested texts are cut.
    """
    chosen = effective_text(F.col("corrected_text"), F.col("raw_text"))

    def cut(found: DataFrame) -> DataFrame:
        return translation_chunks(found).drop("text")

    texts = docs.select("doc_id", "user_id", chosen.alias("text"))
    found = with_target_names(find_documents(requests, texts, cut))
    status = F.when(F.col("error").isNotNull(), 500).otherwise(F.col("status"))
    return found.select(
        "doc_id", "user_id", "target", status.alias("status"), "error", "supported",
        F.coalesce("truncated", F.lit(False)).alias("truncated"), "chunk")
