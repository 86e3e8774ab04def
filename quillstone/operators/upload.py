"""The whole way of an upload: intake, repair, roll-up, analysis, and the row to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import effective_text
from ..session import work_dir
from .classification import classify
from .extraction import extract_key_info
from .intake import intake_route
from .repair import correct_text
from .rollup import best_candidate, first_page, multi_page_document, snapshot_confidence

UNKNOWN = "unknown"


def _stored_row(analysed: DataFrame, error: Column) -> DataFrame:
    """Stored columns with their defaults; an upload that failed has an error and nothing else."""
    ok = error.isNull()

    def shown(c: str, default: str | float | None = None) -> Column:
        value = F.col(c) if default is None else F.coalesce(F.col(c), F.lit(default))
        return F.when(ok, value).alias(c)

    return analysed.select(
        "doc_id", "user_id", "filename", error.alias("reject_reason"), shown("raw_text", ""),
        shown("corrected_text", ""), shown("language", UNKNOWN), shown("confidence", 0.0),
        shown("classification"), shown("key_info"))


def enrich_uploads(uploads: DataFrame) -> DataFrame:
    """One row per upload of ``doc_id, user_id, filename, length, text, language, confidence``.

    Rejected by name or size, else repaired, classified and searched for key
    information. Stateless columns only, the same for batch and stream; texts
    of rejected uploads are not looked at.
    """
    routed = intake_route(uploads)
    read = routed.withColumn("raw_text", F.when(F.col("accepted"), F.col("text"))).drop("text")
    analysed = extract_key_info(classify(correct_text(read, "raw_text"), "corrected_text"), "corrected_text")
    return _stored_row(analysed, F.col("reject_reason"))


def camera_results(readings: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, text, raw_text, confidence`` of each snapshot.

    The best of its readings (``doc_id, pref, text``), repaired, and the mean
    word confidence of that reading (``doc_id, page, conf``, the page being the
    reading's number); 0 where it has no words.
    """
    best = best_candidate(readings).withColumnRenamed("text", "raw_text")
    scores = snapshot_confidence(words).withColumnRenamed("page", "pref")
    scored = best.join(scores, ["doc_id", "pref"], "left")
    return correct_text(scored, "raw_text", "text").select(
        "doc_id", "text", "raw_text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def process_uploads(files: DataFrame, pages: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per file of ``doc_id, user_id, filename, length``, from its recognised pages.

    ``pages`` has ``doc_id, page, raw_text, confidence, detected_language``.
    Pages of rejected files are dropped before their texts move. Pages are
    repaired, rolled up to documents, and the chosen text is classified and
    searched. ``first_only`` is the form for identity documents: first page
    only. A file without pages is an error. The pages that count are stored
    once with their repaired texts, since every roll-up reads them.
    """
    routed = intake_route(files)
    accepted = routed.filter("accepted").select("doc_id")
    read = pages.select("doc_id", "page", "raw_text", "confidence", "detected_language").join(accepted, "doc_id", "left_semi")
    if first_only:
        read = first_page(read)
    repaired, path = correct_text(read, "raw_text"), work_dir(pages.sparkSession, "upload-pages")
    repaired.write.option("compression", "zstd").parquet(path)
    merged = multi_page_document(pages.sparkSession.read.schema(repaired.schema).parquet(path))
    chosen = merged.withColumn("_text", effective_text(F.col("corrected_text"), F.col("raw_text")))
    analysed = extract_key_info(classify(chosen, "_text"), "_text").drop("_text", "error")
    joined = routed.join(analysed.withColumn("_pages", F.lit(True)), "doc_id", "left")
    no_pages = F.when(F.col("_pages").isNull(), "PDF contains no pages")
    return _stored_row(joined, F.coalesce("reject_reason", no_pages))
