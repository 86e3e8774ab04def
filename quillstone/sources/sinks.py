"""Sinks: text and JSON exports, and appends to the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import effective_text, export_base_name
from ..operators.lookup import find_documents
from ..operators.upload import process_uploads
from ..session import with_ids
from .publish import is_published, publish
from .readers import stored_documents

EXPORT_FORMATS = ("txt", "json", "docx", "pdf")


def export_text() -> Column:
    return effective_text(F.col("corrected_text"), F.col("raw_text"))


def export_txt(docs: DataFrame, path: str) -> None:
    """One text file per document in ``path/doc_id=<id>/``; the writer ends it with a newline.

    For documents somebody asked for: a folder each is too many for a whole
    table, which :func:`export_txt_bulk` is for.
    """
    docs.select("doc_id", export_text().alias("value")).write.partitionBy("doc_id").text(path)


def read_exported_txt(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of an :func:`export_txt` folder, the final newline removed."""
    files = spark.read.schema("value string, doc_id bigint").text(path, wholetext=True)
    return files.select("doc_id", F.regexp_replace("value", r"\n\z", "").alias("text"))


def export_txt_bulk(docs: DataFrame, path: str, buckets: int = 64, file_rows: int = 0) -> None:
    """Texts of a whole table in ``path/bucket=<n>/``: a line per document, id, tab and escaped text.

    Backslash, newline and carriage return are written ``\\\\``, ``\\n`` and ``\\r``.
    The number of folders does not grow with the table. ``file_rows`` limits the
    lines of a file, for readers that take files whole.
    """
    text = F.replace(export_text(), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("\t"), text).alias("value"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"),
    ).write.partitionBy("bucket").option("maxRecordsPerFile", file_rows).text(path)


def read_bulk_txt(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of an :func:`export_txt_bulk` folder."""
    return bulk_lines(spark.read.schema("value string, bucket bigint").text(path))


def bulk_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, text`` of the lines of bulk files, in ``value``."""
    body = F.regexp_replace("value", r"\A[^\t]*\t", "")
    # An escaped backslash is set aside while the other escapes are undone.
    parts = F.transform(F.split(body, r"\\\\", -1), lambda t: F.replace(
        F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return lines.select(
        F.substring_index("value", "\t", 1).cast("bigint").alias("doc_id"),
        F.array_join(parts, "\\").alias("text"))


def export_json(docs: DataFrame, path: str) -> None:
    """JSON lines ``{filename, text}``."""
    docs.select("filename", export_text().alias("text")).write.json(path)


def export_name(df: DataFrame, fmt: str | Column, filename: str = "filename") -> DataFrame:
    """Add ``export_name`` and ``error`` for a format name or column."""
    kind = F.lit(fmt) if isinstance(fmt, str) else fmt
    known = kind.isin(*EXPORT_FORMATS)
    name = F.concat(export_base_name(F.col(filename)), F.lit("."), kind)
    return df.withColumns({
        "export_name": F.when(known, name),
        "error": F.when(~F.coalesce(known, F.lit(False)), "Invalid format type"),
    })


def export_requested(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Answer ``doc_id, user_id, fmt`` export requests with ``status, export_name, text``.

    404 when the owner has no such document, else 400 for an unknown format.
    """
    chosen = docs.select("doc_id", "user_id", "filename", export_text().alias("text"))
    named = export_name(find_documents(requests, chosen), F.col("fmt"))
    status = F.when(F.col("status") == 404, 404).when(F.col("error").isNotNull(), 400).otherwise(200)
    served = F.col("status") == 200
    return named.withColumn("status", status).select(
        "doc_id", "user_id", "fmt", "status", F.when(served, F.col("export_name")).alias("export_name"),
        F.when(served, F.col("text")).alias("text"))


def append_documents(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append processed rows to the stored table with defaults and new ids; False for a batch it has already.

    Ids follow the largest stored one without gaps. Rows are dealt out by range
    of owner and id and sorted so within each file: a history reads the files
    and row groups whose range holds its user, and an owner of very many rows
    fills several. A batch without a key counts as new. One writer at a time.
    """
    spark = df.sparkSession
    batch = batch or uuid.uuid4().hex
    if is_published(spark, path, batch):
        return False
    last = stored_documents(spark, path).agg(F.max("id")).first()[0]
    rows = with_ids(df, last or 0).select(
        "id",
        "filename",
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("corrected_text", F.lit("")).alias("corrected_text"),
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.current_timestamp().alias("created_at"),
        F.col("user_id").cast("bigint").alias("user_id"),
    )
    return publish(_clustered(rows), path, batch)


def store_uploads(
    files: DataFrame, pages: DataFrame, path: str, batch: str | None = None, first_only: bool = False,
) -> bool:
    """Process uploads as :func:`process_uploads` does and append those accepted to the stored table.

    Ids, times and the order of rows are those of :func:`append_documents`; a
    batch whose key the table has already is not processed again, and False.
    Rejected uploads and files without pages leave no row.
    """
    if batch is not None and is_published(files.sparkSession, path, batch):
        return False
    processed = process_uploads(files, pages, first_only)
    return append_documents(processed.filter("reject_reason is null"), path, batch)


def _clustered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("user_id", "id").sortWithinPartitions("user_id", "id")


def cluster_documents(spark: SparkSession, path: str, out: str) -> None:
    """Copy a stored table to a new one with all batches clustered together, as one batch.

    For a table that has grown by many batches, where each user is met in some
    file of every batch. Ids and times stay.
    """
    publish(_clustered(stored_documents(spark, path)), out, "clustered")
