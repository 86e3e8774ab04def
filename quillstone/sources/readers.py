"""Sources: document tables, upload folders, text files, image catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import image_size
from ..operators.intake import plan_images
from .publish import read_batches

UPLOAD_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[pP][dD][fF]}"

# The stored documents table. Timestamps are UTC.
STORED_DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("corrected_text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
])

# A table of recognised texts.
TEXT_DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def documents(spark: SparkSession, path: str, schema: T.StructType = TEXT_DOCUMENT) -> DataFrame:
    """A documents table with a declared schema; selected columns prune the scan.

    With the schema of stored documents, all batches of that table.
    """
    if schema == STORED_DOCUMENT:
        return stored_documents(spark, path)
    return spark.read.schema(schema).parquet(path)


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The stored table that documents are appended to; empty where nothing has been."""
    return read_batches(spark, path, STORED_DOCUMENT)


def uploads(spark: SparkSession, path: str, glob: str = UPLOAD_GLOB) -> DataFrame:
    """``path, filename, length`` of a folder of uploads; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length")


def text_docs(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: one row per text file, whole contents."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sized_images(files: DataFrame) -> DataFrame:
    """``file, height, width`` of a ``path, content`` table by the files' headers, -1 where there is none."""
    sizes = files.select(F.col("path").alias("file"), image_size(F.col("content")).alias("_size"))
    return sizes.select(
        "file", *[F.coalesce(f"_size.{side}", F.lit(-1)).cast("int").alias(side) for side in ("height", "width")])


def image_catalog(spark: SparkSession, path: str, max_width: int = 2000, decode: bool = False) -> DataFrame:
    """``file, height, width, ok, target_w, target_h``; ``ok`` is false where no size can be told.

    Sizes come from the headers of PNG and JPEG files. A file whose header is
    sound and whose pixels are not still counts as ``ok``; ``decode`` reads
    every pixel to find those, and needs memory for the largest image.
    """
    if not decode:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return plan_images(sized_images(files), max_width)
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    sizes = images.select(
        F.col("image.origin").alias("file"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"))
    return plan_images(sizes, max_width)
