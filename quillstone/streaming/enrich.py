"""Continuous enrichment of newly arrived documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.upload import enrich_uploads
from ..sources.sinks import append_documents


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A Parquet folder as a stream of arriving files, or a single file as a stream of that one.

    The stream reads what lies in the folder itself, or in its partitions; a
    file is taken from its folder by its name, since a stream has no other way.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        path, glob = place.getParent().toString(), place.getName()
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_enrich(uploads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a row per arriving upload to Parquet, all available input, exactly once.

    The columns are those of :func:`enrich_uploads`: rejected uploads come with
    their reason, missing values with their defaults.

    Source offsets and the sink's commit log are kept under ``checkpoint`` and
    ``out``; both must be on storage that outlives an executor.
    """
    enriched = enrich_uploads(uploads).withColumn("processed_at", F.current_timestamp())
    return (
        enriched.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )


def stream_store(uploads: DataFrame, path: str, checkpoint: str, name: str = "uploads") -> StreamingQuery:
    """Process arriving uploads and append those accepted to the stored documents, each batch exactly once.

    A batch of the stream is a batch of the table, keyed by the stream's name and
    the batch's number. When a run ends between the write and the commit of a
    batch, the next run repeats it under the same key and the table leaves it
    out. A stream that starts anew on another checkpoint needs another name.
    """
    def store(batch: DataFrame, number: int) -> None:
        append_documents(enrich_uploads(batch).filter("reject_reason is null"), path, f"{name}-{number}")

    return (
        uploads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
