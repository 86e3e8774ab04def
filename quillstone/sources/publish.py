"""Tables of batches: each is written aside, becomes visible by one rename, and counts once.

A batch is a folder of Parquet files below the table, named by its key. Rows go
to a hidden folder first, so a failed attempt leaves the table as it was; a batch
whose key is there already is not written again, so repeating one adds nothing.
Renaming is atomic on file systems that rename folders atomically, such as HDFS
and local disks. One writer at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def batch_path(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/batch-{quote(batch, safe='')}"


def _folder(spark: SparkSession, path: str, batch: str):
    """File system and place of a batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(batch_path(path, batch))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_published(spark: SparkSession, path: str, batch: str) -> bool:
    files, place = _folder(spark, path, batch)
    return files.exists(place)


def publish(df: DataFrame, path: str, batch: str) -> bool:
    """Add the rows to the table as one batch; False where the table has that batch already."""
    spark = df.sparkSession
    files, place = _folder(spark, path, batch)
    if files.exists(place):
        return False
    fs = spark._jvm.org.apache.hadoop.fs
    aside = fs.Path(path, f"_staging-{uuid.uuid4().hex}")
    try:
        df.write.parquet(aside.toString())
        # unlike a plain rename, this one refuses a folder that has come to be meanwhile
        context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(
            files.makeQualified(aside), files.makeQualified(place), spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Exception:
        files.delete(aside, True)
        if files.exists(place):
            return False
        raise
    return True


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All published rows, and those of files that lie in the table's folder itself; no rows where there is no table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
