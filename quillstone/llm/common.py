"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

# ASCII white space: the separators of words here, and what bytes.split() splits at.
ASCII_SPACE = r"[\x20\x09-\x0D]"

_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def written_lean(spark: SparkSession) -> Iterator[None]:
    """For writes in this block: small Arrow batches of texts, and no shuffle files left once one has ended."""
    before = {name: spark.conf.get(name, None) for name in _LEAN}
    for name, value in _LEAN.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


_RECORDED: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that this block stores intermediate tables in and does not discard itself."""
    places: list[str] = []
    _RECORDED.append(places)
    try:
        yield places
    finally:
        _RECORDED.remove(places)


def new_place(spark: SparkSession, label: str) -> str:
    """A new folder of the shared one for an intermediate table."""
    path = work_dir(spark, label)
    for places in _RECORDED:
        places.append(path)
    return path


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete stored tables, or folders by name, that nothing reads any more."""
    for table_or_path in tables:
        path = table_or_path if isinstance(table_or_path, str) else table_or_path.stored_in
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        for places in _RECORDED:
            if path in places:
                places.remove(path)


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage, computes the rows once for several readers, and survives
    lost executors, since the files are not theirs. :func:`discard` deletes the
    files once their last reader has been stored itself.
    """
    path = new_place(df.sparkSession, label)
    with written_lean(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``_row, row``: a number of its own for every row, stored so that all readers see the same, and the input row."""
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), label, "zstd")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that their Python workers can import it; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quillstone-")  # the driver serves the file from there
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _SHIPPED.add(app)
