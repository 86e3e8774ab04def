"""Session helpers: building a session, a shared work folder, scan parallelism."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and the UTC clock the data model assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder named by ``spark.checkpoint.dir``.

    Every executor must see the folder, so a machine-local one is used only
    when the setting is absent and the session itself is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="quillstone-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a table on ``keys`` into as many partitions as the caller asks for.

    For tables in too few files to occupy the cores, a plain setting of the
    session, ``spark.quillstone.spread``; without it the table is left alone.
    """
    parts = int(df.sparkSession.conf.get("spark.quillstone.spread", "0"))
    return df.repartition(parts, *keys) if parts else df


def with_ids(df: DataFrame, base: int, out: str = "id") -> DataFrame:
    """Add dense ids ``base + 1, base + 2, ...`` without passing the rows through one task.

    The rows are written once with the task they came from and their place in
    it; each task's offset is the sum of the counts before it, one row a task.
    """
    spark = df.sparkSession
    path = work_dir(spark, "numbered")
    place = F.monotonically_increasing_id()
    df.withColumns({"_task": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}).write.option(
        "compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_task").withColumn(
        out, F.col("_offset") + F.col("_place") + F.lit(base + 1)).drop("_task", "_place", "_offset")
