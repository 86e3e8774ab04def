"""Lookups over documents and users."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_ids
from ..sources.publish import batch_path, is_published, publish, read_batches


STORED_USER = "id bigint, username string"
KEYS = ["doc_id", "user_id"]


def find_documents(
    requests: DataFrame, docs: DataFrame, work: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Requested documents by id and owner with ``status`` 200 or 404.

    The documents are first cut down to those asked for, by a semi join with
    the distinct keys of the requests: few requests are broadcast, and the
    documents with their texts stay where they are. ``work`` is applied to what
    is found, once per document however often it is requested.
    """
    found = docs.join(requests.select(*KEYS).distinct(), KEYS, "left_semi")
    if work:
        found = work(found)
    joined = requests.join(found.withColumn("_found", F.lit(True)), KEYS, "left")
    return joined.withColumn("status", F.when(F.col("_found"), 200).otherwise(404)).drop("_found")


def documents_with_owner(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with their owner's name; ownerless documents stay.

    They match nobody, so in the join each goes by its own number and not by
    NULL, which would gather them in one task. No broadcast is forced: the
    planner broadcasts users only while their measured size is under its
    threshold, else adaptive execution splits owners that hold many documents.
    """
    owner = users.filter("id is not null").select(
        F.col("id").cast("bigint").alias("_key"), "username")
    owned = F.col("user_id").isNotNull()
    keyed = docs.withColumns({
        "_key": F.coalesce(F.col("user_id").cast("bigint"), F.xxhash64("doc_id")), "_owned": owned})
    joined = keyed.join(owner, (keyed["_key"] == owner["_key"]) & keyed["_owned"], "left")
    return joined.select("user_id", *[c for c in docs.columns if c != "user_id"], "username")


def owned_documents(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Documents whose owner exists."""
    return docs.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def register_users(new: DataFrame, users: DataFrame) -> DataFrame:
    """Insert-if-absent for a batch of ``username, seq`` requests (``seq`` unique).

    Each request gets ``status`` 200 or 400; within the batch the lowest
    ``seq`` of a name wins. The winner is a ``min`` aggregate (combined before
    its shuffle), and the verdict joins back on name and sequence, so one name
    asked for by a third of all requests makes no hot task.
    """
    first = new.groupBy("username").agg(F.min("seq").alias("seq"))
    accepted = first.join(users.select("username"), "username", "left_anti")
    verdict = new.join(accepted.withColumn("_ok", F.lit(True)), ["username", "seq"], "left")
    ok = F.col("_ok").isNotNull()
    return verdict.select(
        "username", "seq",
        F.when(ok, 200).otherwise(400).alias("status"),
        F.when(ok, "User created successfully")
        .otherwise("Username already registered").alias("message"),
    )


def stored_users(spark: SparkSession, path: str) -> DataFrame:
    """The users table that registrations are added to."""
    return read_batches(spark, path, STORED_USER)


def insert_users(new: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Register a batch against the stored users table and add those accepted, with new ids.

    Returns the verdict of :func:`register_users`. It is published before the
    users are, below the table's hidden folder ``_verdicts``, so a batch that is
    repeated after it was cut short goes on from its own verdict, and one that
    was finished changes nothing and gets the same answer. One writer at a time.
    """
    spark = new.sparkSession
    batch = batch or uuid.uuid4().hex
    verdicts = f"{path.rstrip('/')}/_verdicts"
    publish(register_users(new, stored_users(spark, path)), verdicts, batch)
    verdict = spark.read.schema(
        f"username string, seq {new.schema['seq'].dataType.simpleString()}, status int, message string",
    ).parquet(batch_path(verdicts, batch))
    if not is_published(spark, path, batch):
        base = stored_users(spark, path).agg(F.max("id")).first()[0] or 0
        accepted = verdict.filter("status = 200").select("username")
        publish(with_ids(accepted, base).select("id", "username"), path, batch)
    return verdict
