"""One key holds more than a third of all rows; results stay whole and exact."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import history, lookup, rollup

ROWS = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """``i, key``: key 0 holds every fifth row and all of the first quarter."""
    key = F.when((F.col("i") % 5 == 0) | (F.col("i") < ROWS // 4), 0).otherwise(F.col("i") % 97)
    return spark.range(ROWS).withColumnRenamed("id", "i").withColumn("key", key.cast("bigint")).repartition(6)


def test_the_fixture_is_skewed(skewed):
    assert skewed.filter("key = 0").count() > ROWS / 3


def test_history_of_a_hot_user(spark, skewed):
    log = skewed.select(
        F.col("i").alias("doc_id"), F.col("key").alias("user_id"),
        F.timestamp_seconds(F.col("i") % 1000).alias("created_at"))
    want = {}
    for r in skewed.collect():
        want.setdefault(r.key, []).append((r.i % 1000, r.i))
    want = {u: [i for _, i in sorted(v, reverse=True)[:30]] for u, v in want.items()}
    got = {}
    for r in history.history_top_all(log).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.doc_id)
    assert got == want


def test_registration_of_a_hot_name(spark, skewed):
    new = skewed.select(F.concat(F.lit("u"), F.col("key").cast("string")).alias("username"), F.col("i").alias("seq"))
    users = spark.createDataFrame([(1, "u3")], "id int, username string")
    done = lookup.register_users(new, users)
    assert done.count() == ROWS
    accepted = {r.username: r.seq for r in done.filter("status = 200").collect()}
    first = {f"u{r.key}": r.first for r in skewed.groupBy("key").agg(F.min("i").alias("first")).collect()}
    first.pop("u3")
    assert accepted == first


def test_document_with_very_many_pages(spark, skewed):
    pages = skewed.select(
        F.col("key").alias("doc_id"), F.col("i").alias("page"), F.col("i").cast("string").alias("text"),
        F.lit(1.5).alias("confidence"),
        F.when(F.col("i") % 3 == 0, "unknown").when(F.col("i") % 2 == 0, "en").otherwise("hi").alias("detected_language"))
    rows = sorted((r.key, r.i) for r in skewed.collect())
    want, langs = {}, {}
    for key, i in rows:
        want.setdefault(key, []).append(str(i))
        if i % 3:
            langs.setdefault(key, []).append("en" if i % 2 == 0 else "hi")
    got = {r.doc_id: r.text for r in rollup.document_text(pages).collect()}
    assert got == {k: "\n\n".join(v) for k, v in want.items()}
    parts = {}
    for r in rollup.document_parts(pages).orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(r.text)
    assert {k: "\n\n".join(v) for k, v in parts.items()} == got
    assert max(p.count("\n\n") for v in parts.values() for p in v) < rollup.BLOCK
    language = {r.doc_id: r.language for r in rollup.document_language(pages).collect()}
    assert language == {k: Counter(langs[k]).most_common(1)[0][0] for k in want}


def test_hot_and_missing_owners(spark, skewed):
    docs = skewed.select(F.col("i").alias("doc_id"), F.nullif(F.col("key"), F.lit(5)).alias("user_id"))
    users = spark.createDataFrame([(0, "zero"), (1, "one")], "id bigint, username string")
    joined = lookup.documents_with_owner(docs, users)
    assert joined.count() == ROWS
    want = Counter(r.key for r in skewed.collect())
    got = {r.username: r["count"] for r in joined.groupBy("username").count().collect()}
    assert (got["zero"], got["one"]) == (want[0], want[1])
