"""Batches that count once: appends, registrations and streams that are cut short and repeated."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.operators import history, lookup
from quillstone.operators.upload import enrich_uploads
from quillstone.plans import views
from quillstone.session import work_dir
from quillstone.sources import publish, readers, sinks
from quillstone.streaming import enrich as streaming


def rows(spark, n, users=5, first=0):
    return spark.range(first, first + n).selectExpr(
        "concat('f', id) AS filename", "'raw' AS raw_text", "CAST(NULL AS STRING) AS corrected_text",
        "'en' AS language", "1.5D AS confidence", f"id % {users} AS user_id")


def stored(spark, path):
    return sorted((r.id, r.filename) for r in readers.stored_documents(spark, path).collect())


def test_nothing_stored_yet(spark):
    path = work_dir(spark, "none")
    assert readers.stored_documents(spark, path).collect() == []
    assert sinks.append_documents(rows(spark, 0), path, "empty")
    assert readers.stored_documents(spark, path).collect() == []


def test_the_same_batch_twice_adds_nothing(spark):
    path = work_dir(spark, "twice")
    assert sinks.append_documents(rows(spark, 20), path, "a/b ü=1")
    before = stored(spark, path)
    assert not sinks.append_documents(rows(spark, 20), path, "a/b ü=1")
    assert not sinks.append_documents(rows(spark, 7, first=50), path, "a/b ü=1")
    assert stored(spark, path) == before and [i for i, _ in before] == list(range(1, 21))
    assert sinks.append_documents(rows(spark, 3, first=50), path, "other")
    assert [i for i, _ in stored(spark, path)] == list(range(1, 24))


def test_a_failed_attempt_leaves_the_table_as_it_was(spark):
    path = work_dir(spark, "failed")
    sinks.append_documents(rows(spark, 5), path, "first")
    before = stored(spark, path)
    broken = rows(spark, 50).withColumn("raw_text", F.when(
        F.col("filename") == "f33", F.raise_error(F.lit("broken row"))).otherwise(F.col("raw_text")))
    with pytest.raises(Exception, match="broken row"):
        publish.publish(broken, path, "second")
    assert stored(spark, path) == before and not publish.is_published(spark, path, "second")
    assert sinks.append_documents(rows(spark, 50), path, "second")
    assert len(stored(spark, path)) == 55


def test_what_lies_aside_is_not_read(spark):
    """A writer that was killed leaves its hidden folder behind."""
    path = work_dir(spark, "aside")
    sinks.append_documents(rows(spark, 5), path, "first")
    readers.stored_documents(spark, path).write.parquet(f"{path}/_staging-killed")
    assert len(stored(spark, path)) == 5


def test_a_batch_that_came_to_be_meanwhile(spark, monkeypatch):
    path = work_dir(spark, "meanwhile")
    sinks.append_documents(rows(spark, 5), path, "x")
    monkeypatch.setattr(publish, "_folder", lambda s, p, b, real=publish._folder: (
        Late(real(s, p, b)[0]), real(s, p, b)[1]))
    assert not publish.publish(readers.stored_documents(spark, path).limit(2), path, "x")
    monkeypatch.undo()
    assert len(stored(spark, path)) == 5


class Late:
    """A file system that does not see the folder at the first look."""

    def __init__(self, files):
        self.files, self.looks = files, 0

    def exists(self, place):
        self.looks += 1
        return self.looks > 1 and self.files.exists(place)

    def __getattr__(self, name):
        return getattr(self.files, name)


def users_of(spark, path):
    return sorted((r.id, r.username) for r in lookup.stored_users(spark, path).collect())


def test_registration_goes_on_from_its_own_verdict(spark, monkeypatch):
    path = work_dir(spark, "users")
    asked = spark.createDataFrame([("ann", 1), ("bob", 2), ("ann", 3)], "username string, seq int")

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(lookup, "with_ids", killed)
    with pytest.raises(RuntimeError):
        lookup.insert_users(asked, path, "b1")
    assert users_of(spark, path) == []
    monkeypatch.undo()
    for _ in range(2):
        verdict = {r.seq: r.status for r in lookup.insert_users(asked, path, "b1").collect()}
        assert verdict == {1: 200, 2: 200, 3: 400}
        assert [n for _, n in users_of(spark, path)] in (["ann", "bob"], ["bob", "ann"])
    assert {r.status for r in lookup.insert_users(asked, path, "b2").collect()} == {400}
    assert [i for i, _ in users_of(spark, path)] == [1, 2]


def test_stream_killed_between_write_and_commit(spark, sf_dir, monkeypatch):
    source, table, checkpoint = (work_dir(spark, n) for n in ("src", "table", "cp"))
    docs = readers.documents(spark, f"{sf_dir}/documents.parquet")
    docs.repartition(4).write.parquet(source)
    real, done = streaming.append_documents, []

    def killed_after_the_second(batch, path, key):
        real(batch, path, key)
        done.append(key)
        if len(done) == 2:
            raise RuntimeError("killed")

    def run():
        arriving = views.text_uploads(streaming.read_stream(spark, source, readers.TEXT_DOCUMENT, max_files=1))
        streaming.stream_store(arriving, table, checkpoint).awaitTermination()

    monkeypatch.setattr(streaming, "append_documents", killed_after_the_second)
    with pytest.raises(Exception, match="killed"):
        run()
    partly = readers.stored_documents(spark, table).count()
    run()
    assert done[1] == done[2] and len(set(done)) == len(done) - 1 == 4
    want = enrich_uploads(views.text_uploads(docs)).filter("reject_reason is null")
    got = readers.stored_documents(spark, table)
    assert 0 < partly < got.count()
    assert sorted(r.id for r in got.collect()) == list(range(1, want.count() + 1))
    columns = ["filename", "raw_text", "corrected_text", "language", "confidence", "user_id"]
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty() and got.count() == want.count()
    assert got.filter("created_at is null").isEmpty()


def opened(path, user):
    """Row groups whose range holds the user, and all row groups."""
    held = total = 0
    for file in glob.glob(f"{path.removeprefix('file:')}/batch-*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = next(c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))
                          if c.path_in_schema == "user_id")
            total += 1
            held += column.statistics.min <= user <= column.statistics.max
    return held, total


@pytest.fixture()
def many_files(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_history_opens_few_row_groups(spark, many_files):
    path, out = work_dir(spark, "layout"), work_dir(spark, "clustered")
    for b in range(3):
        sinks.append_documents(rows(spark, 4000, users=200, first=b * 4000), path, f"b{b}")
    held, total = opened(path, 77)
    assert total >= 40 and held <= 2 * 3
    sinks.cluster_documents(spark, path, out)
    assert stored(spark, out) == stored(spark, path)
    held, total = opened(out, 77)
    assert total >= 12 and held <= 2
    log = readers.stored_documents(spark, out).withColumnRenamed("id", "doc_id")
    assert history.history(log, 77).count() == 60


def test_an_owner_of_a_third_of_all_rows_fills_several_files(spark, many_files):
    path = work_dir(spark, "hot")
    hot = rows(spark, 9000).withColumn("user_id", F.expr("CASE WHEN substr(filename, 2) % 3 = 0 THEN 7 ELSE substr(filename, 2) % 500 END"))
    sinks.append_documents(hot, path, "b")
    held, total = opened(path, 7)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/batch-*/*.parquet")]
    assert total >= 14 and held >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)
