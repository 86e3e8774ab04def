from pyspark.sql import functions as F

from quillstone.operators import extraction, history, lookup
from quillstone.plans import views


def test_find_documents(spark):
    docs = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "doc_id int, user_id int, filename string")
    asked = spark.createDataFrame([(1, 10), (1, 20), (3, 10), (1, 10)], "doc_id int, user_id int")
    got = sorted((r.doc_id, r.user_id, r.status) for r in lookup.find_documents(asked, docs).collect())
    assert got == [(1, 10, 200), (1, 10, 200), (1, 20, 404), (3, 10, 404)]


def test_register(spark):
    users = spark.createDataFrame([(1, "ann")], "id int, username string")
    new = spark.createDataFrame(
        [("ann", 1), ("bob", 2), ("bob", 3), ("Bob", 4)], "username string, seq int")
    got = {r.seq: (r.status, r.message) for r in lookup.register_users(new, users).collect()}
    assert {s: v[0] for s, v in got.items()} == {1: 400, 2: 200, 3: 400, 4: 200}
    assert got[1][1] == "Username already registered"


def test_owners(spark):
    docs = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "doc_id int, user_id int")
    users = spark.createDataFrame([(1, "ann")], "id int, username string")
    joined = lookup.documents_with_owner(docs, users)
    assert {r.doc_id: r.username for r in joined.collect()} == {1: "ann", 2: None, 3: None}
    assert [r.doc_id for r in lookup.owned_documents(docs, users).collect()] == [1]


def test_analyze(spark):
    docs = spark.createDataFrame(
        [(1, 10, "a.png", "Sex: M", ""), (2, 10, "b.png", "tax", "DOB: 1/2/1990")],
        "doc_id int, user_id int, filename string, raw_text string, corrected_text string")
    asked = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "doc_id int, user_id int")
    got = {(r.doc_id, r.user_id): r for r in extraction.analyze(asked, docs).collect()}
    assert got[1, 10].key_info.form_fill.gender == "M"
    assert got[2, 10].classification.type == "Identity Document"
    missing = got[2, 11]
    assert (missing.status, missing.filename, missing.classification, missing.key_info) == (404, None, None, None)


def test_history_of_all_users_restricted_to_one_is_its_history(spark, sf_dir):
    log = views.upload_log(spark, sf_dir)
    every = history.history_top_all(log, 5)
    for user in (3, 8):
        top = [r.doc_id for r in history.history_top(log, user, 5).collect()]
        ranked = every.filter(F.col("user_id") == user).orderBy("rank")
        assert [r.doc_id for r in ranked.collect()] == top
        assert [r.doc_id for r in history.history(log, user).limit(5).collect()] == top


def test_history_view(spark):
    log = spark.sql("""select 1 doc_id, 2 user_id, timestamp '2024-01-02 03:04:05' created_at, 'a.png' filename,
        '' language, cast(null as double) confidence""")
    assert tuple(history.history_view(log).first()) == (1, 2, "a.png", "–", "2024-01-02 03:04:05", "0.0%")
