from pyspark.sql import functions as F

from quillstone.dims import DOC_TYPES
from quillstone.operators import classification as c
from quillstone.plans import views


def docs(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def by_id(df, column):
    return [r[column] for r in df.orderBy("doc_id").collect()]


def test_dimension():
    assert [len(k) for _, _, k in DOC_TYPES] == [16, 11, 11, 12, 15, 16, 15, 10, 12]


def test_blank_and_unmatched(spark):
    got = by_id(c.classify(docs(spark, "", " \n", None, "hello")), "classification")
    assert [(g.type, g.icon, g.confidence, g.scores) for g in got] == [
        ("Unknown", "📃", 0.0, {})] * 3 + [("General Document", "📃", 0.0, {})]


def test_substring_hits_count_once_and_ties_go_to_the_earlier_type(spark):
    got = by_id(c.classify(docs(
        spark, "TAX tax taxi", "transaction", "dear sincerely regards bank debit credit",
        "aadhaar", "aadhar")), "classification")
    assert [(g.type, g.confidence) for g in got] == [
        ("Invoice", 33.3), ("Receipt", 33.3), ("Business Letter", 100.0),
        ("General Document", 0.0), ("Identity Document", 33.3)]
    assert got[1].scores == {"Receipt": 33.3, "Bank Statement": 33.3}


def test_narrow_and_relational_forms_agree(spark, sf_dir):
    for source in (views.forms(spark, sf_dir), views.documents(spark, sf_dir)):
        narrow = c.classify(source).select(
            "doc_id", "classification.type", "classification.icon", "classification.confidence")
        relational = c.classify_relational(source)
        assert narrow.exceptAll(relational).isEmpty() and relational.exceptAll(narrow).isEmpty()


def test_scores_equal_brute_force(spark, sf_dir):
    source = views.forms(spark, sf_dir).select("doc_id", "text")
    texts = {r.doc_id: r.text.lower() for r in source.collect()}
    got = {(r.doc_id, r.type): r.matched for r in c.type_scores(source).collect()}
    want = {}
    for doc_id, low in texts.items():
        for name, _, keywords in DOC_TYPES:
            n = len([k for k in keywords if k in low])
            if n:
                want[doc_id, name] = n
    assert got == want


def test_display(spark):
    shown = by_id(c.display_classification(c.classify(docs(spark, "", "hello", "tax gst", None))), "display")
    none = "Could not classify document."
    assert shown == [none, "📃 General Document 0%", "🧾 Invoice 67%", none]


def test_missing_classification_displays_as_unclassified(spark):
    df = spark.range(1).select(F.lit(None).cast("struct<type:string,icon:string,confidence:double>").alias("classification"))
    assert c.display_classification(df).first().display == "Could not classify document."
