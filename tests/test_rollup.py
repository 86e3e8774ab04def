from collections import Counter

import pytest

from quillstone.operators import repair, rollup
from quillstone.plans import views


def pages(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id int, page int, text string, confidence double, detected_language string")


def test_page_confidence(spark):
    words = spark.createDataFrame(
        [(1, 1, "-1"), (1, 1, "0"), (1, 1, "91"), (1, 1, "90.9"), (1, 2, "-1"), (2, 1, "33"), (2, 1, "34")],
        "doc_id int, page int, conf string")
    got = {(r.doc_id, r.page): r.confidence for r in rollup.page_confidence(words).collect()}
    assert got == {(1, 1): round(181 / 3, 2), (1, 2): 0.0, (2, 1): 33.5}


def test_snapshot_confidence_drops_zero_negative_and_fractional(spark):
    words = spark.createDataFrame(
        [(1, 1, "-1"), (1, 1, "0"), (1, 1, "91"), (1, 1, "90.9"), (1, 1, "92"), (1, 2, "0")],
        "doc_id int, page int, conf string")
    got = {(r.doc_id, r.page): r.confidence for r in rollup.snapshot_confidence(words).collect()}
    assert got == {(1, 1): 91.5, (1, 2): 0.0}


def test_confidence_is_unweighted_mean_of_pages(spark):
    got = rollup.document_confidence(pages(spark, [
        (1, 1, "a", 33.33, "en"), (1, 2, "b", 66.67, "en"), (1, 3, "c", 0.01, "en")])).first()
    assert got.confidence == pytest.approx(100.01 / 3)


def test_language_mode_ignores_unknown_and_ties_to_first_seen(spark):
    rows = [(1, 3, "hi"), (1, 1, "en"), (1, 2, "hi"), (1, 4, "en"), (1, 0, "unknown"), (2, 1, "unknown"),
            (3, 5, "fr"), (3, 6, "de"), (3, 7, "de")]
    got = rollup.document_language(pages(spark, [(d, p, "x", 0.0, lang) for d, p, lang in rows]))
    assert {r.doc_id: r.language for r in got.collect()} == {1: "en", 2: "unknown", 3: "de"}


def test_language_against_counter(spark, sf_dir):
    source = views.doc_pages(spark, sf_dir)
    seen = {}
    for r in source.orderBy("doc_id", "page").collect():
        langs = seen.setdefault(r.doc_id, [])
        if r.detected_language != "unknown":
            langs.append(r.detected_language)
    want = {d: Counter(v).most_common(1)[0][0] if v else "unknown" for d, v in seen.items()}
    assert {r.doc_id: r.language for r in rollup.document_language(source).collect()} == want


@pytest.mark.parametrize("block", [1, 2, 7, 256, None])
def test_text_is_independent_of_block_size(spark, block):
    values = ["", " \n", "b", "", "c\n", " d", "\x1c"]
    df = pages(spark, [(1, i, t, 0.0, "en") for i, t in enumerate(values)][::-1] + [(2, 0, " ", 0.0, "en")])
    got = {r.doc_id: r.text for r in rollup.document_text(df, block=block).collect()}
    assert got == {1: "\n\n".join(values).strip(), 2: ""}


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_parts_join_to_the_whole_text(spark, block):
    values = ["", " \n", " b", "", "c\n", "d ", "\x1c", " "]
    df = pages(spark, [(1, i, t, 0.0, "en") for i, t in enumerate(values)] + [(2, 0, " ", 0.0, "en")])
    parts = rollup.document_parts(df, block=block).orderBy("doc_id", "part").collect()
    assert {p.doc_id for p in parts} == {1}
    assert "\n\n".join(p.text for p in parts) == "\n\n".join(values).strip()


def test_multi_page_document_without_pages_is_an_error(spark):
    df = pages(spark, [(1, 1, "a", 50.0, "en"), (1, 2, " ", 25.5, "unknown")]).selectExpr(
        "doc_id", "page", "text AS raw_text", "upper(text) AS corrected_text", "confidence", "detected_language")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = {r.doc_id: (r.raw_text, r.corrected_text, r.confidence, r.language, r.error)
           for r in rollup.multi_page_document(df, docs).collect()}
    assert got == {1: ("a", "A", 37.75, "en", None), 2: (None, None, None, None, "PDF contains no pages")}


def test_first_page_and_best_candidate(spark):
    df = pages(spark, [(1, 2, "b", 1.0, "en"), (1, 1, "a", 2.0, "hi")])
    assert tuple(rollup.first_page(df).first()) == (1, 1, "a", 2.0, "hi")
    readings = spark.createDataFrame(
        [(1, 0, " ab "), (1, 1, "cd"), (2, 0, "a   "), (2, 1, "bc"), (3, 0, "\n"), (3, 1, "")],
        "doc_id int, pref int, text string")
    got = {r.doc_id: (r.pref, r.text) for r in rollup.best_candidate(readings).collect()}
    assert got == {1: (0, "ab"), 2: (1, "bc"), 3: (0, "")}


def test_lines_route_and_rejoin(spark):
    text = "hello\n\n \n1234 x\n12345678 a\n٣٤ab\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    lines = repair.route_lines(docs)
    assert [r.action for r in lines.orderBy("line_no").collect()] == [
        "correct", "keep", "keep", "keep", "keep", "keep", "keep"]
    assert repair.rejoin_lines(lines).first().text == text


def test_rejoin_is_the_inverse_of_routing(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    again = repair.rejoin_lines(repair.route_lines(docs))
    assert docs.exceptAll(again).isEmpty()
