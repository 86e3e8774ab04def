import os
import random

from pyspark.sql import functions as F

from quillstone.functions import text as tx


SAMPLES = ["", " ", "a", " a b ", " x　", "\x1c\x1dy\x1f", "\n\x0c", "​", "tab\t", None]


def test_strip_and_blank_follow_unicode_whitespace(texts):
    assert texts(tx.strip, SAMPLES) == [None if s is None else s.strip() for s in SAMPLES]
    assert texts(tx.is_blank, SAMPLES) == [not s or not s.strip() for s in SAMPLES]


def test_squeeze(texts):
    assert texts(tx.squeeze, ["  a \n\n b \x1cc "]) == ["a b c"]


def test_ocr_artifacts(texts):
    cases = {
        "£5": "₹5", "12° and 3 °": "12th and 3 °", "٣°": "٣th",
        "wi|l ab|cd|ef c|a|m": "will ablcdlef clalm", "SCH!OL A|B|C": "SCHIOL AIBIC",
        "a|B A!b 1|2": "a|B A!b 1|2", "é|a": "é|a",
    }
    assert texts(tx.fix_ocr_artifacts, list(cases)) == list(cases.values())


def test_specific_fix_every_occurrence(texts):
    assert texts(tx.document_specific_fix, ["Principat, Principat principat"]) == [
        "Principal, Principal principat"]


def test_latin1(texts):
    values = ["aé₹b😀", "ÿĀ"]
    assert texts(tx.latin1_safe, values) == [
        v.encode("latin-1", "replace").decode("latin-1") for v in values]


def test_rounding_is_half_even_on_binary_values(texts):
    rng = random.Random(1)
    values = [2.675, 0.125, 1.005, 1.115, 0.285, 0.0] + [
        rng.randint(0, 5000) / rng.randint(1, 60) for _ in range(500)]
    for places in (1, 2):
        got = texts(lambda T: tx.round_half_even(T.cast("double"), places), [repr(v) for v in values])
        assert got == [round(v, places) for v in values]


def test_one_decimal_ties_go_up(texts):
    got = texts(lambda T: tx.one_decimal(T.cast("double")), ["6.25", "6.55", "6.75", "0", "1234.5", "99.95"])
    assert got == ["6.3", "6.5", "6.8", "0.0", "1234.5", "100.0"]


def test_confidence_band(texts):
    got = texts(lambda T: tx.confidence_band(T.cast("double")), ["70", "70.1", "40", "40.1", None])
    assert got == ["yellow", "green", "red", "yellow", "red"]


def test_export_base_name(texts):
    names = ["a.txt", "a", ".hidden", ".h.txt", "a.tar.gz", "a.", "..a.b", "x.y/z", "x.y/.z", "x/..z.q", "..."]
    assert texts(tx.export_base_name, names) == [os.path.splitext(n)[0] for n in names]


def test_effective_text(spark):
    df = spark.createDataFrame([("c", "r"), ("", "r"), (None, "r"), (None, None), ("", "")], "c string, r string")
    got = [r[0] for r in df.select(tx.effective_text(F.col("c"), F.col("r"))).collect()]
    assert got == ["c", "r", "r", "", ""]


def test_let_computes_once(spark):
    got = spark.range(20).select(tx.let(F.rand(), lambda v: v - v).alias("d")).distinct().collect()
    assert [r[0] for r in got] == [0.0]
