"""Java forms against Python's ``re``, the semantics the patterns are written for."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillstone.functions import keyinfo as k
from quillstone.functions import patterns as p
from quillstone.functions import text as tx
from quillstone.plans import views

PORTABLE = [
    n for n in dir(p)
    if isinstance(getattr(p, n), p.Pattern) and r"\z" not in getattr(p, n).text
    and n not in ("PIN_WITH_LEAD", "AMOUNT_FAST", "EMAIL_FAST")
]
TRICKY = [
    "é12/1/20 12/1/20é ²12/1/20", "12/12/2020\x1c13-1-99", "١٢/١/٢٠٢٠", "3 March 21",
    "Mär 5 2020 Mar 5,2020", "andré@x.com éx.y@z.org a@b.co_ .lead@x.yy", "+91 9876543210 (022) 1234567",
    "Towers, 5 INR,5 rs 1,2,3.45Rs $ ,", "ABCDE1234F éABCDE1234F ABCDE1234Fé", "1234 5678 9012 3456",
    "5% ²5% 7.5%", "HTTP://X.y/z\x1eq www.a'b", "to Bob Ray\nTo\n\n Al\n", "ſex: MALE Sex-f",
    "GOVERNMENT OF INDIA\n  Asha Rao \n", "Nane:- x", "dob 3/4/1990 Date of Birth: 03 Mar 90", "YOB 1947 yob:19471",
    "Address: twelve long chars 560001", "s/o Ram Lal, 12 Road, 560 001 x", "Ph:        \n", "mobile +91-98765 43210",
    "İnr 5 ıNR 6", "x" * 50 + " 560001",
]


def reference(pattern, text):
    flags = re.IGNORECASE if pattern.ignore_case else 0
    return [m.group(pattern.group) for m in re.finditer(pattern.text, text, flags)]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return [r[0] for r in views.corpus(spark, sf_dir).select("text").collect()] + TRICKY


@pytest.mark.parametrize("name", PORTABLE)
def test_java_form_matches_like_re(name, corpus, texts):
    pattern = getattr(p, name)
    got = texts(lambda T: F.regexp_extract_all(T, F.lit(pattern.java), pattern.group), corpus)
    for text, found in zip(corpus, got):
        assert found == reference(pattern, text), (name, text)


def test_word_class_equals_re_word(texts):
    old = unicodedata.ucd_3_2_0  # later additions depend on each side's Unicode version
    chars = [chr(c) for c in range(0x20, 0x3000) if old.category(chr(c)) != "Cn"]
    got = texts(lambda T: T.rlike(p.WORD), chars)
    differ = [hex(ord(c)) for c, w in zip(chars, got) if bool(re.match(r"\w", c)) != w]
    assert not differ


def random_texts(pieces, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_address_without_label_is_the_first_match(texts):
    pieces = ["560001", "12 Road, ", "a", "Z-9/", "!", "\n", "é", "123 456", "7", " x" * 12, "q" * 90, "1234567"]
    values = random_texts(pieces, 3000, 7)
    got = texts(k.form_address, values)
    for text, found in zip(values, got):
        m = re.search(p.ADDRESS_LABELLED.text, text, re.I) or re.search(p.ADDRESS_BEFORE_PIN.text, text)
        assert found == (re.sub(r"\s+", " ", m.group(1)).strip() if m else ""), text


@pytest.mark.parametrize("extract, name", [
    (k.extract_emails, "EMAIL"), (k.extract_amounts, "AMOUNT"), (k.extract_pan, "PAN"),
    (k.extract_aadhaar, "AADHAAR"), (k.extract_percentages, "PERCENTAGE"), (k.extract_urls, "URL"),
])
def test_guards_change_nothing(extract, name, texts):
    pieces = ["a@b.co", "@", "Rs", "rſ 5", " 5", ",", "İNR", "₹", "ABCDE1234F", "1234 5678 9012", "%", "3",
              ".", "http://", "ＷWW.", "www.x", "é", " ", "\n", "1.25", "$", "usd"]
    values = random_texts(pieces, 1500, 11)
    cap = {"AADHAAR": 2, "URL": 3, "PAN": None}.get(name, 5)
    for text, found in zip(values, texts(extract, values)):
        expected = list(dict.fromkeys(reference(getattr(p, name), text)))[:cap]
        assert found == (expected or None), text


FAST = ["AMOUNT", "EMAIL", "NAME_LABELLED", "DOB_LABELLED", "BIRTH_YEAR", "GENDER_LABELLED"]


@pytest.mark.parametrize("name", FAST)
def test_fast_forms_equal_re(name, corpus, texts):
    pieces = ["1", ",", "12,3", ".", ".5", "1.25", " ", "\n", "Rs", "rs.", "INR", "₹", "$", "a", "b.c", "@", "x@y.co", "-", "%",
              "_", "é", "²", "..", "Name", "to ", ":", "  \n", "dob", "sex", "F", "Male", "YOB", "1990", "3/4/90", "Asha Rao\n"]
    values = random_texts(pieces, 4000, 5) + corpus
    pattern, fast = getattr(p, name), getattr(p, f"{name}_FAST")
    got = texts(lambda T: F.regexp_extract_all(T, F.lit(fast.java), fast.group), values)
    for text, found in zip(values, got):
        assert found == reference(pattern, text), text


def test_degree_sign(texts):
    values = random_texts(["1", "٣", "°", " ", "x", "°°"], 2000, 3) + ["12°° 7° x°", "3°4°"]
    for text, found in zip(values, texts(tx.fix_ocr_artifacts, values)):
        assert found == re.sub(r"(\d+)°", r"\1th", text), text


RUNS = {
    "digits": "7" * 200_000, "list": "1," * 100_000, "dots": "x@ " + "a." * 100_000, "degrees": "5" * 100_000 + "°" * 100_000,
    "label": "Name" + " " * 200_000 + "!", "dob": "dob" + "\n" * 200_000 + "x 1", "mobile": "ph" + " -" * 100_000,
    "names": "x@" + "a" * 200_000, "at": "@a.b" * 50_000, "spaced": "1 " * 100_000, "address": "add" + " " * 200_000 + " 123456",
    "months": "1 jan" + "jan" * 60_000, "percent": "1." * 100_000 + "%",
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_long_runs_take_linear_time(name, spark):
    """Each of these took minutes or never ended when a pattern tried a run from each of its characters."""
    from quillstone.operators.extraction import extract_key_info

    start = time.perf_counter()
    df = spark.createDataFrame([(1, RUNS[name])], "doc_id int, text string")
    extract_key_info(df.withColumn("text", tx.corrected_text(F.col("text")))).collect()
    assert time.perf_counter() - start < 20
