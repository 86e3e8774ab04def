
import pytest

from quillstone.functions import keyinfo as k
from quillstone.operators.classification import classify
from quillstone.operators.extraction import autofill_form, autofill_json, extract_key_info, key_info_long


SHORT_CARD = (
    "GOVERNMENT OF INDIA\nAADHAAR\nName: Ramesh Kumar\nDOB: 15/08/1990\nGender: Male\n\n"
    "Address:\nFlat 402, Sunshine Apartments,\nMG Road, Bangalore,\nKarnataka 560001\n")
CARD = SHORT_CARD + "\n1234 5678 9012\nVID: 1234 5678 9012 3456\n"


@pytest.fixture(scope="module")
def info(spark):
    def run(text):
        df = spark.createDataFrame([(text,)], "text string")
        return extract_key_info(df).first()["key_info"].asDict(recursive=True)
    return run


def test_identity_card(info):
    got = info(CARD)
    assert got["form_fill"] == {
        "name": "Ramesh Kumar", "dob": "15/08/1990", "gender": "Male",
        "address": "Address: Flat 402, Sunshine Apartments, MG Road, Bangalore, Karnataka 560001"}
    assert got["dates"] == ["15/08/1990"]
    assert got["aadhaar_numbers"] == ["1234 5678 9012"]
    for absent in ("emails", "phone_numbers", "amounts", "pan_numbers", "percentages", "urls"):
        assert got[absent] is None
    assert info(SHORT_CARD)["aadhaar_numbers"] is None


def test_identity_card_class(spark):
    row = classify(spark.createDataFrame([(CARD,)], "text string")).first()["classification"]
    assert (row["type"], row["confidence"], row["scores"]) == (
        "Identity Document", 100.0, {"Identity Document": 100.0})


def test_nothing_found_is_null_and_form_is_empty_text(info):
    got = info("hello")
    assert got.pop("form_fill") == {"name": "", "dob": "", "address": "", "gender": ""}
    assert set(got.values()) == {None}


def test_dates_come_by_shape_then_position_and_are_capped(texts):
    text = "April 7, 2022 then 3 March 21 then 1/2/2020, 99/99/99 and 1/2/2020"
    assert texts(k.extract_dates, [text]) == [["1/2/2020", "99/99/99", "3 March 21", "April 7, 2022"]]
    many = " ".join(f"{d}/1/2020" for d in range(1, 9))
    assert texts(k.extract_dates, [many]) == [[f"{d}/1/2020" for d in range(1, 6)]]


def test_caps(texts):
    assert texts(k.extract_urls, ["www.a www.b www.c www.d"]) == [["www.a", "www.b", "www.c"]]
    pans = " ".join(f"ABCDE123{i}F" for i in range(8))
    assert texts(k.extract_pan, [pans]) == [pans.split()]


def test_amount_quirks(texts):
    got = texts(k.extract_amounts, ["Sunshine Towers, x", "a , inr b", "£5 ₹ 1,000.50 20 Rs."])
    assert got == [["rs,"], [", inr"], ["£5", "₹ 1,000.50", "20 Rs."]]


def test_phones_need_seven_digits(texts):
    got = texts(k.extract_phones, ["560001", "1234567", "+91 9876543210, 9876543210", "123456789012345"])
    assert got == [None, ["1234567"], ["+91 9876543210", "9876543210"], ["12345678", "9012345"]]


@pytest.mark.parametrize("text, name", [
    ("please send to the big house\nnow", "the big house"),
    ("Name:\nAsha Rao\nmore", "Asha Rao\nmore"[:8]),
    ("x GOVERNMENT OF INDIA\nAsha Rao\n1", "Asha Rao"),
    ("Nane: Ravi Das\n01/02/1990\n", "Ravi Das"),
    ("12 Road\n01/02/1990\nAl\n01/02/1990\nMina\n01/02/1990", "Mina"),
    ("01/02/1990\nMina", ""),
])
def test_name_tiers(info, text, name):
    assert info(text)["form_fill"]["name"] == name


@pytest.mark.parametrize("text, dob", [
    ("9/9/1999 DOB: 1/2/1990", "1/2/1990"), ("Date of Birth 03 Mar 1990", "03 Mar 1990"),
    ("9/9/1999 Year of Birth : 1947", "1947"), ("seen 9/9/1999", "9/9/1999"), ("none", ""),
])
def test_dob_tiers(info, text, dob):
    assert info(text)["form_fill"]["dob"] == dob


@pytest.mark.parametrize("text, gender", [
    ("Sex: F male", "F"), ("GENDER-transgender", "Transgender"), ("a FEMALE b", "Female"), ("males", ""),
])
def test_gender_tiers(info, text, gender):
    assert info(text)["form_fill"]["gender"] == gender


def test_address_tiers(info):
    assert info("s/o Ram,\n 12 Long Road, Pune 411 001 x")["form_fill"]["address"] == (
        "s/o Ram, 12 Long Road, Pune 411 001")
    assert info("!!Flat 9, Green Park, New Delhi 110016")["form_fill"]["address"] == (
        "Flat 9, Green Park, New Delhi 110016")
    assert info("short 110016")["form_fill"]["address"] == ""


def test_labelled_mobile(info):
    assert info("Mobile: 9876543210")["phone_numbers"] == ["9876543210"]
    assert info("Ph: 98-76-54-32")["phone_numbers"] == ["98-76-54-32"]
    six = " ".join(f"98765432{i}0" for i in range(5)) + " phone 98-76-54-32\n"
    assert len(info(six)["phone_numbers"]) == 6
    assert info("graph" + " " * 9 + "x")["phone_numbers"] == [""]


def test_tidy_form(spark):
    df = extract_key_info(spark.createDataFrame([(1, CARD)], "doc_id int, text string"))
    got = {(r.kind, r.ord): r.value for r in key_info_long(df, ["doc_id"]).collect()}
    assert got[("dates", 0)] == "15/08/1990" and got[("gender", 0)] == "Male"
    assert len(got) == 6


def test_autofill(spark):
    df = spark.createDataFrame([(1, SHORT_CARD), (2, "hello")], "doc_id int, text string")
    rows = {r.doc_id: r for r in autofill_json(autofill_form(extract_key_info(df))).collect()}
    assert rows[1].filled and not rows[2].filled
    na = "Not Available"
    assert rows[2].form_json == (
        f'{{"name":"{na}","dob":"{na}","gender":"{na}","phone":"{na}","email":"{na}","address":"{na}"}}')
    assert rows[1].form_json.startswith('{"name":"Ramesh Kumar","dob":"15/08/1990","gender":"Male","phone":"Not')
