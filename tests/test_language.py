import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import language, translation
from quillstone.plans import views


def test_grams_overlap_and_count_code_points(texts):
    assert texts(lambda c: language.grams(F.lower(c)), ["aBcd", "ab", "a😀b\nc", ""]) == [["abc", "bcd"], [], ["a😀b", "😀b\n", "b\nc"], []]


def test_slices_lose_no_gram(texts):
    value = "".join(chr(97 + i * i % 23) for i in range(997)) + "😀é"
    for size in (1, 2, 7, 996, 999, 5000):
        parts = texts(lambda c: language.slices(c, 3, size), [value])[0]
        grams = [part[i:i + 3] for part in parts for i in range(len(part) - 2)]
        assert sorted(grams) == sorted(value[i:i + 3] for i in range(len(value) - 2))


def test_profiles_keep_every_gram_of_labelled_text(spark):
    docs = spark.createDataFrame(
        [("en", "aaaa"), ("en", "abcabc"), ("de", "abc"), (None, "xyz"), ("fr", " \n\t  "), ("fr", None)],
        "lang string, text string")
    got = {(r.lang, r.gram): r.cnt for r in language.language_profiles(docs).collect()}
    assert got == {("en", "aaa"): 2, ("en", "abc"): 2, ("en", "bca"): 1, ("en", "cab"): 1, ("de", "abc"): 1}


def model(spark, path, rows):
    language.language_profiles(spark.createDataFrame(rows, "lang string, text string")).write.parquet(path)
    return spark.read.parquet(path)


def hashed(gram, buckets):
    h = 0
    for c in gram:
        h = (h * language.BASE + ord(c)) % language.PRIME
    return h % buckets


def test_buckets_of_code_points(texts):
    grams = ["abc", "é日😀", "   ", "\n\tz", "𐍈𐍈𐍈"]
    for buckets in (7, 1 << 15):
        assert texts(lambda c: language.bucket(c, 3, buckets), grams) == [hashed(g, buckets) for g in grams]


@pytest.mark.parametrize("n, buckets", [(3, 1 << 15), (3, 5), (1, 64), (4, 257)])
def test_scores_against_their_definition(spark, tmp_path, n, buckets):
    """Few buckets, so that n-grams collide; texts over several slices; repeated and NULL keys."""
    labelled = [("b", "the cat sat on the mat"), ("a", "der hund und die katze"), ("c", "le chat est sur le toit 日本語")]
    docs = [(1, "The mat"), (1, "der Hund"), (None, "LE CHAT"), (4, "日本語"), (5, ""), (6, None), (7, "ab"),
            (8, "the " * 40_000 + "katze"), (9, "zq"), (10, " \n")]
    path = str(tmp_path / f"p{n}-{buckets}")
    language.language_profiles(spark.createDataFrame(labelled, "lang string, text string"), n).write.parquet(path)
    counts = {lang: Counter(hashed(t[i:i + n], buckets) for i in range(len(t) - n + 1)) for lang, t in labelled}
    used = set().union(*counts.values())

    def expected(text):
        t = (text or "").lower()
        grams = [hashed(t[i:i + n], buckets) for i in range(len(t) - n + 1)] if t.strip() else []
        grams = [g for g in grams if g in used]
        score = {lang: sum(round(math.log((c[g] + 1) / (sum(c.values()) + len(used))) * language.SCALE) for g in grams)
                 for lang, c in counts.items()}
        return min(score, key=lambda x: (-score[x], x)) if grams else "unknown"

    found = language.detect_language(
        spark.createDataFrame(docs, "doc_id int, text string"), spark.read.parquet(path), n, buckets=buckets)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, expected(t)) for i, t in docs), key=key)


def test_no_row_per_gram_moves(spark, tmp_path, plan):
    """Scoring is narrow, and its plan does not grow with the labels."""
    sizes = []
    for labels in (2, 90):
        profiles = model(spark, str(tmp_path / f"plan{labels}"), [(f"l{i}", f"w{i:03}xyz") for i in range(labels)])
        text = plan(language.detect_language(spark.range(3).selectExpr("id AS doc_id", "'abc' AS text"), profiles))
        assert "Exchange" not in text and "Join" not in text and "Generate" not in text
        sizes.append(len(text.splitlines()))
    assert sizes[0] == sizes[1]


def test_three_hundred_labels(spark, tmp_path):
    profiles = model(spark, str(tmp_path / "many"), [(f"l{i:03}", f"q{i:03}x" * 3) for i in range(300)])
    docs = spark.createDataFrame([(i, f"q{i:03}x" * 3) for i in (8, 217, 299)], "doc_id int, text string")
    got = dict(language.detect_language(docs, profiles).collect())
    assert got == {8: "l008", 217: "l217", 299: "l299"}


def test_a_text_of_twenty_megabytes(spark, tmp_path):
    profiles = model(spark, str(tmp_path / "two"), [("x", "abcabd"), ("y", "mnomnp")])
    docs = spark.createDataFrame([(1, "abc"), (2, "mno ")], "doc_id int, text string").withColumn(
        "text", F.repeat("text", 5_000_000))
    assert dict(language.detect_language(docs, profiles).collect()) == {1: "x", 2: "y"}


def test_detection(spark, sf_dir, tmp_path):
    docs = views.documents(spark, sf_dir)
    path = str(tmp_path / "profiles")
    language.language_profiles(docs).write.parquet(path)
    profiles = spark.read.parquet(path)
    found = language.detect_language(docs, profiles)
    joined = docs.select("doc_id", "lang").join(found, "doc_id").collect()
    assert len(joined) == docs.count()
    assert sum(r.lang == r.detected_language for r in joined) / len(joined) > 0.95
    odd = spark.createDataFrame(
        [(1, ""), (2, " \n \n "), (3, None), (4, "☃☃☃☃"), (5, "ab")], "doc_id int, text string")
    assert {r.detected_language for r in language.detect_language(odd, profiles).collect()} == {"unknown"}


def test_translation_requests(spark):
    long = "é" * 4501
    docs = spark.createDataFrame(
        [(1, "hi", "x"), (2, "xx", long), (3, "hi", " \n"), (4, "hi", long[:4500])],
        "doc_id int, target string, text string")
    got = {r.doc_id: r for r in translation.translation_requests(docs).collect()}
    assert got[1].target_name == "Hindi" and got[1].supported and not got[1].truncated
    assert not got[2].supported and got[2].truncated and got[2].chunk == long[:4500]
    assert got[3].error == "No text to translate" and got[3].chunk is None and not got[3].truncated
    assert not got[4].truncated
