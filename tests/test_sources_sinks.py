import base64
import hashlib
import json
import os
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.operators import intake
from quillstone.operators.upload import enrich_uploads
from quillstone.plans import registry, views
from quillstone.session import spread, work_dir
from quillstone.sources import readers, sinks
from quillstone.streaming import enrich as streaming


def png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = (b"\0" + b"\0" * ((width + 7) // 8)) * height
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("decode", [False, True])
def test_image_catalog(spark, tmp_path, decode):
    for name, data in {"a.png": png(3000, 1001), "b.png": png(40, 20), "c.png": b"no image"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[-1]: (r.width, r.height, r.ok, r.target_w, r.target_h)
           for r in readers.image_catalog(spark, str(tmp_path), decode=decode).collect()}
    scale = 2000 / 3000
    assert got == {
        "a.png": (3000, 1001, True, int(3000 * scale), int(1001 * scale)),
        "b.png": (40, 20, True, 40, 20), "c.png": (-1, -1, False, None, None)}


def test_header_sizes(spark):
    def segment(code, body):
        return b"\xff" + bytes([code]) + struct.pack(">H", len(body) + 2) + body

    frame = b"\x08" + struct.pack(">HH", 77, 5000) + b"\x03"
    cases = {
        "many segments": b"\xff\xd8" + segment(0xE1, b"x") * 2000 + segment(0xC0, frame),
        "fill bytes": b"\xff\xd8" + b"\xff" * 3 + segment(0xE0, b"JFIF") + b"\xff" * 900 + segment(0xC1, frame),
        "fill to the end": b"\xff\xd8" + b"\xff" * 1000, "empty segment": b"\xff\xd8\xff\xe0\0\0" * 700,
        "baseline": b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xC0, frame),
        "progressive": b"\xff\xd8" + segment(0xE2, b"x" * 60_000) * 40 + segment(0xC4, b"\xff\xc0") + segment(0xC2, frame),
        "no frame": b"\xff\xd8" + segment(0xE0, b"JFIF"), "cut": b"\xff\xd8\xff", "cut png": png(5, 5)[:18],
        "empty": b"", "none": None}
    files = spark.createDataFrame(list(cases.items()), "path string, content binary")
    got = {r.file: (r.height, r.width) for r in readers.sized_images(files).collect()}
    assert got == {k: (77, 5000) if k in ("baseline", "progressive", "many segments", "fill bytes") else (-1, -1) for k in cases}


def test_upload_folder(spark, tmp_path):
    for name in ("a.PDF", "b.jpeg", "c.txt", "d.Png"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r.filename: (r.length, r.route) for r in intake.intake_route(readers.uploads(spark, str(tmp_path))).collect()}
    assert got == {"a.PDF": (5, "pdf"), "b.jpeg": (5, "image"), "d.Png": (5, "image")}


def test_intake_limits(spark):
    files = spark.createDataFrame([("", 1), ("a.pdf", 10485760), ("b.png", 10485761), (None, 1)],
                                  "filename string, length bigint")
    got = [(r.accepted, r.reject_reason) for r in intake.intake_route(files).collect()]
    assert got == [(False, "No selected file"), (True, None), (False, "File too large (max 10MB)"),
                   (False, "No selected file")]


def test_payloads(spark):
    body = base64.b64encode(b"a,b\x00").decode()
    rows = [
        json.dumps({"image": f"data:image/jpeg;base64,{body}", "handwriting": True}), json.dumps({"image": body}),
        json.dumps({"image": ""}), json.dumps({}), json.dumps({"image": "abc"}), "not json",
        json.dumps({"image": f"x,{body[:4]}\n{body[4:]}"}), json.dumps({"image": None}), json.dumps({"image": "x,"}),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, payload string")
    got = [(bytes(r.img_bytes) if r.img_bytes is not None else None, r.handwriting, r.error)
           for r in intake.decode_payload(df).orderBy("i").collect()]
    missing, bad = "No image data provided", "Invalid base64 image data"
    assert got == [
        (b"a,b\x00", True, None), (b"a,b\x00", False, None), (None, False, missing), (None, False, missing),
        (None, False, bad), (None, False, missing), (b"a,b\x00", False, None), (None, False, missing), (b"", False, None)]


def test_ocr_language(spark):
    rows = [("hin", "pdf", "upload"), ("hin", "pdf", "upload-id"), ("tam", "image", "upload"), ("eng", "image", "upload")]
    df = spark.createDataFrame(rows, "lang string, route string, endpoint string")
    got = [r[0] for r in df.select(intake.ocr_language(F.col("lang"), F.col("route"), F.col("endpoint"))).collect()]
    assert got == ["hin", "hin+eng", "tam+eng", "eng"]


def stored(spark):
    return spark.createDataFrame(
        [(1, "a.png", "raw é\nline", "", None, None, 5), (2, "b.pdf", None, None, "en", 7.5, None),
         (3, "a.png", "r", "c\n\n", "en", 1.0, 5)],
        "doc_id int, filename string, raw_text string, corrected_text string, language string, "
        "confidence double, user_id int")


def test_text_export_round_trip(spark):
    path = work_dir(spark, "t")
    sinks.export_txt(stored(spark), path)
    got = {r.doc_id: r.text for r in sinks.read_exported_txt(spark, path).collect()}
    assert got == {1: "raw é\nline", 2: "", 3: "c\n\n"}
    assert {r.text for r in readers.text_docs(spark, path).collect()} == {"raw é\nline\n", "\n", "c\n\n\n"}


def test_json_export_round_trip(spark):
    path = work_dir(spark, "j")
    sinks.export_json(stored(spark), path)
    got = sorted(tuple(r) for r in spark.read.schema("filename string, text string").json(path).collect())
    assert got == [("a.png", "c\n\n"), ("a.png", "raw é\nline"), ("b.pdf", "")]


def test_export_name(spark):
    df = spark.createDataFrame([("a.b.png",)], "filename string")
    assert sinks.export_name(df, "pdf").first().export_name == "a.b.pdf"
    bad = sinks.export_name(df, "xls").first()
    assert (bad.export_name, bad.error) == (None, "Invalid format type")


def test_append_twice(spark):
    path = work_dir(spark, "a")
    for _ in range(2):
        sinks.append_documents(stored(spark), path)
    rows = readers.stored_documents(spark, path).collect()
    assert len({r.id for r in rows}) == len(rows) == 6
    row = next(r for r in rows if r.filename == "b.pdf")
    assert (row.raw_text, row.corrected_text, row.language, row.confidence) == ("", "", "en", 7.5)
    assert all(r.created_at for r in rows)
    assert {r.language for r in rows if r.filename == "a.png"} == {"unknown", "en"}


def test_stream_equals_batch_across_restarts(spark, sf_dir):
    source, out, checkpoint = (work_dir(spark, n) for n in ("src", "out", "cp"))
    docs = readers.documents(spark, f"{sf_dir}/documents.parquet")
    halves = docs.randomSplit([0.5, 0.5], seed=1)
    for half in halves:
        half.repartition(3).write.mode("append").parquet(source)
        arriving = views.text_uploads(streaming.read_stream(spark, source, readers.TEXT_DOCUMENT, max_files=2))
        streaming.stream_enrich(arriving, out, checkpoint).awaitTermination()
    columns = ["doc_id", "reject_reason", "corrected_text", "language", "classification.type", "key_info"]
    got = spark.read.parquet(out).select(*columns)
    want = enrich_uploads(views.text_uploads(docs)).select(*columns)
    assert got.filter("reject_reason is not null").count() > 0
    assert got.count() == docs.count()
    assert got.exceptAll(want).isEmpty()


def appended(spark, folder, docs):
    """``append_documents`` over documents of ``doc_id, text``."""
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr(
        "*", "'en' AS lang", "'web' AS source", "12L AS n_chars")
    table.repartition(3).write.parquet(str(folder / "documents.parquet"))
    return registry.QUERIES["append_documents"](spark, str(folder))


def test_equal_texts_of_a_file_name_do_not_move(spark, tmp_path, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # less than the table of all names has
    try:
        df = appended(spark, tmp_path, [(i, f"text {i} ée") for i in range(300)] + [(3, "text 3 ée")])
        assert {r.filename: r.copies for r in df.collect()} == {f"doc.{i}.png": 4 if i == 3 else 2 for i in range(300)}
        ran, planned = plan(df).split("== Initial Plan ==")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "raw_md5" in ran and "raw_text" not in ran and "corrected_text" not in ran
    assert "SortMergeJoin" not in planned  # it would shuffle all texts before it sees that no name is asked for


def test_unlike_texts_of_a_file_name_give_the_least(spark, tmp_path):
    long = "x" * 5000
    docs = [(2, "b"), (2, "é"), (2, "a"), (3, long + "2"), (3, long + "1"), (7, "q"), (7, "e"), (10, None), (10, "z"),
            (11, "one"), (None, "k"), (None, "j"), (12, None), (13, "e"), (13, "E")]
    got = {r.filename: r for r in appended(spark, tmp_path, docs).collect()}
    want = {}
    for key, text in docs:
        raw = text if key is not None and key % 7 else None  # a missing id is in no class and has no texts
        corrected = text if key is not None and key % 4 > 1 else None
        texts = (raw or "").encode(), (corrected or "").replace("e", "E").encode()
        want.setdefault(None if key is None else f"doc.{key}.png", []).append(texts)
    assert set(got) == set(want)
    for name, texts in want.items():
        row, (raw, corrected) = got[name], (min(column) for column in zip(*texts, strict=True))
        assert (row.raw_md5, row.corrected_md5) == (hashlib.md5(raw).hexdigest(), hashlib.md5(corrected).hexdigest()), name
        assert row.copies == row.ids == row.dated == 2 * len(texts)
        assert row.all_ids == row.last_id == 2 * len(docs)


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("n", [0, 40])
def test_streams_read_a_table_of_one_file_or_a_folder_of_files(spark, tmp_path, files, n):
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "concat('INVOICE NO ', id) AS text", "'en' AS lang", "'web' AS source", "12L AS n_chars")
    table = str(tmp_path / "documents.parquet")
    if files == 1:
        pq.write_table(docs.toArrow(), table)
    else:
        docs.repartition(files).write.parquet(table)
        os.mkdir(tmp_path / "old")  # a table of that name elsewhere is another table
        docs.write.parquet(str(tmp_path / "old" / "documents.parquet"))
    got = registry.QUERIES["stream_enrich"](spark, str(tmp_path))
    want = registry.QUERIES["enrich_uploads"](spark, str(tmp_path))
    assert got.columns == want.columns
    assert got.count() == want.count() == n and got.exceptAll(want).isEmpty()
    assert registry.QUERIES["stream_store"](spark, str(tmp_path)).count() == want.filter("reject_reason is null").count()


def test_spread_is_the_callers_choice(spark, plan):
    table = spark.range(10)
    assert "Exchange" not in plan(spread(table, "id"))
    spark.conf.set("spark.quillstone.spread", "3")
    try:
        assert spread(table, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.quillstone.spread")


def test_work_dir_is_the_shared_folder(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
