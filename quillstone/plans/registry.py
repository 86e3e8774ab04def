"""Every operator as a named query over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import languages
from ..functions import keyinfo as k
from ..functions import text as tx
from ..operators import (
    classification, extraction, history, intake, language, lookup, repair, rollup, translation, upload,
)
from ..session import work_dir
from ..sources import readers, sinks
from ..streaming import enrich as streaming
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _long(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    staged = df.select(*keys, values.alias("_v"))
    return staged.select(*keys, F.posexplode("_v").alias("ord", "value"))


def _scores_text(c: str = "classification") -> Column:
    """The score map in dimension order, as text."""
    entries = F.transform(
        F.map_entries(f"{c}.scores"), lambda e: F.format_string("%s=%.1f", e["key"], e["value"]))
    return F.array_join(entries, ";")


# Sources and sinks


@query
def scan_documents(spark, sf_dir):
    return readers.documents(spark, f"{sf_dir}/documents.parquet")


@query
def intake_route(spark, sf_dir):
    return intake.intake_route(v.uploads(spark, sf_dir))


@query
def scan_text_files(spark, sf_dir):
    """Whole files of a bulk export, of a bounded number of documents each, taken apart again."""
    path = work_dir(spark, "txt")
    docs = v.documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("corrected_text"))
    sinks.export_txt_bulk(docs, path, 8, 1000)
    lines = readers.text_docs(spark, path).select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("value"))
    return sinks.bulk_lines(lines).select(
        "doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query
def camera_payload_decode(spark, sf_dir):
    decoded = intake.decode_payload(v.payloads(spark, sf_dir))
    return decoded.select(
        "id", "handwriting", "error", F.length("img_bytes").alias("n_bytes"),
        F.md5("img_bytes").alias("bytes_md5"))


@query
def export_txt(spark, sf_dir):
    path = work_dir(spark, "export-txt")
    sinks.export_txt_bulk(v.damaged_documents(spark, sf_dir), path)
    return sinks.read_bulk_txt(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query
def export_json(spark, sf_dir):
    path = work_dir(spark, "export-json")
    sinks.export_json(v.damaged_documents(spark, sf_dir), path)
    return spark.read.schema("filename string, text string").json(path)


@query
def export_name(spark, sf_dir):
    return sinks.export_name(v.export_names(spark, sf_dir), F.col("fmt"))


@query
def export_document(spark, sf_dir):
    formats = F.array(*map(F.lit, ("txt", "json", "odt")))
    asked = v.requests(spark, sf_dir).withColumn(
        "fmt", F.element_at(formats, (F.col("doc_id") % 3 + 1).cast("int")))
    return sinks.export_requested(asked, v.stored_forms(spark, sf_dir))


@query
def export_latin1_text(spark, sf_dir):
    docs = v.documents(spark, sf_dir)
    marked = F.regexp_replace("text", "e", "€")
    return docs.select("doc_id", tx.latin1_safe(marked).alias("safe_text"))


def _copies(stored: DataFrame, ids, **columns: Column) -> DataFrame:
    """Stored rows by file name, with more columns of each name's rows."""
    return stored.groupBy("filename").agg(
        F.lit(ids["all_ids"]).alias("all_ids"), F.lit(ids["last_id"]).alias("last_id"),
        F.count("*").alias("copies"), F.count_distinct("id").alias("ids"),
        F.count("created_at").alias("dated"), *[value.alias(c) for c, value in columns.items()],
        F.min("language").alias("language"), F.min("confidence").alias("confidence"),
        F.min("user_id").alias("user_id"))


@query
def append_documents(spark, sf_dir):
    """Digests stand for the texts of a file name; where its rows have unlike texts, the least is found among the texts."""
    path = work_dir(spark, "stored")
    rows = v.damaged_documents(spark, sf_dir)
    for batch in ("first", "second", "first"):  # the last changes nothing
        sinks.append_documents(rows, path, batch)
    stored = readers.stored_documents(spark, path)
    ids = stored.agg(F.count_distinct("id").alias("all_ids"), F.max("id").alias("last_id")).first()
    raw, corrected = "raw_text", "corrected_text"
    digests = stored.withColumns({c: F.md5(c) for c in (raw, corrected)})
    unlike = (F.min(raw) != F.max(raw)) | (F.min(corrected) != F.max(corrected))
    files = _copies(digests, ids, raw_md5=F.min(raw), corrected_md5=F.min(corrected), unlike=unlike)
    # written, so that the planner knows how few names have unlike texts
    by_name, names = work_dir(spark, "stored-files"), work_dir(spark, "stored-names")
    files.write.parquet(by_name)
    files = spark.read.schema(files.schema).parquet(by_name)
    files.filter("unlike").select(F.col("filename").alias("_name")).write.parquet(names)
    named = spark.read.schema("_name string").parquet(names)
    texts = stored.join(named, F.col("filename").eqNullSafe(F.col("_name")), "left_semi")
    exact = _copies(texts, ids, raw_md5=F.md5(F.min(raw)), corrected_md5=F.md5(F.min(corrected)))
    return files.filter("NOT unlike").select(exact.columns).union(exact)


@query
def image_catalog(spark, sf_dir):
    return intake.plan_images(readers.sized_images(v.images(spark, sf_dir)))


# Projections, filters, predicates


@query
def effective_text(spark, sf_dir):
    chosen = tx.effective_text(F.col("corrected_text"), F.col("raw_text"))
    return v.damaged_documents(spark, sf_dir).select("doc_id", chosen.alias("text"))


@query
def is_blank(spark, sf_dir):
    return v.corpus(spark, sf_dir).select("src", "doc_id", tx.is_blank(F.col("text")).alias("blank"))


@query
def find_document(spark, sf_dir):
    docs = v.forms(spark, sf_dir).select("doc_id", "user_id", "filename")
    return lookup.find_documents(v.requests(spark, sf_dir), docs)


@query
def confidence_band(spark, sf_dir):
    pages = rollup.page_confidence(v.words(spark, sf_dir))
    doubled = F.when(F.col("page") != 2, F.col("confidence") * 2)
    return pages.select(
        "doc_id", "page", tx.confidence_band(doubled).alias("band"),
        tx.one_decimal(F.coalesce(doubled, F.lit(0.0))).alias("shown"))


@query
def ocr_language_arg(spark, sf_dir):
    key = F.col("doc_id")
    codes = F.array(*map(F.lit, ("eng", "hin", "guj", "tel", "tam")))
    lang = F.when(key % 6 < 5, F.try_element_at(codes, (key % 6 + 1).cast("int"))).otherwise(F.col("lang"))
    docs = v.table(spark, sf_dir, "documents").select(
        "doc_id", lang.alias("code"),
        F.when(key % 2 == 0, "pdf").otherwise("image").alias("route"),
        F.when(key % 4 < 2, "upload").otherwise("upload-id").alias("endpoint"))
    return docs.withColumn(
        "ocr_lang", intake.ocr_language(F.col("code"), F.col("route"), F.col("endpoint")))


@query
def display_defaults(spark, sf_dir):
    shown = intake.with_display_defaults(v.damaged_documents(spark, sf_dir))
    return shown.select("doc_id", "raw_text", "corrected_text", "language")


@query
def autofill_form(spark, sf_dir):
    filled = extraction.autofill_form(extraction.extract_key_info(v.forms(spark, sf_dir)))
    return filled.select(
        "doc_id", "filled", *[f"fill_{f}" for f in ("name", "dob", "gender", "phone", "email", "address")])


@query
def autofill_json(spark, sf_dir):
    filled = extraction.autofill_form(extraction.extract_key_info(v.forms(spark, sf_dir)))
    return extraction.autofill_json(filled).select("doc_id", "form_json")


@query
def supported_languages(spark, sf_dir):
    used = v.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(
        F.count("*").alias("n"))
    return languages(spark).join(used, "code", "left").select(
        "name", "code", F.coalesce("n", F.lit(0)).alias("n_docs"))


# Text repair


def _repaired(spark, sf_dir, repair_column: Callable[[Column], Column]) -> DataFrame:
    return v.corpus(spark, sf_dir).select(
        "src", "doc_id", F.md5(repair_column(F.col("text"))).alias("text_md5"))


@query
def fix_ocr_artifacts(spark, sf_dir):
    return _repaired(spark, sf_dir, tx.fix_ocr_artifacts)


@query
def document_specific_fix(spark, sf_dir):
    return _repaired(spark, sf_dir, tx.document_specific_fix)


@query
def corrected_text(spark, sf_dir):
    return _repaired(spark, sf_dir, tx.corrected_text)


@query
def route_lines(spark, sf_dir):
    return repair.route_lines(v.documents(spark, sf_dir))


@query
def rejoin_lines(spark, sf_dir):
    return repair.rejoin_lines(repair.route_lines(v.documents(spark, sf_dir)))


# Classification


@query
def keyword_hits(spark, sf_dir):
    return classification.keyword_hits(v.documents(spark, sf_dir))


@query
def type_scores(spark, sf_dir):
    return classification.type_scores(v.documents(spark, sf_dir))


@query
def classify(spark, sf_dir):
    done = classification.classify(v.corpus(spark, sf_dir))
    return done.select(
        "src", "doc_id", "classification.type", "classification.icon",
        "classification.confidence", _scores_text().alias("scores"))


@query
def classify_relational(spark, sf_dir):
    return classification.classify_relational(v.forms(spark, sf_dir))


@query
def display_classification(spark, sf_dir):
    done = classification.display_classification(classification.classify(v.corpus(spark, sf_dir)))
    return done.select("src", "doc_id", "display")


# Key information


def _register_list(name: str, extractor: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        return _long(v.corpus(spark, sf_dir), ["src", "doc_id"], extractor(F.col("text")))
    QUERIES[name] = run


for _name in ("extract_dates", "extract_emails", "extract_phones", "extract_amounts",
              "extract_pan", "extract_aadhaar", "extract_percentages", "extract_urls"):
    _register_list(_name, getattr(k, _name))


def _register_form_field(field: str) -> None:
    def run(spark, sf_dir):
        done = extraction.extract_key_info(v.corpus(spark, sf_dir))
        return done.select("src", "doc_id", F.col(f"key_info.form_fill.{field}").alias(field))
    QUERIES[f"form_{field}"] = run


for _name in ("name", "dob", "gender", "address"):
    _register_form_field(_name)


@query
def labelled_mobile(spark, sf_dir):
    staged = v.corpus(spark, sf_dir).withColumns({
        "listed": k.extract_phones(F.col("text")), "mobile": k.labelled_mobile(F.col("text"))})
    numbers = k.with_labelled_mobile(F.col("listed"), F.col("mobile"))
    return _long(staged, ["src", "doc_id"], numbers)


@query
def extract_key_info(spark, sf_dir):
    info = extraction.extract_key_info(v.corpus(spark, sf_dir))
    lists = [F.array_join(f"key_info.{f}", "|").alias(f) for f in extraction.LIST_FIELDS]
    return info.select("src", "doc_id", *lists, "key_info.form_fill.*")


@query
def key_info_long(spark, sf_dir):
    info = extraction.extract_key_info(v.corpus(spark, sf_dir))
    return extraction.key_info_long(info, ["src", "doc_id"])


@query
def analyze(spark, sf_dir):
    done = extraction.analyze(v.requests(spark, sf_dir), v.stored_forms(spark, sf_dir))
    lists = [F.array_join(f"key_info.{f}", "|").alias(f) for f in extraction.LIST_FIELDS]
    return done.select(
        "doc_id", "user_id", "status", "filename", "classification.type",
        "classification.confidence", *lists, "key_info.form_fill.*")


# Roll-ups


@query
def page_confidence(spark, sf_dir):
    return rollup.page_confidence(v.words(spark, sf_dir))


@query
def snapshot_confidence(spark, sf_dir):
    return rollup.snapshot_confidence(v.words(spark, sf_dir))


@query
def document_text(spark, sf_dir):
    return rollup.document_text(v.doc_pages(spark, sf_dir))


@query
def document_parts(spark, sf_dir):
    return rollup.document_parts(v.doc_pages(spark, sf_dir), block=3)


@query
def document_confidence(spark, sf_dir):
    return rollup.document_confidence(rollup.page_confidence(v.words(spark, sf_dir)))


@query
def document_language(spark, sf_dir):
    return rollup.document_language(v.doc_pages(spark, sf_dir))


@query
def multi_page_document(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).withColumnRenamed("text", "raw_text")
    pages = repair.correct_text(pages, "raw_text")
    docs = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return rollup.multi_page_document(pages, docs)


@query
def first_page(spark, sf_dir):
    return rollup.first_page(v.doc_pages(spark, sf_dir))


@query
def best_candidate(spark, sf_dir):
    return rollup.best_candidate(v.readings(spark, sf_dir))


# Users and history


@query
def register_users(spark, sf_dir):
    return lookup.register_users(v.user_requests(spark, sf_dir), v.users(spark, sf_dir))


@query
def insert_users(spark, sf_dir):
    path = work_dir(spark, "users")
    v.users(spark, sf_dir).select("id", "username").write.parquet(path)
    asked = v.user_requests(spark, sf_dir)
    first = lookup.insert_users(asked, path, "first").filter("status = 200").count()
    again = lookup.insert_users(asked, path, "second").filter("status = 200").count()
    stored = lookup.stored_users(spark, path)
    ids = stored.agg(F.count_distinct("id")).first()[0]
    return stored.groupBy("username").agg(
        F.count("*").alias("copies"), F.lit(ids).cast("bigint").alias("all_ids"),
        F.lit(first).cast("bigint").alias("first_accepted"), F.lit(again).cast("bigint").alias("second_accepted"))


@query
def documents_with_owner(spark, sf_dir):
    return lookup.documents_with_owner(v.order_documents(spark, sf_dir), v.users(spark, sf_dir))


@query
def owned_documents(spark, sf_dir):
    return lookup.owned_documents(v.order_documents(spark, sf_dir), v.users(spark, sf_dir))


SHOWN_USER = 8


def _history(spark, sf_dir):
    return history.history(v.upload_log(spark, sf_dir), SHOWN_USER)


QUERIES["history"] = _history


@query
def history_top30(spark, sf_dir):
    return history.history_top(v.upload_log(spark, sf_dir), SHOWN_USER)


@query
def history_top30_all(spark, sf_dir):
    return history.history_top_all(v.upload_log(spark, sf_dir)).select("user_id", "rank", "doc_id")


@query
def history_view(spark, sf_dir):
    return history.history_view(v.upload_log(spark, sf_dir))


# Language and translation


@query
def language_profiles(spark, sf_dir):
    return language.language_profiles(v.documents(spark, sf_dir))


@query
def detect_language(spark, sf_dir):
    docs = v.documents(spark, sf_dir)
    path = work_dir(spark, "profiles")
    language.language_profiles(docs).write.parquet(path)
    profiles = spark.read.schema("lang string, gram string, cnt bigint").parquet(path)
    return language.detect_language(docs, profiles)


@query
def translation_requests(spark, sf_dir):
    codes = F.array(*map(F.lit, ("hi", "zh-CN", "xx")))
    target = F.element_at(codes, (F.col("doc_id") % 3 + 1).cast("int"))
    texts = v.corpus(spark, sf_dir).withColumn("target", target)
    prepared = translation.translation_requests(texts)
    return prepared.select(
        "src", "doc_id", "target", "target_name", "supported", "truncated", "error",
        F.length("chunk").alias("chunk_chars"), F.md5("chunk").alias("chunk_md5"))


@query
def translation_parts(spark, sf_dir):
    parts = translation.translation_parts(v.corpus(spark, sf_dir).withColumn("_k", F.struct("src", "doc_id")), "_k")
    return parts.select("_k.src", "_k.doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query
def translate_document(spark, sf_dir):
    asked = v.requests(spark, sf_dir).withColumn(
        "target", F.when(F.col("doc_id") % 2 == 0, "ta").otherwise("xx"))
    return translation.translate_requested(asked, v.stored_forms(spark, sf_dir))


# Uploads, in batch and streaming


def _upload_rows(rows: DataFrame) -> DataFrame:
    lists = [F.array_join(f"key_info.{f}", "|").alias(f) for f in extraction.LIST_FIELDS]
    return rows.select(
        "doc_id", "user_id", "filename", "reject_reason", F.md5("raw_text").alias("raw_md5"),
        F.md5("corrected_text").alias("corrected_md5"), "language", F.col("confidence").alias("score"),
        "classification.type", "classification.confidence", *lists, "key_info.form_fill.*")


def _stored_rows(stored: DataFrame) -> DataFrame:
    ids = stored.agg(F.count_distinct("id").alias("all_ids"), F.max("id").alias("last_id"),
                     F.count("created_at").alias("dated")).first()
    return stored.select(
        *[F.lit(ids[c]).alias(c) for c in ("all_ids", "last_id", "dated")], "filename", "user_id",
        F.md5("raw_text").alias("raw_md5"), F.md5("corrected_text").alias("corrected_md5"), "language",
        F.col("confidence").alias("score"))


@query
def stream_enrich(spark, sf_dir):
    out, checkpoint = work_dir(spark, "stream-out"), work_dir(spark, "stream-checkpoint")
    uploads = v.text_uploads(v.arriving_documents(spark, sf_dir))
    streaming.stream_enrich(uploads, out, checkpoint).awaitTermination()
    return _upload_rows(spark.read.schema(upload.enrich_uploads(uploads).schema).parquet(out))


@query
def stream_store(spark, sf_dir):
    """The stream twice over the same uploads, the second time as after a lost checkpoint: each row is stored once."""
    path = work_dir(spark, "stream-stored")
    for _ in range(2):
        uploads = v.text_uploads(v.arriving_documents(spark, sf_dir))
        streaming.stream_store(uploads, path, work_dir(spark, "stream-checkpoint")).awaitTermination()
    return _stored_rows(readers.stored_documents(spark, path))


@query
def enrich_uploads(spark, sf_dir):
    return _upload_rows(upload.enrich_uploads(v.text_uploads(v.documents(spark, sf_dir))))


@query
def camera_results(spark, sf_dir):
    return upload.camera_results(v.readings(spark, sf_dir), v.words(spark, sf_dir))


@query
def process_uploads(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).withColumnRenamed("text", "raw_text")
    return _upload_rows(upload.process_uploads(v.paged_files(spark, sf_dir), pages))


@query
def process_id_uploads(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).withColumnRenamed("text", "raw_text")
    return _upload_rows(upload.process_uploads(v.paged_files(spark, sf_dir), pages, first_only=True))


@query
def store_uploads(spark, sf_dir):
    """The same batch of uploads sent twice: its accepted rows are stored once."""
    path = work_dir(spark, "uploads-stored")
    pages = v.doc_pages(spark, sf_dir).withColumnRenamed("text", "raw_text")
    for _ in range(2):
        sinks.store_uploads(v.paged_files(spark, sf_dir), pages, path, "batch")
    return _stored_rows(readers.stored_documents(spark, path))
