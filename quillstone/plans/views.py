"""Input views derived from the supplied tables, all of each table every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.readers import TEXT_DOCUMENT
from ..streaming.enrich import read_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` spread over the cores where the file is too small to be."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def arriving_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a stream, whether the table is a file or a folder of files."""
    return spread(read_stream(spark, f"{sf_dir}/documents.parquet", TEXT_DOCUMENT), "doc_id")


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds of form text, one per order, that between them hit the patterns."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = orders.join(part, orders.o_custkey == part.p_partkey)
    k = _key("o_orderkey")
    n4 = F.lpad((F.col("o_orderkey") % 9000 + 1000).cast("string"), 4, "0")
    n8 = F.lpad(k, 8, "0")
    dmy = F.date_format("o_orderdate", "dd/MM/yyyy")
    name = F.col("p_name")

    def text(*pieces: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    invoice = text("INVOICE NO ", k, "\nCustomer: ", name, "\nDue Date: ", dmy,
                   "\nTotal Amount: Rs. ", n4, ".50\nGST 18%\nPhone: 98", n8, "\n")
    card = text("GOVERNMENT OF INDIA\nAADHAAR\nName: ", name, "\nDOB: ", dmy,
                "\nGender: Male\n\nAddress:\nFlat ", n4,
                ", Sunshine Towers,\nKarnataka 560001\n\n", n4, " 5678 ", n4, "\n")
    garbled = text("INCOME CARD\nNane: ", name, "\n", dmy, "\nABCDE", n4, "F\nfemale\n")
    letter = text("Dear holder,\nkindly write u", k, "@example.com or see https://example.com/d/",
                  k, " today\nRegards\n")
    damaged = text("The Principat wi|l c|a|m £", n4, " on the 12° at SCH!OL\n")
    blank = F.when(F.col("o_orderkey") % 16 == 5, "").otherwise("  \n")
    statement = text("Account Number ", n8, "\nBalance debit credit IFSC statement\n"
                     "03 March 2021, April 7, 2022 and ", dmy, "\n")
    plain = text("Note ", k, " is plain")
    kind = F.col("o_orderkey") % 8
    chosen = F.when(kind == 0, invoice)
    for i, body in enumerate((card, garbled, letter, damaged, blank, statement), 1):
        chosen = chosen.when(kind == i, body)
    third = F.col("o_orderkey") % 3
    extension = F.when(third == 0, ".PDF").when(third == 1, ".png").otherwise(".jpeg")
    return joined.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("scan."), k, extension).alias("filename"),
        chosen.otherwise(plain).alias("text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, doc_id, text``: forms, documents and raw web pages with their address."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return (
        forms(spark, sf_dir).select(F.lit("form").alias("src"), "doc_id", "text")
        .unionByName(documents(spark, sf_dir).select(F.lit("doc").alias("src"), "doc_id", "text"))
        .unionByName(pages.select(
            F.lit("page").alias("src"), F.col("page_id").alias("doc_id"),
            F.concat("url", F.lit("\n"), "html").alias("text")))
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words with confidences; -1 marks non-words."""
    conf = F.when(F.col("l_returnflag") == "R", -1).when(
        F.col("l_linenumber") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"),
        conf.alias("conf"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of multi-page documents with confidence and detected language."""
    conv, turn = F.col("conv_id"), F.col("turn")
    lang = F.when((conv + turn) % 3 == 0, "unknown").when(
        (conv * 5 + turn) % 3 == 1, "en").otherwise("hi")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("doc_id"), turn.alias("page"), "text",
        ((conv * 7 + turn * 13) % 101).cast("double").alias("confidence"),
        lang.alias("detected_language"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings (modes 11 and 6) per document, from its page texts and roles."""
    conv = table(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    first = conv.select(key, F.lit(0).alias("pref"), F.concat(F.lit(" \n"), "text").alias("text"))
    second = conv.select(key, F.lit(1).alias("pref"), F.when(
        F.col("turn") % 2 == 0, F.concat("text", F.lit("\n"), "role")).otherwise(
        F.concat("text", F.lit(" \n \n \n \n"))).alias("text"))
    return first.unionByName(second)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by id and owner; every fourth names the wrong owner."""
    wrong = F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") + wrong).alias("user_id"))


def stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms as stored documents: raw text, and corrected text that may be absent or empty."""
    k = F.col("doc_id") % 5
    corrected = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").otherwise(F.col("text"))
    return forms(spark, sf_dir).select(
        "doc_id", "user_id", "filename", F.col("text").alias("raw_text"),
        corrected.alias("corrected_text"))


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as processing results with missing texts, language and confidence."""
    k = F.col("doc_id") % 4
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("doc."), _key("doc_id"), F.lit(".png")).alias("filename"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("raw_text"),
        F.when(k == 0, "").when(k != 1, F.replace(F.col("text"), F.lit("e"), F.lit("E"))).alias("corrected_text"),
        F.when(k != 2, F.col("lang")).alias("language"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 101).cast("double")).alias("confidence"),
        (F.col("doc_id") % 50).alias("user_id"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and sizes; some names are empty and some files too large."""
    page = F.col("page_id")
    last = F.element_at(F.split("url", "/"), -1)
    name = F.when(page % 10 == 0, "").when(
        page % 3 == 1, F.concat(last, F.lit(".Pdf"))).otherwise(F.concat(last, F.lit(".png")))
    size = F.length("html") * F.when(page % 7 == 0, 10000).otherwise(1)
    return table(spark, sf_dir, "pages").select(
        "page_id", name.alias("filename"), size.cast("bigint").alias("length"))


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with directories, no, one or several extensions and leading dots."""
    page = F.col("page_id")
    last = F.element_at(F.split("url", "/"), -1)
    name = (
        F.when(page % 6 == 0, F.col("url")).when(page % 6 == 1, F.concat(last, F.lit(".tar.gz")))
        .when(page % 6 == 2, F.concat(F.lit(".h"), last)).when(page % 6 == 3, F.concat(last, F.lit(".")))
        .when(page % 6 == 4, F.concat(F.lit("a.b/..x"), last, F.lit(".PDF")))
        .otherwise(F.concat(F.lit("a.b/"), last))
    )
    fmt = F.element_at(F.array(*map(F.lit, ("txt", "json", "docx", "pdf", "odt"))),
                       (page % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", name.alias("filename"), fmt.alias("fmt"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera payloads as JSON; some images are empty, some lack the data-URL header."""
    key = F.col("doc_id")
    body = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))
    image = F.when(key % 9 == 0, "").when(key % 5 == 0, body).otherwise(
        F.concat(F.lit("data:image/jpeg;base64,"), body))
    packed = F.to_json(F.struct(image.alias("image"), (key % 2 == 1).alias("handwriting")))
    return documents(spark, sf_dir).select(key.alias("id"), packed.alias("payload"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files ``path, content``: PNG and JPEG headers of page-sized images, some pages as they are."""
    page = F.col("page_id")

    def number(value: Column, size: int) -> Column:
        return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")

    height, width = F.length("url") * 37 + 1, F.length("html") % 60000 + page % 50 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(width, 4), number(height, 4))
    comment = F.least(F.octet_length("url"), F.lit(60))  # a segment to step over
    jpeg = F.concat(
        F.lit("FFD8FFFE"), number(comment + 2, 2), F.hex(F.substring(F.encode("url", "UTF-8"), F.lit(1), comment)),
        F.lit("FFC0001108"), number(height, 2), number(width, 2))
    content = F.when(page % 11 == 0, F.encode("html", "UTF-8")).when(page % 2 == 0, F.unhex(png)).otherwise(F.unhex(jpeg))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("img-"), _key("page_id")).alias("path"), content.alias("content"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups: a third ask for existing names, and each new name is asked for twice."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    new_name = F.concat(F.lit("new_"), _key("c_custkey"))
    names = F.when(key % 3 == 0, F.array(F.col("c_name"), new_name, new_name)).otherwise(
        F.array(new_name, new_name))
    exploded = customer.select(key, F.posexplode(names).alias("pos", "username"))
    return exploded.select("username", (key * 4 + F.col("pos")).alias("seq"))


def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as per-user documents, without texts."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        key.alias("doc_id"), "user_id", F.col("ts").alias("created_at"),
        F.concat("event_type", F.lit("-"), _key("event_id"), F.lit(".png")).alias("filename"),
        F.when(key % 4 == 0, "").when(key % 4 != 1, "en").alias("language"),
        F.when(key % 6 != 0, F.col("value")).alias("confidence"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as owned documents: some have no owner, some an owner that is gone."""
    key = F.col("o_orderkey")
    owner = F.when(key % 10 == 0, F.lit(None)).when(
        key % 10 == 1, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), owner.alias("user_id"))


def text_uploads(docs: DataFrame) -> DataFrame:
    """``documents`` as arriving uploads: some without a name, some too large, some without language or score."""
    key = F.col("doc_id")
    return docs.select(
        "doc_id", (key % 50).alias("user_id"), "text",
        F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("scan-"), _key("doc_id"), F.lit(".png"))).alias("filename"),
        F.when(key % 7 == 0, F.col("n_chars") * 10000).otherwise(F.col("n_chars")).alias("length"),
        F.when(key % 3 != 0, F.col("lang")).alias("language"),
        F.when(key % 4 != 0, (key % 101).cast("double")).alias("confidence"))


def paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation and some without pages; some are rejected."""
    key = F.col("doc_id")
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    more = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey").cast("bigint")).alias("doc_id"))
    return ids.unionByName(more).select(
        "doc_id", (F.abs(key) % 50).alias("user_id"),
        F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("scan."), _key("doc_id"), F.lit(".pdf"))).alias("filename"),
        (F.abs(key) * 7919 % 12_000_000).alias("length"))
