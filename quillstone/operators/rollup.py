"""Page, word and candidate roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NON_BLANK, WHITESPACE, round_half_even, strip
from ..session import work_dir

PAGE_SEPARATOR = "\n\n"
BLOCK = 256
UNKNOWN = "unknown"
# Page confidences summed exactly, so the mean does not depend on row order.
EXACT = "decimal(28,10)"


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean word confidence per page, the sentinel -1 left out, two decimals."""
    conf = F.when(F.col("conf").cast("string") != "-1", F.col("conf").cast("double").cast("long"))
    return words.groupBy("doc_id", "page").agg(
        F.coalesce(round_half_even(F.avg(conf), 2), F.lit(0.0)).alias("confidence"))


def snapshot_confidence(words: DataFrame) -> DataFrame:
    """Mean of the whole-number confidences above zero per page, one decimal."""
    whole = F.col("conf").cast("string").rlike(r"^-*[0-9]+$")
    value = F.when(whole, F.expr("try_cast(conf AS bigint)"))
    return words.groupBy("doc_id", "page").agg(
        F.coalesce(round_half_even(F.avg(F.when(value > 0, value)), 1), F.lit(0.0))
        .alias("confidence"))


def ordered_concat(
    df: DataFrame, key: str, ordinal: str, values: list[str], sep: str, block: int | None = BLOCK,
) -> DataFrame:
    """Concatenate the values of each key in order, each value column by itself.

    Keys within one block of ordinals are sorted and joined in one step, so
    their texts move once. Keys with more rows go in two levels, blocks of
    neighbouring rows first, spread over the cluster by key and block, so none
    is sorted in one task. Which keys those are is a small aggregate without
    the texts, stored, so that the planner knows its size and the texts are
    scanned once where there is none. ``block=None`` takes every key to be short. Ordinals are unique
    within a key. The result is one string per key and must fit one value; for
    keys beyond that keep the parts of :func:`document_parts`.
    """
    if block is None:
        return _concat_level(df, [key], ordinal, values, sep)
    number = F.floor(F.col(ordinal) / block)
    path = work_dir(df.sparkSession, "long-documents")
    df.groupBy(key).agg(F.min(number).alias("_b0"), F.max(number).alias("_b1")).filter(
        "_b0 < _b1").select(key).write.parquet(path)
    long = df.sparkSession.read.schema(df.select(key).schema).parquet(path)
    if long.isEmpty():
        return _concat_level(df, [key], ordinal, values, sep)
    short = _concat_level(df.join(long, key, "left_anti"), [key], ordinal, values, sep)
    blocks = df.join(long, key, "left_semi").withColumn("_block", number)
    first = _concat_level(blocks, [key, "_block"], ordinal, values, sep)
    return short.unionByName(_concat_level(first, [key], "_block", values, sep))


def _concat_level(
    df: DataFrame, keys: list[str], ordinal: str, values: list[str], sep: str,
) -> DataFrame:
    def joined(value: str) -> Column:
        texts = F.transform("_rows", lambda r: r[value])
        return F.array_join(texts, sep, "").alias(value)

    rows = F.array_sort(F.collect_list(F.struct(ordinal, *values)))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    return grouped.select(*keys, *[joined(v) for v in values])


def document_text(
    pages: DataFrame, texts: list[str] | None = None, block: int | None = BLOCK,
) -> DataFrame:
    """One row per document: pages in order, a blank line between, ends stripped.

    ``texts`` names the text columns (``text`` by default); raw and corrected
    texts are joined in the same pass.
    """
    texts = texts or ["text"]
    whole = ordered_concat(pages, "doc_id", "page", texts, PAGE_SEPARATOR, block)
    return whole.withColumns({t: strip(F.col(t)) for t in texts})


def document_parts(pages: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The text of each document as ordered parts of at most ``block`` page numbers.

    The parts of a document joined in order by a blank line equal
    :func:`document_text`, and no task ever holds a whole document, so a
    document may be larger than one string value can be. Leading and trailing
    blank parts are dropped by comparing each part with the document's first
    and last non-blank part, found by a small aggregate.
    """
    numbered = pages.withColumn("part", F.floor(F.col("page") / block))
    parts = _concat_level(numbered, ["doc_id", "part"], "page", [text], PAGE_SEPARATOR)
    visible = F.when(F.col(text).rlike(NON_BLANK), F.col("part"))
    ends = numbered.groupBy("doc_id").agg(
        F.min(visible).alias("_first"), F.max(visible).alias("_last"))
    inside = parts.join(ends, "doc_id").filter(F.col("part").between(F.col("_first"), F.col("_last")))
    spaces, body = F.lit(WHITESPACE), F.col(text)
    begun = F.when(F.col("part") == F.col("_first"), F.ltrim(body, spaces)).otherwise(body)
    ended = F.when(F.col("part") == F.col("_last"), F.rtrim(F.col("_begun"), spaces))
    return inside.withColumn("_begun", begun).select(
        "doc_id", "part", ended.otherwise(F.col("_begun")).alias(text))


def document_confidence(pages: DataFrame) -> DataFrame:
    """Unweighted mean of page confidences per document, not rounded."""
    return _page_statistics(pages, F.lit(None).cast("string")).select("doc_id", "confidence")


def document_language(pages: DataFrame) -> DataFrame:
    """Most frequent known page language; ties go to the one seen first.

    ``mode`` would break ties differently.
    """
    plain = pages.select("doc_id", "page", "detected_language", F.lit(0.0).alias("confidence"))
    return _page_statistics(plain, F.col("detected_language")).select("doc_id", "language")


def _page_statistics(pages: DataFrame, language: Column) -> DataFrame:
    """``doc_id, confidence, language`` by two aggregates, each combined before its shuffle."""
    counted = pages.groupBy("doc_id", F.nullif(language, F.lit(UNKNOWN)).alias("lang")).agg(
        F.count("*").alias("n"), F.min("page").alias("seen"),
        F.sum(F.col("confidence").cast(EXACT)).alias("total"), F.count("confidence").alias("known"))
    rank = F.when(F.col("lang").isNotNull(), F.struct("n", -F.col("seen"), "lang"))
    merged = counted.groupBy("doc_id").agg(
        F.max(rank).alias("best"), F.sum("total").cast("double").alias("total"), F.sum("known").alias("known"))
    mean = F.col("total") / F.nullif(F.col("known"), F.lit(0))
    return merged.select(
        "doc_id", F.coalesce(mean, F.lit(0.0)).alias("confidence"),
        F.coalesce("best.lang", F.lit(UNKNOWN)).alias("language"))


def multi_page_document(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Raw and corrected text, confidence and language per document.

    With ``docs`` (a ``doc_id`` table), documents that have no page come out
    with ``error`` set.
    """
    merged = document_text(pages, ["raw_text", "corrected_text"]).join(
        _page_statistics(pages, F.col("detected_language")), "doc_id")
    if docs is None:
        return merged.withColumn("error", F.lit(None).cast("string"))
    joined = docs.select("doc_id").join(merged, "doc_id", "left")
    missing = F.col("language").isNull()
    return joined.withColumn("error", F.when(missing, "PDF contains no pages"))


def _winners(rows: DataFrame, order: Column) -> DataFrame:
    """The row of each document with the least ``order``, a whole number.

    The texts take no part in the aggregate: the least order of each document is
    found from the numbers, and only then are the rows with it looked up.
    """
    ranked = rows.withColumn("_order", order)
    least = ranked.groupBy("doc_id").agg(F.min("_order").alias("_order"))
    return ranked.join(least, ["doc_id", "_order"], "left_semi").drop("_order")


def first_page(pages: DataFrame) -> DataFrame:
    """The lowest-numbered page of each document; pages are numbered once within a document."""
    rest = [c for c in pages.columns if c not in ("doc_id", "page")]
    number = F.coalesce(F.col("page").cast("bigint"), F.lit(2**63 - 1))
    return _winners(pages, number).select("doc_id", "page", *rest)


def best_candidate(readings: DataFrame) -> DataFrame:
    """Longest stripped reading per document; ties go to the lower ``pref``.

    ``pref`` is a whole number from 0 below 2^32, met once within a document.
    """
    stripped = readings.select("doc_id", "pref", strip(F.col("text")).alias("text"))
    shorter = -F.coalesce(F.length("text"), F.lit(-1)).cast("bigint")
    return _winners(stripped, shorter * 2**32 + F.coalesce("pref", F.lit(2**32 - 1)))
