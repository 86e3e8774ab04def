"""Document classification: narrow and relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BLANK_TYPE, DOC_TYPES, NO_TYPE_ICON, UNMATCHED_TYPE
from ..functions.classify import classification, score
from ..functions.text import is_blank, let


def keyword_hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and keyword found: ``key, type, keyword``.

    A narrow generator: the 118 substring tests run in place and only hits
    become rows, so nothing is shuffled or joined.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("type"), F.lit(k).alias("keyword"))
        for name, _, keywords in DOC_TYPES for k in keywords
    ])
    found = let(F.lower(text), lambda low: F.filter(pairs, lambda e: F.contains(low, e["keyword"])))
    return docs.select(key, F.explode(found).alias("_hit")).select(key, "_hit.type", "_hit.keyword")


def _found_types(text: str) -> Column:
    """``array<struct<type, ord, icon, matched>>`` of the types with a keyword in the text."""
    def matched(low: Column) -> Column:
        return F.array(*[
            F.struct(
                F.lit(name).alias("type"), F.lit(i).alias("ord"), F.lit(icon).alias("icon"),
                F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))
                .cast("bigint").alias("matched"))
            for i, (name, icon, keywords) in enumerate(DOC_TYPES)
        ])

    return F.filter(let(F.lower(text), matched), lambda e: e["matched"] > 0)


def type_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matched keywords and confidence per document and type, matches only.

    All hits of a document are in its own row, so nothing is shuffled.
    """
    found = docs.select(key, F.explode(_found_types(text)).alias("_t"))
    return found.select(key, "_t.type", "_t.matched", score(F.col("_t.matched")).alias("confidence"))


def classify(docs: DataFrame, text: str = "text", out: str = "classification") -> DataFrame:
    """Add ``struct<type, icon, confidence, scores>``; one projection, no shuffle."""
    return docs.withColumn(out, classification(F.col(text)))


def classify_relational(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same answer by grouping the scores of each document, unmatched documents included.

    One scan and one shuffle of a row per document and type; the best type is
    a ``max`` of a struct, combined before the shuffle.
    """
    rows = docs.select(key, is_blank(F.col(text)).alias("_blank"), F.explode_outer(_found_types(text)).alias("_t"))
    rank = F.when(F.col("_t").isNotNull(), F.struct(
        score(F.col("_t.matched")).alias("confidence"), (-F.col("_t.ord")).alias("rank"), "_t.type", "_t.icon"))
    best = rows.groupBy(key).agg(F.max("_blank").alias("_blank"), F.max(rank).alias("b"))
    return best.select(
        key,
        F.when(F.col("_blank"), BLANK_TYPE)
        .otherwise(F.coalesce("b.type", F.lit(UNMATCHED_TYPE))).alias("type"),
        F.coalesce("b.icon", F.lit(NO_TYPE_ICON)).alias("icon"),
        F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
    )


def display_classification(df: DataFrame, c: str = "classification") -> DataFrame:
    """Add the display line of a classification: icon, type and whole-number score."""
    kind: Column = F.col(f"{c}.type")
    icon = F.coalesce(F.nullif(F.col(f"{c}.icon"), F.lit("")), F.lit("📄"))
    line = F.format_string(
        "%s %s %s%%", icon, kind, F.format_number(F.col(f"{c}.confidence"), 0))
    missing = F.coalesce(kind, F.lit(BLANK_TYPE)) == BLANK_TYPE
    return df.withColumn(
        "display", F.when(missing, "Could not classify document.").otherwise(line))
