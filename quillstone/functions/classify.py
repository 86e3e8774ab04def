"""Keyword classification as native Columns over lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BLANK_TYPE, DOC_TYPES, NO_TYPE_ICON, SATURATING_HITS, UNMATCHED_TYPE
from .text import is_blank, let


def keyword_array(keywords: list[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords])


def hits(low: Column, keywords: list[str]) -> Column:
    """The keywords that occur anywhere in the text, each once."""
    return F.filter(keyword_array(keywords), lambda k: F.contains(low, k))


def score(n_hits: Column) -> Column:
    """Share of the saturating hit count as a percentage with one decimal."""
    return F.round(F.least(n_hits / F.lit(float(SATURATING_HITS)) * 100, F.lit(100.0)), 1)


def _ranked(low: Column) -> Column:
    """``array<struct<score, rank, type, icon>>`` of the types that scored.

    ``rank`` falls along the dimension, so the greatest element is the best
    type with ties going to the earlier one.
    """
    entries = [
        F.struct(
            score(F.size(hits(low, keywords))).alias("score"), F.lit(-i).alias("rank"),
            F.lit(name).alias("type"), F.lit(icon).alias("icon"),
        )
        for i, (name, icon, keywords) in enumerate(DOC_TYPES)
    ]
    return F.filter(F.array(*entries), lambda e: e["score"] > 0)


def _pick(ranked: Column) -> Column:
    best = F.array_max(ranked)
    return F.struct(
        F.coalesce(best["type"], F.lit(UNMATCHED_TYPE)).alias("type"),
        F.coalesce(best["icon"], F.lit(NO_TYPE_ICON)).alias("icon"),
        F.coalesce(best["score"], F.lit(0.0)).alias("confidence"),
        F.map_from_entries(F.transform(ranked, lambda e: F.struct(e["type"], e["score"]))).alias("scores"),
    )


def classification(text: Column) -> Column:
    """``struct<type, icon, confidence, scores>`` of a text.

    The text is lower-cased once, outside the keyword tests.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    blank = F.struct(
        F.lit(BLANK_TYPE).alias("type"), F.lit(NO_TYPE_ICON).alias("icon"),
        F.lit(0.0).alias("confidence"), none.alias("scores"),
    )
    scored = let(let(F.lower(text), _ranked), _pick)
    return F.when(is_blank(text), blank).otherwise(scored)
