"""Text repair operators: corrected text, and line routing for a grammar model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import corrected_text, digits_of, is_blank
from .rollup import ordered_concat

KEEP_DIGIT_SHARE = 0.25


def correct_text(df: DataFrame, text: str = "text", out: str = "corrected_text") -> DataFrame:
    """Add the repaired text; one projection."""
    return df.withColumn(out, corrected_text(F.col(text)))


def route_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: ``key, line_no, line, digit_ratio, action``.

    Blank lines and lines with more than a quarter of digits are kept as they
    are; the others are candidates for correction.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    line = F.col("line")
    ratio = F.length(digits_of(line)) / F.greatest(F.length(line), F.lit(1))
    keep = is_blank(line) | (F.col("digit_ratio") > KEEP_DIGIT_SHARE)
    return lines.withColumn("digit_ratio", ratio).withColumn(
        "action", F.when(keep, "keep").otherwise("correct"))


def rejoin_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rebuild each document's text from its lines in order."""
    return ordered_concat(lines, key, "line_no", ["line"], "\n").withColumnRenamed("line", "text")
