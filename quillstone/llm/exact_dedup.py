"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their leading bytes, then the groups that hold several texts
by the bytes that follow, and so on until a group is a single text or all of
its texts have ended. Equality is decided by the bytes themselves; no digest is
involved. The first digit is short, so texts that differ early leave at once;
later digits grow, so even very long texts take few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, numbered, stored, text_or_empty, utf8

FIRST_DIGIT = 64
GROWTH = 16


def normalised(c: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.regexp_replace(text_or_empty(c), ASCII_SPACE + "+", "")


def _cut(df: DataFrame, width: int) -> DataFrame:
    """Split ``rest`` (binary) into this round's digit and what follows it."""
    return (
        df.withColumn("digit", F.substring("rest", 1, width))
        .withColumn("rest", F.substring("rest", width + 1, 2**31 - 1 - width))
        .withColumn("ended", F.octet_length("rest") == 0)
    )


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    first_digit: int = FIRST_DIGIT, growth: int = GROWTH,
) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256``: one row per input row.

    Texts are equal when identical after deleting ASCII white space. Of equal
    texts the row with the most code points in its original text stays, then
    the least key. NULL and empty texts are equal. Rows that repeat a key are
    counted apart and, if it is the key that stays, all marked kept. Other
    columns are ignored; an empty table gives an empty result.

    Each round counts (group, digit) before the shuffle and joins the counts
    back; a group with a third of all rows is one row on the counted side, so
    adaptive execution splits the join; it is a merge join at every size, since
    the counts grow with the input. Only rows of groups that are still open
    carry their remaining bytes on, through the shared folder.
    """
    plain = normalised(F.col(text))
    rows = docs.select(
        F.col(key).alias("_id"), F.length(text_or_empty(text)).cast("long").alias("_chars"),
        F.sha2(utf8(plain), 256).alias("text_sha256"), F.lit(0).cast("long").alias("_gid"),
        utf8(plain).alias("rest"))
    width, done = first_digit, []
    while True:
        cut = _cut(rows, width)
        groups = stored(
            cut.groupBy("_gid", "digit", "ended").agg(
                F.count("*").alias("group_size"),
                F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").alias("i"))).alias("best"))
            .filter("group_size > 1")
            .select("_gid", "digit", "ended", "group_size", F.col("best.i").alias("keep_id"),
                    (F.monotonically_increasing_id() + 1).alias("_next")), "radix-groups")
        met = cut.join(groups.hint("merge"), ["_gid", "digit", "ended"], "left")
        done.append(met.filter(F.col("_next").isNull() | F.col("ended")).select(
            F.col("_id").alias(key),
            F.when(F.col("_next").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256"))
        if groups.filter("not ended").isEmpty():
            break
        rows = stored(
            cut.filter("not ended").join(groups.filter("not ended").hint("merge"), ["_gid", "digit"])
            .select("_id", "_chars", "text_sha256", F.col("_next").alias("_gid"), "rest"), "radix-rows", "zstd")
        width *= growth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its own columns.

    The row that :func:`exact_groups` names; among rows that repeat its key, one
    of those with the most code points. Keys, NULL ones too, may repeat.
    """
    rows = numbered(docs, "exact-rows")
    at = F.struct(F.col("row")[key].alias("key"), "_row").alias("at")
    kept = exact_groups(rows.select(at, F.col("row")[text].alias("text")), "at", "text").filter("kept").select(
        F.col("at._row").alias("_kept"))
    return rows.join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi").select("row.*")
