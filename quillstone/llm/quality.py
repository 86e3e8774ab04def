"""Quality rules whose limits come from the data: one sketch per language and source.

Every document gets a few measures. Their distribution in each (language,
source) group is kept in a mergeable sketch, a histogram with log-linear
buckets: counts of equal buckets add up, in any order and at any level. Each
group's sketch is blended with a few documents' worth of its language's, and
that with as much of all, so that small groups lean on wider ones and large ones
on themselves, without a step between. Quantiles of the blend are joined to the
documents and decide: a document may leave the middle half of its group by a
multiple of the group's spread, or of the chance spread of a text of its size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 4
PRIOR = 30
PART = 1000  # of a document: the unit that blended sketches count in
ALIKE = 1000
BUCKET_BITS = 6


class Measure(NamedTuple):
    """A whole-number measure per document and whether low values fail too.

    ``chance`` is the measure's standard deviation over single words or lines:
    over a text of n of them it is ``chance / sqrt(n)``, but not below that of ``ALIKE``:
    the words of one text are not drawn independently.
    """

    name: str
    top: str
    per: str
    scale: int
    chance: int
    both_sides: bool = False


# Word lengths deviate by 3 characters; symbols as at a rate of 1 in 50 words, repeated lines at 1 in 10,
# repeated words at the same rate in phrases of 15.
MEASURES = (
    Measure("word_length", "word_chars", "n_words", 100, 300, True),
    Measure("symbols", "n_symbols", "n_words", 1000, 140),
    Measure("repeated_lines", "n_dup_lines", "n_lines", 1000, 300),
    Measure("repeated_words", "n_repeat_words", "n_words", 1000, 1160),
)
# Share of a group's documents at or below each: the middle half and the tail.
QUANTILES = {"q1": (1, 4), "q3": (3, 4), "q7": (7, 8)}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def measure_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``_COUNTS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, _SPACE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if n > 3:
        triples = list(zip(words, words[1:], words[2:]))
        seen = Counter(triples)
        if len(seen) < len(triples):
            covered = bytearray(n)
            for i, t in enumerate(triples):
                if seen[t] > 1:
                    covered[i:i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return n, len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``key, lang, source`` and the counts; narrow, one text in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure_text(t.as_py()) for t in b.column(3)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["_id", "_lang", "_source", *_COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select(
        F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"),
        F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"),
    ).mapInArrow(run, f"_id {kind}, _lang string, _source string, {counts}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: its leading bits, so at most 1/32 below the value."""
    drop = F.greatest(F.length(F.bin(value)) - BUCKET_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _value(m: Measure) -> Column:
    return F.floor(m.scale * F.col(m.top) / F.greatest(F.col(m.per), F.lit(1))).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """``_lang, _source, measure, bucket, n``: the sketch of each group, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(m.name).alias("measure"), bucket(_value(m)).alias("bucket")) for m in MEASURES])
    return (
        measures.filter(~base_failed()).select("_lang", "_source", F.explode(pairs).alias("p"))
        .groupBy("_lang", "_source", "p.measure", "p.bucket").agg(F.count("*").alias("n")))


def _merged(sketch: DataFrame, *group: str) -> DataFrame:
    """``group, measure, total, sketch``: sketches merged up to ``group``, each an array of (bucket, n).

    An array has an entry for each bucket met, a few hundred at most.
    """
    counts = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    return counts.groupBy(*group, "measure").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("sketch"))


def _parts(sketch: str, documents: int = 1, *totals: Column) -> Column:
    """A sketch in parts of documents: its counts times ``documents``, divided by each of ``totals``."""
    def parts(s: Column) -> Column:
        n = documents * PART * s["n"]
        for total in totals:
            n = F.call_function("div", n, total)
        return F.struct(s["bucket"].alias("bucket"), n.alias("n"))
    return F.transform(sketch, parts)


def _quantiles(sketch: str) -> tuple[Column, Column]:
    """Of an array of (bucket, n): its count, to be named ``_total``, and a struct of the least bucket of each quantile."""
    total = F.aggregate(sketch, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    start = F.struct(F.lit(0).cast("long").alias("upto"), *[F.lit(None).cast("long").alias(q) for q in QUANTILES])

    def step(a: Column, s: Column) -> Column:
        upto = a["upto"] + s["n"]
        return F.struct(upto.alias("upto"), *[
            F.coalesce(a[q], F.when(of * upto >= share * F.col("_total"), s["bucket"])).alias(q)
            for q, (share, of) in QUANTILES.items()])
    return total, F.aggregate(F.array_sort(sketch), start, step)


def limits(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``_lang, _source, <measure>_q1, _q3, _q7`` of every group in the sketch, blended with its wider groups.

    ``prior`` is the number of documents that the language's blend counts for in
    each group's, and the sketch of all in each language's.
    """
    fine = _merged(sketch, "_lang", "_source")
    wide = _merged(sketch, "_lang").select(
        F.col("_lang").alias("_l"), F.col("measure").alias("_m"), F.col("total").alias("wide_total"),
        F.col("sketch").alias("wide"))
    every = _merged(sketch).withColumnsRenamed({"measure": "_n", "total": "all_total", "sketch": "all"})
    wide = wide.join(every, F.col("_m") == F.col("_n"))
    own_language = F.col("wide_total") + prior  # its documents and those it is blended with
    blended = fine.join(wide, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).select(
        "_lang", "_source", "measure", F.concat(
            _parts("sketch"), _parts("wide", prior, own_language),
            _parts("all", prior * prior, F.col("all_total"), own_language)).alias("sketch"))
    total, found = _quantiles("sketch")
    found = blended.withColumn("_total", total).withColumn("q", found)
    return found.groupBy("_lang", "_source").agg(*[
        F.max(F.when(F.col("measure") == m.name, F.col(f"q.{q}"))).alias(f"{m.name}_{q}")
        for m in MEASURES for q in QUANTILES])


def _fits(m: Measure, fence: int) -> Column:
    """Whether a measure lies in the fences of the document's group, widened to the chance spread of its size."""
    q1, q3, q7 = (F.col(f"{m.name}_{q}") for q in QUANTILES)
    size = F.least(F.greatest(F.col(m.per), F.lit(1)), F.lit(ALIKE)).cast("double")
    chance = F.floor(fence * m.chance / F.sqrt(size)).cast("long")
    reach = F.greatest(fence * (q3 - q1), fence * (q7 - q3), chance)
    return _value(m).between(q1 - reach if m.both_sides else F.lit(0).cast("long"), q3 + reach)


def judge_quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    fence: int = FENCE, prior: int = PRIOR,
) -> DataFrame:
    """``key``, the counts, ``base_failed`` and ``kept``: one row per input row.

    NULL and empty texts have no words and fail the base rule. NULL language or
    source is a group of its own; a group of which all fail has no limits. Documents that fail the base rule shape no
    limit. Rows that repeat count again; other columns are ignored. The join to
    the limits may be split for a hot source, and is broadcast only if the
    planner finds the limits small.
    """
    counts = stored(measured(docs, key, text, lang, source), "quality")
    found = limits(sketches(counts), prior).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    fits = F.lit(True)
    for m in MEASURES:
        fits &= _fits(m, fence)
    joined = counts.join(
        found, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    return joined.select(
        F.col("_id").alias(key), *_COUNTS[:5], base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(fits, F.lit(False))).alias("kept"), "n_lines")
