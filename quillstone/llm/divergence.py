"""How far the sources of a language diverge in the terms they use.

``CountVectorizer`` with a document-frequency bound and the largest vocabulary
size learns the terms of one language at a time and turns its documents into
sparse count vectors. Vectors are added up per source entry by entry, before and
after one shuffle, and stay sparse: a source keeps its own terms only. Shares of
one thousand million, one whole number each, are compared term by term.

Pairs of sources are compared in blocks of terms: a task gets the entries of some
sources in one block, walks the terms that either source of a pair has, and adds
all others at once, since terms that neither has differ alike. Many sources are
dealt out in blocks as well, so a task holds two blocks of sources at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir
from .common import stored, text_or_empty, utf8, written_lean

MIN_DOCS = 10
MAX_VOCABULARY = 2**31 - 1
SHARES = 1_000_000_000
TOP = 10
TERM_BLOCK = 4096
SOURCE_BLOCK = 64
FOLDERS = 512
_EVERYWHERE = b"-"  # no term; keeps a language without kept terms from failing


# What each byte of a text becomes: separators a space, A to Z their small letters.
_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
               for b in range(256))


def term_lines(docs: DataFrame) -> DataFrame:
    """``lang, source, terms, again``: the terms of each ``text``, a space between.

    ``terms`` has each term once, behind a mark that is no term; ``again`` has a
    space and the term for every further occurrence, so both together are all of
    them. Terms are runs of letters and non-ASCII characters with A to Z in lower case.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            once, again = [], []
            for t in b.column(2):
                found = Counter(t.as_py().translate(_BYTES).split())
                once.append(b" ".join([_EVERYWHERE, *found]))
                again.append(b"".join([(b" " + term) * (n - 1) for term, n in found.items() if n > 1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(once, pa.string()), pa.array(again, pa.string())],
                ["lang", "source", "terms", "again"])

    return docs.select("lang", "source", utf8(F.col("text"))).mapInArrow(
        run, "lang string, source string, terms string, again string")


def _folder(lang: Column) -> Column:
    """Which folder of the stored terms a language is in; their number is bounded, whatever the languages."""
    return F.pmod(F.xxhash64(lang), F.lit(FOLDERS)).cast("int")


def _share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SHARES * (count + 2) / (n + 2 v))``, exact beyond the range of a long."""
    top = F.lit(SHARES).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)"))


def _difference(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, source, index, term, count`` of kept terms, and ``lang, source`` of every group, both stored.

    One model per language. Its vocabulary passes through the driver; languages
    with fewer documents than the bound keep no term and need no model.
    """
    spark = docs.sparkSession
    plain = docs.select(
        text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).alias("text"))
    groups = stored(plain.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "divergence-groups")
    # by folders of languages, so that a model's scan leaves out the others
    lines = work_dir(spark, "divergence-terms")
    with written_lean(spark):
        term_lines(plain).withColumn("folder", _folder(F.col("lang"))).sortWithinPartitions(
            "folder", "lang", "source").write.partitionBy("folder").option("compression", "zstd").parquet(lines)
    rows = spark.read.schema("lang string, source string, terms string, again string, folder int").parquet(lines)
    path = work_dir(spark, "divergence-counts")
    counts = "lang string, source string, index int, term string, count long"
    spark.createDataFrame([], counts).write.parquet(path)
    sizes = groups.groupBy("lang").agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    for row in sizes.orderBy("lang").select("lang", _folder(F.col("lang")).alias("folder")).collect():
        part = rows.filter((F.col("folder") == row.folder) & (F.col("lang") == row.lang))
        model = CountVectorizer(
            inputCol="terms", outputCol="_vector", minDF=float(min_docs), vocabSize=MAX_VOCABULARY,
        ).fit(part.select(F.split("terms", " ").alias("terms")))  # which terms are kept depends on documents alone
        names = pa.table({"index": pa.array(range(len(model.vocabulary)), pa.int32()), "term": model.vocabulary})
        vector = F.unwrap_udt("_vector")
        whole = part.select("source", F.split(F.concat("terms", "again"), " ").alias("terms"))
        entries = model.transform(whole).select("source", F.explode(
            F.arrays_zip(vector["indices"].alias("index"), vector["values"].alias("value"))).alias("e"))
        summed = entries.groupBy("source", F.col("e.index").alias("index")).agg(
            F.sum(F.col("e.value").cast("long")).alias("count"))
        with written_lean(spark):
            summed.join(spark.createDataFrame(names), "index").filter(F.col("term") != _EVERYWHERE.decode()).select(
                F.lit(row.lang).alias("lang"), "source", "index", "term", "count").write.mode("append").parquet(path)
    return spark.read.schema(counts).parquet(path), groups.select("lang", "source")


def _met_pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, met, total``: of each pair, the terms that either source has and their differences' sum.

    ``entries`` has ``lang, number, index, p`` and ``groups`` every ``lang, number,
    none``, the share of a term that the source lacks. In a block of terms each
    source stands with that share, so pairs of which one has no term there count.
    """
    block = F.floor(F.col("index") / TERM_BLOCK).alias("block")
    there = entries.select(
        "lang", block, "number", F.pmod("index", F.lit(TERM_BLOCK)).alias("slot"), "p")
    heads = there.select("lang", "block").distinct().join(groups, "lang").select(
        "lang", "block", "number", F.lit(-1).alias("slot"), F.col("none").alias("p"))
    own = F.floor(F.col("number") / SOURCE_BLOCK)
    blocks = groups.groupBy("lang").agg(F.floor(F.max("number") / SOURCE_BLOCK).alias("_last"))
    dealt = there.unionByName(heads).join(blocks, "lang").withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).select(
        "lang", "block", F.least(own, "_other").alias("x"), F.greatest(own, "_other").alias("y"), "number", "slot", "p")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        number, slot, p = (rows.column(c).to_numpy() for c in ("number", "slot", "p"))
        sources, at = np.unique(number, return_inverse=True)
        head = slot < 0
        share = np.zeros((len(sources), TERM_BLOCK), np.int64)
        share[at[head]] = p[head][:, None]
        share[at[~head], slot[~head]] = p[~head]
        has = np.zeros(share.shape, bool)
        has[at[~head], slot[~head]] = True
        x, y = key[2].as_py(), key[3].as_py()
        found = []
        for a in np.flatnonzero(sources // SOURCE_BLOCK == x):
            for b in np.flatnonzero((sources // SOURCE_BLOCK == y) & (sources > sources[a])):
                either = has[a] | has[b]
                u, v = share[a, either], share[b, either]
                if len(u):
                    found.append((int(sources[a]), int(sources[b]), len(u), int(((u - v) ** 2 // (u + v)).sum())))
        columns = list(zip(*found)) or [[]] * 4
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string())} | {
            c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "met", "total"), columns)})

    met = dealt.groupBy("lang", "block", "x", "y").applyInArrow(compare, "lang string, a long, b long, met long, total long")
    return met.groupBy("lang", "a", "b").agg(F.sum("met").alias("met"), F.sum("total").alias("total"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how a source differs from others of its language.

    Each language keeps the terms of at least ``min_docs`` of its documents, V of
    them. A group (language and source, met together in some document) or a
    language gives each kept term the share ``p = 1 + floor(10^9 (count + 2) / (N +
    2V))``, N being its occurrences of kept terms; two shares differ by
    ``floor((p - q)^2 / (p + q))``. Part ``pair``: every other source of the
    language and the sum over all kept terms, 0 without any. Part ``term``: the
    ``top`` kept terms that the source has and gives more than its language does.
    Ranks go by value, the greatest first, then by item in UTF-8.

    NULL text, language and source count as empty; documents are rows, repeated
    ones and repeated or NULL ids too. Other columns are ignored; an empty table
    gives an empty result.
    """
    counts, found = term_counts(docs, text, lang, source, min_docs)
    of_lang = stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count")), "divergence-languages")
    sizes = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = found.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(
        sizes, "lang", "left").select(
        "lang", "source", (F.row_number().over(by_name) - 1).cast("long").alias("number"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), "lang_n")
    groups = stored(groups.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v")))),
                    "divergence-groups")
    entries = stored(counts.join(groups, ["lang", "source"]).join(of_lang, ["lang", "term"]).select(
        "lang", "source", "number", "index", "term", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        _share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q")), "divergence-shares")

    one, other = groups.select("lang", *(F.col(c).alias(f"a_{c}") for c in ("number", "source", "none", "v"))), groups.select(
        "lang", *(F.col(c).alias(f"b_{c}") for c in ("number", "source", "none")))
    met = _met_pairs(entries, groups.filter("none is not null")).withColumnsRenamed({"a": "a_number", "b": "b_number"})
    pairs = one.join(other, "lang").filter("a_number < b_number").join(met, ["lang", "a_number", "b_number"], "left")
    rest = (F.col("a_v") - F.coalesce("met", F.lit(0))) * _difference(F.col("a_none"), F.col("b_none"))
    value = F.coalesce(F.coalesce("total", F.lit(0)) + rest, F.lit(0)).cast("long").alias("value")
    both = F.explode(F.array(*[
        F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba")]))
    pair = pairs.select("lang", value, both.alias("s")).select(
        "lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    term = entries.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _difference(F.col("p"), F.col("q")).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(ranked).alias("rank")
    return pair.select("*", rank).unionByName(term.select("*", rank).filter(F.col("rank") <= top))
