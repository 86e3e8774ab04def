"""Packing documents into token windows by non-negative least squares.

Whole windows of a long document stand alone. What remains of each document is
a length under one window, and the histogram of those lengths is all the
solver sees: shallow combinations of lengths that fill a window exactly are
enumerated, their repeat counts are solved by non-negative least squares
against the histogram, rounded to what is there, and turned into ranges of
ranks within each length. Documents left over are packed greedily, one after
another, and cut where a window ends; the last, partly filled window becomes
windows of power-of-two lengths, so nothing is padded.

The solver's input and output are bounded by the window length, never by the
number of documents.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty, utf8

WINDOW = 2048
END_ID = 1
PARTNERS = 24
SWEEPS = 300
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=1)
def tokenizer(ranks: str = RANKS) -> tiktoken.Encoding:
    """The 50k byte-level vocabulary from its rank file.

    Gives the ids of ``byte_bpe_50k.json`` in the tokenizers library, end mark
    included (tests compare them), at several times its speed.
    """
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = "<|endoftext|>"
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                             special_tokens={end: len(table)})


def token_ids(text: str | None) -> np.ndarray:
    """The ids of a whole text and the end id, little-endian unsigned 32-bit."""
    ids = tokenizer().encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def _crcs(ids: np.ndarray, window: int) -> list[int]:
    return [zlib.crc32(ids[i:i + window].tobytes()) for i in range(0, len(ids), window)]


def token_counts(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """``_id, n, crcs, sha``: tokens of each whole text with its end id, the CRC of each window of them, the text's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crcs = [], []
            for t in b.column(1):
                ids = token_ids(t.as_py())
                n.append(len(ids))
                crcs.append(_crcs(ids, window))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), b.column(2)],
                ["_id", "n", "crcs", "sha"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), _digest(text)).mapInArrow(
        run, f"_id {kind}, n long, crcs array<long>, sha string")


def _digest(text: str) -> Column:
    return F.sha2(utf8(text_or_empty(text)), 256)


def fillings(lengths: np.ndarray, counts: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Combinations of two or three present lengths that fill the window, zero-padded to three.

    Pairs are complete; triples join every length to the ``partners`` most frequent ones.
    """
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    pairs = [(a, window - a, 0) for a in lengths if 2 * a <= window and present[window - a]]
    often = lengths[np.argsort(-counts, kind="stable")[:partners]]
    triples = {tuple(sorted((int(a), int(b), int(window - a - b))))
               for b in often for a in lengths if a + b < window and present[window - a - b]}
    return np.array([*pairs, *sorted(triples)], int).reshape(-1, 3)


def non_negative_least_squares(combos: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used nearest to the histogram.

    Accelerated projected gradient; the matrix is never built, since a column
    has at most three entries.
    """
    used = combos > 0

    def times(x):
        return np.bincount(combos[used], np.broadcast_to(x[:, None], combos.shape)[used], len(histogram))

    def transposed(r):
        return np.where(used, r[combos], 0.0).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = transposed(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * np.linalg.norm(transposed(times(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(sweeps):
        nxt = np.maximum(0, y - step * transposed(times(y) - histogram))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def solve(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rank ranges ``(length, low, high, first sequence, offset)`` and how many sequences they make."""
    lengths = np.array(sorted(histogram), int)
    counts = np.array([histogram[n] for n in lengths], np.int64)
    combos = fillings(lengths, counts, window) if len(lengths) else np.zeros((0, 3), int)
    if not len(combos):
        return [], 0
    target = np.zeros(window + 1)
    target[lengths] = counts
    x = non_negative_least_squares(combos, target)
    left, taken = dict(zip(lengths.tolist(), counts.tolist())), dict.fromkeys(lengths.tolist(), 0)
    ranges, sequences = [], 0
    for wanted in (np.floor(x + 1e-6), np.full(len(x), np.inf)):  # rounded, then whatever still fits
        for i in np.argsort(-x, kind="stable"):
            parts = [int(n) for n in combos[i] if n]
            times = int(min(wanted[i], *(left[n] // parts.count(n) for n in parts)))
            if times < 1:
                continue
            offset = 0
            for n in parts:
                ranges.append((n, taken[n], taken[n] + times, sequences, offset))
                taken[n] += times
                left[n] -= times
                offset += n
            sequences += times
    return ranges, sequences


def _running(df: DataFrame, value: Column, group: list[str], out: str, salts: int) -> DataFrame:
    """Add the total of ``value`` over the rows before each one in its group.

    In two levels: within a hashed share of the group, and over the totals of
    the shares before it, so a hot group is numbered by many tasks.
    """
    df = df.withColumn("_v", value).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = Window.partitionBy(*group, "_salt").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    shares = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(*group, "_salt").agg(F.sum("_v").alias("_share")).select(
        *group, "_salt", F.coalesce(F.sum("_share").over(shares), F.lit(0)).alias("_base"))
    inside = df.withColumn("_inside", F.coalesce(F.sum("_v").over(before), F.lit(0)))
    return inside.join(bases, [*group, "_salt"]).withColumn(
        out, F.col("_base") + F.col("_inside")).drop("_v", "_salt", "_inside", "_base")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    NULL and empty texts are their end id alone. Equal rows are packed apart,
    and keys, NULL ones too, may repeat; other columns are ignored; an empty
    table gives no piece. Only documents cut by a window of the greedy part are
    tokenized a second time.
    """
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(token_counts(docs, key, text, window).select(
        F.monotonically_increasing_id().alias("_row"), "*"), "token-counts")
    rest = F.col("n") % window
    histogram = {r["r"]: r["c"] for r in counted.filter(rest > 0).groupBy(rest.alias("r")).agg(
        F.count("*").alias("c")).collect()}  # at most one row per length under the window
    ranges, combined = solve(histogram, window)
    in_ranges = dict.fromkeys(histogram, 0)
    for n, low, high, _, _ in ranges:
        in_ranges[n] += high - low
    stream = sum(n * (c - in_ranges[n]) for n, c in histogram.items())

    by_length: dict[int, list] = {n: [] for n in histogram}
    for n, *found in ranges:
        by_length[n].append(tuple(found))
    plan = spark.createDataFrame(
        list(by_length.items()), "r long, ranges array<struct<low: long, high: long, seq: long, off: long>>")
    rows = counted.withColumn("r", rest).withColumn("whole", F.floor(F.col("n") / window).cast("long"))
    rows = _running(rows, F.col("whole"), [], "first_whole", salts)
    ranked = _running(rows, F.lit(1).cast("long"), ["r"], "rank", salts)
    hit = F.get(F.filter("ranges", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"])), F.lit(0))
    placed = stored(
        ranked.join(F.broadcast(plan), "r", "left")  # one row per length
        .withColumn("hit", hit).drop("ranges"), "placed")

    tail = stream - stream % window
    marks, at = [], tail
    for bit in range(window.bit_length() - 1, -1, -1):
        if stream % window & 1 << bit:
            marks.append(at)
            at += 1 << bit
    marks = marks or [tail]
    stream_first = combined
    whole_first = combined + tail // window + len(marks)

    def piece(start, length, crc, seq, off) -> list[Column]:
        return [F.col("_id").alias(key), start.cast("long").alias("start"), length.cast("long").alias("length"),
                crc.cast("long").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                seq.cast("long").alias("sequence_id"), off.cast("long").alias("offset")]

    whole = (
        placed.filter("whole > 0").select("*", F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))))
        .select(*piece(F.col("pos") * window, F.lit(window), F.col("col"),
                       F.col("first_whole") + F.col("pos") + whole_first, F.lit(0))))
    last_crc = F.element_at("crcs", -1)
    fitted = placed.filter("r > 0 and hit is not null").select(*piece(
        F.col("whole") * window, F.col("r"), last_crc,
        F.col("hit.seq") + F.col("rank") - F.col("hit.low"), F.col("hit.off")))

    left = _running(placed.filter("r > 0 and hit is null"), F.col("r"), [], "at", salts)
    low, high = F.col("at"), F.col("at") + F.col("r")
    edges = F.array((F.floor(low / window) + 1) * window, *[F.lit(m) for m in marks])
    cuts = F.array_sort(F.array_distinct(F.filter(edges, lambda e: (e > low) & (e < high))))
    left = stored(left.withColumn("bounds", F.concat(F.array(low), cuts, F.array(high))), "left-over")
    p = F.col("p")
    mark = F.array_max(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= p))
    seq = F.when(p < tail, F.floor(p / window)).otherwise(
        tail // window + F.array_position(F.array(*[F.lit(m) for m in marks]), mark) - 1)
    off = F.when(p < tail, p % window).otherwise(p - mark)
    parts = left.select("*", F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("i", "p")).select(
        "*", (F.element_at("bounds", F.col("i") + 2) - p).alias("len"),
        (F.col("whole") * window + p - F.col("at")).alias("from"))
    uncut = parts.filter(F.size("bounds") == 2).select(
        *piece(F.col("from"), F.col("len"), last_crc, seq + stream_first, off))

    cut = stored(
        parts.filter(F.size("bounds") > 2).groupBy("_row", "_id", "n", "crcs", "sha").agg(
            F.collect_list(F.struct(
                F.col("from").alias("start"), F.col("len").alias("length"),
                (seq + stream_first).cast("long").alias("seq"), off.cast("long").alias("off"))).alias("pieces")), "cut")

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = token_ids(r["_text"])
                if len(ids) != r["n"] or _crcs(ids, window) != r["crcs"]:
                    raise ValueError("a text has changed while it was packed")
                for q in r["pieces"]:
                    crc = zlib.crc32(ids[q["start"]:q["start"] + q["length"]].tobytes())
                    out.append(r | q | {"crc": crc})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("_row", pa.int64()), b.schema.field("_id"), ("n", pa.int64()), ("start", pa.int64()),
                ("length", pa.int64()), ("crc", pa.int64()), ("seq", pa.int64()), ("off", pa.int64())]))

    kind = docs.schema[key].dataType.simpleString()
    # one row per cut text, looked up by key and digest, so rows that share a key do not meet each other
    wanted = cut.groupBy(F.col("sha").alias("_sha")).agg(F.min("_id").alias("_first"))
    texts = (
        docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("_text"), _digest(text).alias("sha"))
        .join(wanted.hint("merge"), F.col("_k").eqNullSafe(F.col("_first")) & (F.col("sha") == F.col("_sha")), "left_semi")
        .select("sha", "_text").dropDuplicates(["sha"]))
    again = (
        cut.join(texts.hint("merge"), "sha").mapInArrow(
            recount, f"_row long, _id {kind}, n long, start long, length long, crc long, seq long, off long")
        .select(*piece(F.col("start"), F.col("length"), F.col("crc"), F.col("seq"), F.col("off"))))
    return whole.unionByName(fitted).unionByName(uncut).unionByName(again)
