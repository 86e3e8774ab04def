"""Language identification from character n-grams.

Training counts the n-grams of each labelled language; detection scores whole
texts by naive Bayes over those counts, hashed into a fixed number of buckets.
Scores are integers (micro-nats), so sums do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

GRAM = 3
SLICE = 1 << 16
SCALE = 1_000_000
BUCKETS = 1 << 15
BASE, PRIME = 1_000_003, 2_147_483_647
UNKNOWN = "unknown"


def slices(text: Column, n: int = GRAM, size: int = SLICE) -> Column:
    """The text cut into pieces that overlap by ``n - 1`` characters: no n-gram is lost or doubled."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size + n - 1}}})).{{1,{size}}}"), 1)


def grams(text: Column, n: int = GRAM) -> Column:
    """All overlapping character n-grams of a piece of text, in one linear pass."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), 1)


def gram_rows(docs: DataFrame, n: int, text: str, *keys: Column, outer: bool = False) -> DataFrame:
    """``keys, gram`` of every n-gram of the lower-cased visible texts; slice by slice, so memory is bounded."""
    explode = F.explode_outer if outer else F.explode
    visible = F.when(~is_blank(F.col(text)), F.lower(text))
    names = [docs.select(k).columns[0] for k in keys]
    pieces = docs.select(*keys, explode(slices(visible, n)).alias("_slice"))
    return pieces.select(*names, explode(grams(F.col("_slice"), n)).alias("gram"))


def language_profiles(
    docs: DataFrame, n: int = GRAM, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, gram, cnt``: every n-gram of each language, blank texts and unlabelled rows left out.

    Counting combines before its shuffle.
    """
    labelled = docs.filter(F.col(lang).isNotNull())
    return gram_rows(labelled, n, text, F.col(lang).alias("lang")).groupBy("lang", "gram").agg(
        F.count("*").alias("cnt"))


def bucket(gram: Column, n: int = GRAM, buckets: int = BUCKETS) -> Column:
    """The bucket of an n-gram: its code points as digits of a number, modulo a prime, then the number of buckets."""
    h = F.lit(0).cast("bigint")
    for i in range(1, n + 1):
        h = F.pmod(h * BASE + F.ascii(F.substring(gram, i, 1)), F.lit(PRIME))
    return F.pmod(h, F.lit(buckets)).cast("int")


def hashed_weights(
    profiles: DataFrame, n: int = GRAM, buckets: int = BUCKETS,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages in order, one integer log-probability per language and bucket, and which buckets are in use.

    Add-one smoothing over the buckets in use. At most a row per language and
    bucket comes to the driver, whatever the number of n-grams. Pass a stored
    profile table, not a training plan, which would run again here.
    """
    def weight(count: Column) -> Column:
        return F.round(F.log(count / F.col("size").cast("double")) * SCALE).cast("bigint")

    counts = profiles.groupBy("lang", bucket(F.col("gram"), n, buckets).alias("bucket")).agg(F.sum("cnt").alias("cnt"))
    used = counts.agg(F.count_distinct("bucket")).first()[0]
    sizes = counts.groupBy("lang").agg((F.sum("cnt") + used).alias("size"))
    absent = sizes.select("lang", weight(F.lit(1.0)).alias("w")).orderBy("lang").collect()
    rows = counts.join(sizes, "lang").select("lang", "bucket", weight(F.col("cnt") + 1).alias("w")).toArrow()
    langs = [r.lang for r in absent]
    weights = np.repeat(np.array([r.w for r in absent], np.int32)[:, None], buckets, axis=1)
    place = {lang: i for i, lang in enumerate(langs)}
    at = rows.column("bucket").to_numpy()
    weights[[place[lang] for lang in rows.column("lang").to_pylist()], at] = rows.column("w").to_numpy()
    known = np.zeros(buckets, np.int32)
    known[at] = 1
    return langs, weights, known


def detect_language(
    docs: DataFrame, profiles: DataFrame, n: int = GRAM, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """``key, detected_language``, a row for every document.

    Every task holds the weights, an array of a fixed number of buckets per
    language, and scores its texts in place: no row per n-gram, no join, no
    shuffle, and a plan of the same size for any number of languages. Blank texts
    and texts whose n-grams are all in unused buckets are ``unknown``; equal
    scores go to the first language by name. Sums of whole numbers, so exact.
    """
    langs, weights, known = hashed_weights(profiles, n, buckets)
    tables, names = [*weights, known], np.array([*langs, UNKNOWN], object)
    base, prime, step, room = BASE, PRIME, SLICE, 1 << 20

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, pieces, owners, waiting = np.zeros((len(tables), b.num_rows), np.int64), [], [], 0

            def add() -> None:
                points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                ends = np.cumsum([len(p) for p in pieces])
                grams = max(len(points) - n + 1, 0)
                h = np.zeros(grams, np.int64)
                for i in range(n):
                    h = (h * base + points[i:i + grams]) % prime
                h %= buckets
                first = np.minimum(np.append(0, ends[:-1]), grams)
                last = np.clip(ends - n + 1, first, grams)
                for row, table in enumerate(tables):
                    upto = np.concatenate([[0], np.cumsum(table[h], dtype=np.int64)])
                    np.add.at(sums[row], owners, upto[last] - upto[first])

            for row, t in enumerate(b.column(1).to_pylist()):
                for begin in range(0, len(t or ""), step):
                    pieces.append(t[begin:begin + step + n - 1])
                    owners.append(row)
                    waiting += len(pieces[-1])
                    if waiting > room:
                        add()
                        pieces, owners, waiting = [], [], 0
            if pieces:
                add()
            best = sums[:-1].argmax(axis=0) if langs else np.zeros(b.num_rows, np.int64)
            found = names[np.where(sums[-1] > 0, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["_key", "detected_language"])

    visible = F.when(~is_blank(F.col(text)), F.lower(text))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), visible.alias("_text")).mapInArrow(
        score, f"_key {kind}, detected_language string").withColumnRenamed("_key", key)
