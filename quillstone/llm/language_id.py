"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (letters
only, lower case, words kept apart by spaces); a linear softmax over that
average gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A
part of the sample is held back to calibrate the probabilities (temperature).

A softmax tells the learned languages apart, but gives a text of none of them a
high score as well. So a text is rejected by how familiar its n-grams are: the
mean log share they have in the language they fit best, against what texts held
back reach and what n-grams drawn at random would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1600
LEAST_PER_LABEL = 4
BUCKETS = 1 << 13
DIM = 16
GRAMS = (2, 3, 4)
EPOCHS = 30
UNDETERMINED = "und"
CLEAN_SHARE = 0.001
TOWARDS_CHANCE = 0.2
SHORT = 300
UNSEEN = 1e-6
WINDOW_CHARS = 1 << 19
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    """``table`` holds the logits each bucket adds: embeddings times softmax weights.

    ``usual`` holds the log share of each bucket in each language, less its mean there.
    """

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    usual: np.ndarray
    familiar_from: float


def held_out(key: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def letters(text: str) -> str:
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def hashed(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram of bytes at every position."""
    h = np.full(len(data) - n + 1, 0x811C9DC5 + n, np.uint32)
    for i in range(n):
        h ^= data[i:len(data) - n + 1 + i]
        h *= np.uint32(0x01000193)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(letters(text).encode("utf-8", "ignore"), np.uint8)


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs in a text, as shares that add up to one."""
    data = _bytes(text)
    counts = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        if len(data) >= n:
            counts += np.bincount(hashed(data, n), minlength=BUCKETS)
    return (counts / max(counts.sum(), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def labelled_sample(
    docs: DataFrame, key: str, text: str, lang: str, size: int = SAMPLE,
) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Labels, features, label numbers and numbers of n-grams of a bounded sample of labelled texts.

    Every label is learned. Each gives the same number of rows, those least by a
    hash of id and text: ``size`` rows in all, or ``LEAST_PER_LABEL`` a label
    where that is more. Hashes are ranked without the texts and cut off in each
    task first; texts become bucket counts on the executors, so what reaches the
    driver is bounded by ``size``, the labels and the number of buckets,
    whatever the length of the texts.
    """
    order = F.xxhash64(F.col(key).cast("string"), text)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col(key))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("h"))
    labels_there = known.agg(F.count_distinct("lang")).first()[0]
    if not labels_there:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0, int)
    each = max(size // labels_there, LEAST_PER_LABEL)
    ranked = known.select("lang", "h").withColumn("r", F.rank().over(Window.partitionBy("lang").orderBy("h")))
    least = ranked.filter(F.col("r") <= each).select("lang", "h").distinct().collect()
    chosen = known.filter(F.col("h").isin([r["h"] for r in least]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            shares = [subwords(t) for t in b["text"]]
            found = [np.flatnonzero(s) for s in shares]
            yield pd.DataFrame({
                "lang": b["lang"], "h": b["h"], "n": [len(GRAMS) * len(_bytes(t)) for t in b["text"]],
                "at": [f.astype(np.uint16).tobytes() for f in found],
                "share": [s[f].tobytes() for s, f in zip(shares, found)]})

    rows = chosen.select("lang", "text", "h").mapInPandas(
        run, "lang string, h long, n long, at binary, share binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = sorted(rows.withColumn("r", first).filter(F.col("r") <= each).collect(), key=lambda r: (r["h"], r["lang"]))
    labels = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["share"], np.float32)
    return labels, x, np.array([labels.index(r["lang"]) for r in rows], int), np.array([r["n"] for r in rows], int)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def steadied(familiarity: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Familiarity drawn towards the usual, 0, for texts of few n-grams, where it varies by chance."""
    return familiarity * np.sqrt(n / (n + SHORT))


def train(labels: list[str], x: np.ndarray, y: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent on four fifths of the sample, calibration on the rest.

    Rejected are texts less familiar than a fifth of the way from nearly the
    least familiar calibration text (its quantile ``CLEAN_SHARE``) to n-grams
    drawn at random, and those whose score is under half of nearly the lowest
    calibration score or hardly over chance.
    """
    k = len(labels)
    if not k:
        none = np.zeros((BUCKETS, 0), np.float32)
        return Model([], none, np.zeros(0, np.float32), 1.0, 1.0, none, 0.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    aside, fit = order[:len(y) // 5], order[len(y) // 5:]
    aside = aside if len(aside) else fit
    scale = np.float32(np.sqrt(BUCKETS) / 4)  # averages are small; the step size is for values near one
    embed = (draw.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    weights, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    once = np.eye(k, dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(0.5 * (1 - epoch / EPOCHS))
        for batch in np.array_split(draw.permutation(fit), max(1, len(fit) // 32)):
            xb = x[batch] * scale
            hidden = xb @ embed
            wrong = (_softmax(hidden @ weights + bias) - once[y[batch]]) / len(batch)
            back = wrong @ weights.T
            weights -= rate * (hidden.T @ wrong)
            bias -= rate * wrong.sum(axis=0)
            embed -= rate * (xb.T @ back)
    table = (scale * (embed @ weights)).astype(np.float32)
    logits = x[aside] @ table + bias
    true = np.arange(len(aside)), y[aside]
    temperature = min(
        (float(-np.log(_softmax(logits / t)[true] + 1e-12).mean()), float(t)) for t in np.geomspace(0.2, 5, 40))[1]
    scores = _softmax(logits / temperature).max(axis=1)
    reject = max(0.5 * float(np.quantile(scores, 0.001)), min(0.9, 1.04 / k))

    usual = np.zeros((BUCKETS, k), np.float32)
    for c in range(k):
        own = x[fit[y[fit] == c]] if (y[fit] == c).any() else x[y == c]
        share = np.log(own.mean(axis=0) + UNSEEN)
        usual[:, c] = share - (own @ share).mean()
    clean = float(np.quantile(steadied((x[aside] @ usual).max(axis=1), n[aside]), CLEAN_SHARE))
    chance = float(usual.mean(axis=0).mean())
    return Model(labels, table, bias, temperature, reject, usual, clean + TOWARDS_CHANCE * min(chance - clean, 0.0))


def fit_language_model(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE,
) -> Model:
    return train(*labelled_sample(docs, key, text, lang, size))


def _judged(text: str, both: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean row of ``both`` over all n-grams of a text, and how many it has.

    One count per bucket, then one product: the cost of a long text does not
    depend on the number of labels.
    """
    data = _bytes(text)
    parts = [hashed(data, n) for n in GRAMS if len(data) >= n]
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS) if parts else np.zeros(BUCKETS, np.int64)
    at = np.flatnonzero(counts)
    return counts[at] @ both[at] / max(counts.sum(), 1), len(GRAMS) * len(data)


def _scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean logits of each text; and how usual it is in the language it is most usual in, 0 as usual, less stranger."""
    both = np.hstack([model.table, model.usual]).astype(np.float64)
    means, sizes = zip(*[_judged(t, both) for t in texts])
    k = len(model.labels)
    means = np.array(means)
    return means[:, :k] + model.bias, steadied(means[:, k:].max(axis=1), np.array(sizes))


def with_language(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the input row), ``held_out, lang_pred, score, rejected``: one row per input row.

    A text that is NULL or has no letter is ``und`` with score 0 and rejected;
    so is every text when nothing was learned. Equal scores go to the first
    label by name. Reads the text only; repeated rows are judged alike. Narrow;
    the model travels with the task, its size is a number per bucket and label,
    twice.
    """
    def judged(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        logits, familiar = _scores(texts, model)
        p = _softmax(logits / model.temperature)
        at = p.argmax(axis=1)
        strange = familiar < model.familiar_from
        return [model.labels[i] for i in at], p.max(axis=1), strange | (p.max(axis=1) < model.reject_below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            waiting, chars = [], 0
            for i, t in enumerate(b.column(2)):
                t = t.as_py()
                if model.labels and has_letter(t):
                    waiting.append((i, t))
                    chars += len(t)
                if waiting and (chars >= WINDOW_CHARS or i == b.num_rows - 1):
                    for (j, _), *result in zip(waiting, *judged([t for _, t in waiting])):
                        langs[j], scores[j], rejected[j] = result
                    waiting, chars = [], 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                ["row", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.struct("*").alias("row"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(
        run, f"row {rows.schema['row'].dataType.simpleString()}, held_out boolean, lang_pred string, "
        "score double, rejected boolean")


def identify_language(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, held_out, lang_pred, score, rejected`` of :func:`with_language`."""
    picked = docs.select(F.col(key).alias(key), F.col(text).alias(text))
    return with_language(picked, model, key, text).select(
        F.col("row")[key].alias(key), "held_out", "lang_pred", "score", "rejected")


def keep_known_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return with_language(docs, model, key, text).filter("not rejected").select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
