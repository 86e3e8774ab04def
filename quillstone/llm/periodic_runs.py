"""Periodic runs of words, from Lyndon arrays by the first phase of a grouping suffix sorter.

A run is a maximal stretch that repeats with a period at most half its length.
Every run holds a Lyndon root: under one of the two orders of the words, the
longest Lyndon word that starts at some place of the run has the run's period.
So the longest Lyndon words of all places under both orders, each extended to
both sides as far as words one period apart agree, give all runs.

The longest Lyndon words come straight from phase one of Baier's linear suffix
sorting (2016): suffixes are grouped by a common prefix, and the groups are taken
from the greatest down. The suffixes of a group are credited to the nearest
places before them whose groups are still smaller; those places move up, each
prefix grown by as many copies of the group's prefix as follow it. When a group
is taken, its prefix is the longest Lyndon word of its places.

Only stretches whose words lie in repeated 6-grams of the text go through that:
a run of 12 words or more is covered by such 6-grams, so this leaves none out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, utf8
from .rolling import mix

LEAST = 12
GRAM = LEAST // 2
BLOCK_WORDS = 1 << 19
GAP = np.uint64(0xD1B54A32D192ED03)


def lyndon_lengths(word: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; smaller numbers come first.

    Phase one of the suffix sorter. Groups are linked from the least to the
    greatest. ``up`` leads from a place that was taken to the place before it, so
    that following it finds the nearest place still waiting; paths are halved on
    the way.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(word[order]) != 0)) if n else np.zeros(0, np.int64)
    members = [part.tolist() for part in np.split(order, first[1:])] if n else []
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(len(members)), np.diff(np.append(first, n)))
    group = group.tolist()
    size = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    up = list(range(n + 1))  # of place i at i + 1; 0 stands before the text
    lengths = [0] * n
    taken = len(members) - 1
    while taken >= 0:
        here, length = [i for i in members[taken] if group[i] == taken], size[taken]
        members[taken] = None
        for i in here:
            lengths[i] = length
            up[i + 1] = i
        copies: dict[int, int] = {}
        for i in here:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            if i:
                copies[i - 1] = copies.get(i - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, times in copies.items():
            moved.setdefault((group[i], times), []).append(i)
        # next above the group they leave, the more copies the higher
        for old, times in sorted(moved, reverse=True):
            new, over = len(members), above[old]
            members.append(moved[old, times])
            size.append(size[old] + times * length)
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for i in moved[old, times]:
                group[i] = new
        taken = below[taken]
    return np.array(lengths, np.int64)


class Names:
    """Equal numbers for equal blocks of 1, 2, 4, ... words: longest common extensions, exact."""

    def __init__(self, word: np.ndarray, longest: int) -> None:
        self.n, self.level = len(word), [np.unique(word, return_inverse=True)[1]]
        size = 1
        while 2 * size <= longest:
            last = self.level[-1]
            pair = last[:-size] * (self.n + 1) + last[size:]
            self.level.append(np.unique(pair, return_inverse=True)[1])
            size *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the words from ``i`` and from ``j`` on agree; ``i < j``."""
        at = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            last = len(self.level[k]) - 1
            same = (j + at <= last) & (self.level[k][np.minimum(i + at, last)] == self.level[k][np.minimum(j + at, last)])
            at += same.astype(np.int64) << k
        return at

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words in front of ``i`` and of ``j`` agree; ``i < j``."""
        at = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            x, y, last = i - at - (1 << k), j - at - (1 << k), len(self.level[k]) - 1
            same = (x >= 0) & (self.level[k][np.clip(x, 0, last)] == self.level[k][np.clip(y, 0, last)])
            at += same.astype(np.int64) << k
        return at


def runs_of(word: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` rows of all runs of at least ``least`` words and two periods.

    Negative numbers are borders; each must be met once only, so no run holds one.
    """
    inner = np.flatnonzero(word >= 0)
    if not len(inner):
        return np.zeros((0, 3), np.int64)
    top, borders = word[inner].max(), np.flatnonzero(word < 0)
    names = Names(word, int(np.diff(np.concatenate([[-1], borders, [len(word)]])).max()) - 1)
    # one of a place's two roots is often the other as well
    roots = [lyndon_lengths(ranks)[inner] for ranks in (word, np.where(word >= 0, top - word, word))]
    period = np.concatenate([roots[0], np.where(roots[1] == roots[0], len(word), roots[1])])
    i = np.concatenate([inner, inner])
    fits = i + period < len(word)
    i, period = i[fits], period[fits]
    begin = i - names.back(i, i + period)
    length = i + period + names.ahead(i, i + period) - begin
    long = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([begin[long], length[long], period[long]], 1), axis=0)


def repeated_stretches(word: np.ndarray, begins: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First and next place of the stretches of each text that its repeated n-grams cover, two n-grams at least.

    ``begins`` are the first places of the texts. Hashes of 64 bits choose them:
    equal ones by chance only make a stretch longer.
    """
    n = len(word)
    text = np.zeros(n, np.int64)
    np.add.at(text, begins[begins < n], 1)
    text = np.cumsum(text)
    if n < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.append(True, text[1:] != text[:-1])
    h = mix(text[:n - gram + 1].astype(np.uint64))
    for k in range(gram):
        h = mix(h + word[k:n - gram + 1 + k].astype(np.uint64) * GAP)
    at = np.flatnonzero(text[:n - gram + 1] == text[gram - 1:])
    at = at[np.argsort(h[at], kind="stable")]
    same = np.concatenate([[False], h[at][1:] == h[at][:-1], [False]])
    met = at[same[:len(at)] | same[1:len(at) + 1]]
    cover = np.zeros(n + 1, np.int64)
    cover[met] += 1
    cover[met + gram] -= 1
    covered = np.append(np.cumsum(cover)[:n] > 0, False)
    lo = np.flatnonzero(covered[:n] & (starts | np.append(False, ~covered[:n - 1])))
    hi = np.flatnonzero(covered[:n] & (~covered[1:] | np.append(starts[1:], True))) + 1
    long = hi - lo >= 2 * gram
    return lo[long], hi[long]


def find_runs(word: np.ndarray, begins: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` rows of the runs of all texts laid one behind the other."""
    lo, hi = repeated_stretches(word, begins, least // 2)
    if not len(lo):
        return np.zeros((0, 3), np.int64)
    # the stretches, a border behind each
    size = hi - lo + 1
    ends = np.cumsum(size)
    place = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
    joined = word[np.minimum(place, len(word) - 1)].astype(np.int64)
    joined[ends - 1] = -1 - np.arange(len(lo))
    runs = runs_of(joined, least)
    runs[:, 0] = place[runs[:, 0]]
    return runs


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _block(texts: list[bytes], least: int) -> tuple[list[int], list[list], list[bytes]]:
    """Number of words, runs and collapsed text of each text."""
    words, numbers = [t.split() for t in texts], _Numbers()
    counts = [len(w) for w in words]
    begins = np.cumsum([0, *counts])
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, begins[-1])
    runs = find_runs(word, begins[:-1], least)
    of = np.searchsorted(begins, runs[:, 0], "right") - 1
    cut = np.zeros(len(word) + 1, np.int64)
    np.add.at(cut, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cut, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cut) == 0
    found: list[list] = [[] for _ in texts]
    for text, (start, length, period) in zip(of.tolist(), runs.tolist()):
        found[text].append({"start": start - int(begins[text]), "length": length, "period": period})
    collapsed = []
    for text, ws in enumerate(words):
        if found[text]:
            ws = compress(ws, kept[begins[text]:begins[text + 1]].tolist())
            found[text].sort(key=lambda r: (r["start"], r["period"]))
        collapsed.append(b" ".join(ws))
    return counts, found, collapsed


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``key, n_words, runs, collapsed``: one row per input row.

    Words are what ASCII white space parts. ``runs`` are all maximal stretches of
    at least ``least`` words that repeat with a smallest period of at most half
    their length: ``start`` (a word number from 0), ``length`` and ``period``, by
    start, then period. ``collapsed`` is the text without the words that any run
    holds behind its first period, joined by one space. NULL and blank texts have
    no words, no runs and an empty collapsed text. Narrow: keys may be NULL or
    repeat, rows that repeat are answered alike, other columns are ignored, an
    empty table gives an empty result. A task works on about ``block_words``
    words at a time, or one longer text.
    """
    if least < 4:
        raise ValueError("runs of fewer than 4 words are not looked for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, begin, block, size = b.column(1), 0, [], 0
            for row in range(b.num_rows):
                block.append(texts[row].as_py())
                size += len(block[-1]) // 4
                if size > block_words or row == b.num_rows - 1:
                    made = [pa.array(c, kind) for c, kind in zip(_block(block, least), kinds)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(block)), *made], names)
                    begin, block, size = row + 1, [], 0

    names = ["_id", "n_words", "runs", "collapsed"]
    run_kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    kinds = [pa.int64(), pa.list_(run_kind), pa.string()]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), utf8(text_or_empty(text)).alias("_text")).mapInArrow(
        run, f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    ).withColumnRenamed("_id", key)
