"""Lyndon arrays and runs against their definitions, and the query against its own steps one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillstone.llm import periodic_runs, queries
from quillstone.llm.periodic_runs import find_runs, lyndon_lengths, repeated_stretches, runs_of

from .conftest import CLASHES


def longest_lyndon(w):
    out = []
    for i in range(len(w)):
        out.append(max(j - i for j in range(i + 1, len(w) + 1)
                       if all(w[i:j] < w[k:j] for k in range(i + 1, j))))
    return out


def all_runs(w, least=12):
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            begin = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i + p - begin
            if n >= max(least, 2 * p) and not any(
                    all(w[k] == w[k + q] for k in range(begin, begin + n - q)) for q in range(1, p)):
                found.add((begin, n, p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_like(rnd, letters, most=45):
    w = [rnd.randint(0, rnd.randint(0, letters)) for _ in range(rnd.randint(0, most))]
    if w and rnd.random() < 0.6:
        a, p = rnd.randrange(len(w)), rnd.randint(1, 9)
        w = [w[i] if i < a else w[a + (i - a) % min(p, len(w) - a)] for i in range(len(w))]
    return w


def test_lyndon_lengths():
    rnd = random.Random(1)
    for _ in range(1500):
        w = [rnd.randint(0, rnd.randint(0, 3)) for _ in range(rnd.randint(0, 13))]
        assert lyndon_lengths(np.array(w, np.int64)).tolist() == longest_lyndon(w)
    assert lyndon_lengths(np.zeros(5000, np.int64)).tolist() == [1] * 5000
    assert lyndon_lengths(np.arange(5000)).tolist() == list(range(5000, 0, -1))


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_of_many_texts(least):
    rnd = random.Random(least)
    for _ in range(700):
        texts = [words_like(rnd, rnd.randint(1, 5)) for _ in range(rnd.randint(1, 4))]
        begins = np.cumsum([0] + [len(w) for w in texts])
        got = find_runs(np.array(sum(texts, []), np.int64), begins[:-1], least)
        want = [(s + int(begins[i]), n, p) for i, w in enumerate(texts) for s, n, p in all_runs(w, least)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_all_runs_of_one_text_without_a_filter():
    rnd = random.Random(9)
    for _ in range(500):
        w = words_like(rnd, 2)
        assert list(map(tuple, runs_of(np.array(w, np.int64), 2).tolist())) == sorted(all_runs(w, 2))


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    got = find_runs(np.array(b, np.int64), np.array([0]), 12)
    assert sorted(map(tuple, got.tolist())) == sorted(all_runs(b)) and len(got) > 20


def test_texts_without_repeats_are_left_alone():
    lo, hi = repeated_stretches(np.arange(1000), np.array([0, 400]))
    assert len(lo) == len(hi) == 0
    # the same six words in two texts are no repeat
    lo, _ = repeated_stretches(np.array(list(range(12)) * 2), np.array([0, 12]))
    assert len(lo) == 0


def expected(doc_id, text):
    """The contract, step by step, on the words themselves."""
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def answers(shipped, tmp_path, rows):
    docs = shipped.createDataFrame([(i, t, None, None) + ("x",) * len(CLASHES) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op12_periodic_runs"](shipped, str(tmp_path))
    assert out.columns[:len(COLUMNS)] == list(COLUMNS)
    return sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)


def test_query_equals_its_definition(shipped, tmp_path):
    rnd = random.Random(12)
    rows = [(i, rnd.choice([" ", "\n", " \t\x0b"]).join("w%d" % x for x in words_like(rnd, 6, 120))) for i in range(300)]
    rows += [(i, " ".join(rnd.choice("é ß 日 a b".split()) for _ in range(rnd.randint(0, 60)))) for i in range(300, 500)]
    rows += [(None, "a " * 30), (None, "a " * 30), (501, None), (502, ""), (503, " \n "), (504, "x " * 500),
             (504, "x " * 500), (505, "a\xa0a " * 13), (506, "a b " * 6), (507, "a b " * 5 + "a")]
    assert answers(shipped, tmp_path, rows) == sorted((expected(*r) for r in rows), key=str)


def test_messy_and_empty(shipped, tmp_path, messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect() if len(r.text or "") < 1000]
    assert answers(shipped, tmp_path, rows) == sorted((expected(*r) for r in rows), key=str)
    assert periodic_runs.periodic_runs(empty).collect() == []
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(messy).filter("doc_id in (4, 7)").collect()}
    assert (out[4].n_words, out[4].runs, out[4].collapsed) == (0, [], "")
    assert [(r.start, r.length, r.period) for r in out[7].runs] == [(0, 45_000, 5)]
    assert out[7].collapsed == "lorem ipsum dolor sit amet " + "z" * 50_000


def test_block_size_changes_nothing(documents):
    docs = documents.limit(150)  # a small fixture: the sizes of blocks are what is tested
    whole = sorted(periodic_runs.periodic_runs(docs).collect(), key=lambda r: r.doc_id)
    assert whole == sorted(periodic_runs.periodic_runs(docs, block_words=50).collect(), key=lambda r: r.doc_id)
    for r in whole:
        assert [(x.start, x.length, x.period) for x in r.runs] == [] or r.n_words >= 12


def test_least_is_bounded(documents):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(documents, least=3)
