"""The divergence audit against its definition in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillstone.llm import divergence
from quillstone.llm.divergence import source_divergence

from .conftest import CLASHES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def expected(rows, min_docs=10, top=10):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        met = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in met.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, ts in mine:
            counts[source].update(t for t in ts if met[t] >= min_docs)
        whole = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pair = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            term = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)}
    return out


def answers(shipped, rows, **more):
    docs = shipped.createDataFrame([(1, *r) + ("x",) * len(CLASHES) for r in rows], SCHEMA)
    out = source_divergence(docs, **more).collect()
    found = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out}
    assert len(found) == len(out)
    return found


def corpus(seed, n, langs, sources, words):
    rnd = random.Random(seed)
    return [(" ".join(rnd.choice(words)[:rnd.randint(1, 4)] for _ in range(rnd.randint(0, 12))),
             rnd.choice(langs), rnd.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_its_definition(shipped, monkeypatch, block):
    monkeypatch.setattr(divergence, "TERM_BLOCK", block)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    words = ["Aaa", "aab", "éé", "日本", "b-b", "x1y", "ZZ", "😀", "Élan"]
    rows = corpus(1, 260, ["a", "b", None], ["s", "t", "u", "v", None], words)
    rows += [(None, "a", "only null"), ("", "a", "only empty"), ("12 !", "few", "s"), ("aaa " * 50, "few", "t")]
    rows += [("hot hot", "a", "s")] * 100  # one source with many equal rows
    assert answers(shipped, rows) == expected(rows)


def test_bounds_are_parameters(shipped):
    rows = corpus(2, 120, ["a"], ["s", "t"], ["aaa", "bbb", "ccc", "ddd"])
    assert answers(shipped, rows, min_docs=3, top=2) == expected(rows, 3, 2)


def test_no_kept_terms(shipped):
    rows = [(f"w{chr(97 + i)}", "a", "s" if i % 2 else "t") for i in range(20)]
    assert answers(shipped, rows) == expected(rows) == {
        ("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)}


def test_messy_and_empty(messy, empty):
    rows = [tuple(r) for r in messy.select("text", "lang", "source").collect()]
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_divergence(messy, min_docs=2).collect()}
    assert out == expected(rows, 2)
    assert source_divergence(empty).collect() == []


def test_counts_beyond_a_long(shipped):
    """10^9 times a count needs more than 64 bits; the shares stay exact."""
    row = shipped.range(1).select(divergence._share(
        divergence.F.lit(10**15 + 7), divergence.F.lit(3 * 10**15), divergence.F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 9) // (3 * 10**15 + 22)
