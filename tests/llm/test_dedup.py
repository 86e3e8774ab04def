import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import exact_dedup, jaccard, suffix_dedup
from quillstone.llm.common import recorded
from quillstone.llm.components import components
from quillstone.llm.rolling import prefix_hashes, span_hashes

from .conftest import LONG, MESSY, by_row


def random_texts(seed, n=60, alphabet="ab cd\n"):
    """Texts with copies, near copies and shared passages."""
    draw = random.Random(seed)
    passage = "".join(draw.choice(alphabet) for _ in range(420))
    out = []
    for i in range(n):
        t = "".join(draw.choice(alphabet + "efgh") for _ in range(draw.randrange(0, 700)))
        kind = i % 5
        if kind == 1:
            cut = draw.randrange(0, 200)
            t = t[:50] + passage[cut:cut + draw.randrange(190, 420)] + t[50:]
        elif kind == 2 and out:
            t = draw.choice(out)
        elif kind == 3 and out and out[-1]:
            base, at = out[-1], draw.randrange(len(out[-1]))
            t = base[:at] + "X" + base[at:]
        out.append(t)
    return out + ["q" * 700, "é" * 150, "pq" * 300]


# Exact duplicates


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i))
    out = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[plain])[2]
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=lambda t: [(v is not None, v) for v in t])


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups_messy(messy):
    assert by_row(exact_dedup.exact_groups(messy), *COLUMNS) == brute_exact([r[:2] for r in MESSY])


def test_exact_groups_narrow_digits(shipped):
    rows = list(enumerate(random_texts(3)))
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert by_row(exact_dedup.exact_groups(df, first_digit=1, growth=2), *COLUMNS) == brute_exact(rows)


def test_drop_exact_copies(messy, empty):
    kept = exact_dedup.drop_exact_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(
        str(i) for i in [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, None] if i not in (3, 4))
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.drop_exact_copies(empty).collect() == []


# Jaccard join


def brute_sets(rows):
    sets = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    return sets


def brute_components(rows):
    sets, up = brute_sets(rows), {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets))


def near_copies(seed, words=60, families=4, each=30):
    """Families of near copies around the threshold, in chains and stars."""
    draw = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{draw.randrange(5000)}" for _ in range(words + 40 * f)]
        for k in range(each):
            w = list(base if k % 3 else (rows[-1][1].split() if k else base))
            for _ in range(draw.randrange(0, 3)):
                w[draw.randrange(len(w))] = f"x{draw.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 8), (5, 8)])
def test_jaccard_brute_force(shipped, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)  # small blocks split every family
    rows = near_copies(seed)
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    got = by_row(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows)


def test_jaccard_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = by_row(jaccard.jaccard_components(documents), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows)


def test_jaccard_messy(messy, empty):
    got = by_row(jaccard.jaccard_components(messy), "doc_id", "component_id")
    assert got == sorted([(None, None), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7),
                          (9, 9), (10, 10), (11, 10), (12, 12)], key=lambda t: [(v is not None, v) for v in t])
    kept = jaccard.keep_one_of_each(messy)
    assert kept.columns == messy.columns and kept.count() == 10
    assert jaccard.jaccard_components(empty).collect() == []


def test_jaccard_keys_of_other_types(shipped, documents):
    """Keys that are texts give the components of the numbers they stand for, named by the least text."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    named = shipped.createDataFrame([(f"k{i:09d}", t) for i, t in rows] + [(None, "one two"), (None, None)],
                                    "doc_id string, text string")
    want = [(f"k{i:09d}", n, f"k{c:09d}") for i, n, c in by_row(
        jaccard.jaccard_components(documents), "doc_id", "n_shingles", "component_id")]
    got = by_row(jaccard.jaccard_components(named), "doc_id", "n_shingles", "component_id")
    assert got == sorted([*want, (None, 0, None), (None, 1, None)], key=lambda t: [(v is not None, v) for v in t])


def test_jaccard_visitors_in_several_parts(shipped, documents, monkeypatch):
    """Blocks of few shingles, so that homes and visitors are split, give the same components."""
    columns = ("doc_id", "n_shingles", "component_id")
    want = by_row(jaccard.jaccard_components(documents), *columns)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)
    assert by_row(jaccard.jaccard_components(documents), *columns) == want


def test_shingle_windows(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000)) + " " + "y" * 3000 + " a b c d"
    whole = jaccard.shingles(text)
    for size in (64, 501, 4096):
        monkeypatch.setattr(jaccard, "WINDOW_BYTES", size)
        assert np.array_equal(jaccard.shingles(text), whole)
    assert len(whole) == len(brute_sets([(0, text)])[0])


@pytest.mark.parametrize("n", [1, 2, 5, 13, 20, 41, 250, 1000])
def test_prefix_bound(n):
    """Sets that just link share enough of their rarest tokens."""
    draw = random.Random(n)
    for _ in range(50):
        m = draw.randrange(n, n * 100 // 85 + 1)
        common = -(-85 * (n + m) // 185)
        if common > n:
            continue
        a = set(draw.sample(range(10 ** 6), n))
        b = set(draw.sample(sorted(a), common)) | set(range(2 * 10 ** 6, 2 * 10 ** 6 + m - common))
        order = {t: draw.random() for t in a | b}
        head = [set(sorted(s, key=order.get)[:len(s) - jaccard.least_overlap(len(s)) + jaccard.in_common(len(s))])
                for s in (a, b)]
        smaller = jaccard.least_overlap(n)
        assert len(head[0] & head[1]) >= min(2 + smaller // 20, jaccard.least_overlap(smaller))


# Suffix dedup


def brute_repeats(rows, window):
    seen = collections.Counter()
    for _, t in rows:
        data = (t or "").encode()
        seen.update(data[i:i + window] for i in range(len(data) - window + 1))
    out = []
    for key, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if seen[data[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda t: [(v is not None, v) for v in t])


REPEATS = ("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_brute_force(shipped, seed):
    rows = list(enumerate(random_texts(seed)))
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert by_row(suffix_dedup.remove_repeats(df), *REPEATS) == brute_repeats(rows, 200)


def test_repeats_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert by_row(suffix_dedup.remove_repeats(documents), *REPEATS) == brute_repeats(rows, 200)


def test_repeats_messy(shipped, messy, empty):
    short = messy.filter("doc_id is null or doc_id not in (7, 8)")
    rows = [r[:2] for r in MESSY if r[0] not in (7, 8)]
    assert by_row(suffix_dedup.remove_repeats(short), *REPEATS) == brute_repeats(rows, 200)
    long = suffix_dedup.drop_repeats(messy)
    assert long.columns == messy.columns and long.count() == len(MESSY)
    assert [r.text for r in long.filter("doc_id in (7, 8)").collect()] == ["", ""]
    assert suffix_dedup.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("window", [32, 64, 400, 3000])
def test_repeats_of_other_windows(shipped, window):
    draw = random.Random(window)
    passage = "".join(draw.choice("ab cd\n") for _ in range(3 * window))
    rows = []
    for i in range(40):
        t = "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(0, 3 * window)))
        cut = draw.randrange(0, window)
        rows.append((i, t + passage[cut:cut + draw.randrange(window - 20, 2 * window)] + t[:20] if i % 3 else t))
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert by_row(suffix_dedup.remove_repeats(df, window=window), *REPEATS) == brute_repeats(rows, window)


@pytest.mark.parametrize("window", [31, 65_536])
def test_windows_have_bounds(documents, window):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents, window=window)


def test_equal_ids_and_texts_are_rows_of_their_own(shipped):
    """Rows are numbered, so neither equal rows nor hashes that collide can get each other's stretches."""
    a, b = "".join(map(chr, range(97, 122))) * 12, "0123456789" * 30
    rows = [(1, a), (1, a), (1, b), (None, b), (None, "short"), (None, "short")]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert by_row(suffix_dedup.remove_repeats(df), *REPEATS) == brute_repeats(rows, 200)


def test_a_passage_of_very_many_copies(shipped):
    """It comes to the merge once from each run, and all its positions are cut."""
    passage = " ".join(f"every{i}" for i in range(40))
    rows = [(i, f"{passage} own{i}x{i * i}", "en", "src0", 0) for i in range(20_000)]
    rows += [(20_000 + i, f"{i * 7919} alone {i}", "en", "src0", 0) for i in range(100)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    out = {r.row.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    shared = len(passage) + len(" own")
    for i, text, *_ in rows:
        n, spans = out[i]
        # beyond the passage, texts may share the first digits of their own words
        assert (shared <= n <= len(text) - 1 and spans == 1) if i < 20_000 else (n, spans) == (0, 0)


def test_positions_of_repeated_entries():
    import pyarrow as pa
    times, where = np.array([1, 3, 2], "<u4"), np.array([[i, 10 * i] for i in range(6)], "<i8")
    batch = pa.RecordBatch.from_pydict({
        "times": [times.tobytes()], "where": [where.tobytes()],
        "repeated": [np.array([[2, 250], [1, 200]], "<i8").tobytes()]})
    (made,) = suffix_dedup._positions(iter([batch]))
    assert made.to_pydict() == {"_key": [1, 2, 3, 4, 5], "begin": [10, 20, 30, 40, 50], "reach": [200] * 3 + [250] * 2}


def test_nothing_but_what_the_result_reads_is_left_behind(shipped, documents):
    tables = len(shipped.catalog.listTables())
    with recorded() as places:
        out = suffix_dedup.remove_repeats(documents)
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in places) == ["repeats", "rows"]
    assert out.count() == documents.count() and len(shipped.catalog.listTables()) == tables


def test_long_text_blocks(monkeypatch):
    data = np.frombuffer((LONG[:40_000] + LONG[-9_000:]).encode(), np.uint8)
    whole = suffix_dedup.blocks(data)[1:]
    monkeypatch.setattr(suffix_dedup, "_LOW", np.uint64((1 << 12) - 1))
    cut = suffix_dedup.blocks(data)[1:]
    assert sum(len(a) for a in whole) and cut[0][0] == 0 and whole[1][-1] == cut[1][-1] == len(data) - 200


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60), st.integers(0, 60))
def test_shared_prefix(a, b, n):
    a = b[:n] + a
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert suffix_dedup.shared_prefix(a, b) == want == suffix_dedup.shared_prefix(a, b, want // 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=9).map(str.encode), max_size=12), max_size=7))
def test_loser_tree(lists):
    runs = [sorted(set(r)) for r in lists]
    coded = [suffix_dedup.Run(iter([(n, x, None) for n, x in zip(*suffix_dedup.front_code(r))])) for r in runs]
    merged = [(known, text) for known, text, _ in suffix_dedup.merge_runs(coded)]
    assert [t for _, t in merged] == sorted(x for r in runs for x in r)
    assert all(k == suffix_dedup.shared_prefix(a, t) for (_, a), (k, t) in zip(merged, merged[1:]))


def test_span_hashes():
    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    p = prefix_hashes(data)
    h = span_hashes(p, np.array([0, 3, 9, 6]), np.array([3, 6, 12, 9]))
    assert h[0] == h[1] == h[2] != h[3]


def test_components_shapes(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, None)]
    draw.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
