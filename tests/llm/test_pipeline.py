from collections import Counter

import corpus_pipeline
from quillstone.llm import language_id
from quillstone.llm.common import stored

from .test_dedup import brute_components, brute_exact
from .test_texts import check_packing



def brute_cut(rows, window=200):
    seen = Counter()
    for _, t in rows:
        data = t.encode()
        seen.update(data[i:i + window] for i in range(len(data) - window + 1))
    out = []
    for key, t in rows:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(data) - window + 1):
            if seen[data[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        out.append((key, bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_stages_equal_brute_force(shipped, documents, sf_dir):
    docs, rows = documents, [(r.doc_id, r.text) for r in documents.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(shipped, docs, sf_dir), name)
        assert docs.columns == documents.columns
        if name == "language_id":
            model = language_id.fit_language_model(documents)
            gone = {r.doc_id for r in language_id.identify_language(documents, model).filter("rejected").collect()}
            assert len(gone) < 3
            rows = [r for r in rows if r[0] not in gone]
        elif name == "exact_dedup":
            kept = {r[0] for r in brute_exact(rows) if r[3]}
            rows = [r for r in rows if r[0] in kept]
        elif name == "jaccard_join":
            kept = {i for i, _, component in brute_components(rows) if component == i}
            rows = [r for r in rows if r[0] in kept]
        else:
            rows = brute_cut(rows)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
    check_packing(rows, corpus_pipeline.STAGES[-1][1](shipped, docs, sf_dir))


def test_stages_messy(shipped, messy, empty, sf_dir):
    for start in (messy, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(shipped, docs, sf_dir), name)
            assert docs.columns == start.columns
        packed = corpus_pipeline.STAGES[-1][1](shipped, docs, sf_dir)
        assert (packed.count() > 0) == (start is messy)


def test_run(shipped, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "suffix_dedup", "packing"]
    assert corpus_pipeline.run(shipped, sf_dir).count() > 100



def least_of_each(rows, groups, *first):
    """Of the rows ``(id, text)`` with equal group: the least by what is in front, then by id, NULL first."""
    best = {}
    for i, (r, g) in enumerate(zip(rows, groups)):
        order = (*(f(r) for f in first), r[0] is not None, r[0], i)
        best[g] = min(best.get(g, order), order)
    return [rows[o[-1]] for o in best.values()]


def test_stages_repeated_keys(shipped, documents, sf_dir):
    base = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    a, b, c, d, e = [r for r in base if len(r[1]) > 600][:5]
    words = b[1].split()
    near = " ".join([*words[:-1], "zq"])
    more = [(a[0], a[1]), (a[0], a[1]), (c[0], b[1]), (d[0], near), *[(None, t) for t in (c[1], c[1], near, None, "")],
            *[(None, e[1] + " more")] * 3, (e[0], e[1] + " more"), *[(None, d[1][::-1])] * 3]
    docs = shipped.createDataFrame(
        base + [(*r, "en", "a") for r in more], "doc_id long, text string, lang string, source string")
    rows = [r[:2] for r in base] + more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language_id":
            judged = language_id.with_language(docs, language_id.fit_language_model(docs))
            gone = {r.text for r in judged.filter("rejected").select("row.text").collect()}
            rows = [r for r in rows if r[1] not in gone]
        elif name == "exact_dedup":
            assert max(Counter(rows).values()) > 2
            rows = least_of_each(rows, ["".join((t or "").split()) for _, t in rows], lambda r: -len(r[1]))
        elif name == "jaccard_join":
            found = brute_components(list(enumerate(t for _, t in rows)))
            rows = least_of_each(rows, [component for _, _, component in found])
        else:
            rows = brute_cut(rows)
        docs = stored(stage(shipped, docs, sf_dir), name)
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows), name
    assert dict(rows)[a[0]]
    check_packing(rows, corpus_pipeline.STAGES[-1][1](shipped, docs, sf_dir))
