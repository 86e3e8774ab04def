import hashlib
import sys
import zlib
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillstone.llm import queries, sharding, url_filter

from .conftest import MESSY

sys.path.insert(0, ".")
import check_oracle  # noqa: E402


# SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(shipped, sf_dir, name):
    con = check_oracle.connect(sf_dir)
    assert check_oracle.compare(shipped, con, name, sf_dir) == ""


# URLs


def page(i, url, html="<p>x</p>"):
    return i, url, html, "x", "x", "x"


SCHEMA = "page_id long, url string, html string, host string, verdict string, alias_of string"


def verdicts(spark, rows, **more):
    out = url_filter.url_verdicts(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_rules(shipped):
    out = verdicts(shipped, [
        page(1, "HTTP://Sub.Example.ORG/es/1?q"), page(2, "http://example.org/en/1#x"), page(3, "http://example.org/en/2"),
        page(4, "http://a.com/fr/"), page(5, "http://a.com/de/x"), page(6, "http://notcom/de/"), page(7, None),
        page(8, "no scheme"), page(9, "x://com/de/"), page(10, "http://badexample.org/es/1"), page(11, ""),
        page(12, "a://b?c://com/de/"), page(13, "http://ÄB.com/de/")])
    assert out == {
        1: ("sub.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/1", "example.org/en/1", "block"),
        3: ("example.org", "/en/2", "org/", "allow"), 4: ("a.com", "/fr/", "com/fr/", "allow"),
        5: ("a.com", "/de/x", "com/de/", "block"), 6: ("notcom", "/de/", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("com", "/de/", "com/de/", "block"), 10: ("badexample.org", "/es/1", "org/", "allow"),
        11: ("", "", None, "allow"), 12: ("b", "", None, "allow"), 13: ("Äb.com", "/de/", "com/de/", "block")}


def test_aliases(shipped):
    link = '<LINK href="{}" rel=canonical>'.format
    refresh = "<meta content='0; URL={}' http-equiv=\"refresh\">".format
    rows = [
        page(1, "http://x.net/1", link("http://x.net/2")), page(2, "http://x.net/2", refresh("//a.com/de/9")),
        page(3, "https://x.net/1/#top"), page(4, "http://x.net/4", link("/1")), page(5, "http://x.net/5"),
        page(6, "http://ok.org/", link("http://x.net/1")), page(7, "http://x.net/7", link("next")),
        page(8, "http://x.net/8", "<link" * 50_000), page(9, "http://z.net/9", None)]
    hops = shipped.createDataFrame([("http://x.net/5", "http://y.net/"), ("http://y.net", "http://ok.org/"),
                                    (None, "http://a.com/de/")], "src string, dst string")
    plain = {k: v[3] for k, v in verdicts(shipped, rows).items()}
    assert plain == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    more = {k: v[3] for k, v in verdicts(shipped, rows, redirects=hops).items()}
    assert more == plain | {5: "block"}  # and the rule that allows 6 still stands
    assert url_filter.url_verdicts(shipped.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("target, want", [
    ("2", "http://x.net/a/2"), ("../2?p=1&amp;q=2#z", "http://x.net/2?p=1&q=2#z"), ("./b/./c/../d/", "http://x.net/a/b/d/"),
    ("?p=1", "http://x.net/a/1?p=1"), ("#top", "http://x.net/a/1?old"), ("/r", "http://x.net/r"), ("//y.org/2", "http://y.org/2"),
    ("HTTPS://y.org/2", "HTTPS://y.org/2"), ("mailto:a@b", None), ("..", "http://x.net/"), ("../../../up", "http://x.net/up"),
    ("b/..", "http://x.net/a/"), ("", None), ("next", "http://x.net/a/next")])
def test_targets_are_resolved(shipped, target, want):
    forms = [f"<link rel='canonical' href='{target}'>", f'<meta http-equiv=refresh content="0; url={target}">',
             f"""<meta http-equiv="refresh" content="0;url='{target}'">"""]
    for html in forms[:1] if target in ("", "#top") else forms:
        edges = url_filter.link_edges(shipped.createDataFrame([page(1, "http://x.net/a/1?old", html)], SCHEMA)).collect()
        assert [r.dst for r in edges] == ([want] if want else []), html


def test_targets_against_the_base_element(shipped):
    rows = [page(1, "http://x.net/a/1", "<base href='http://y.net/b/'><link rel=canonical href='2'>"),
            page(2, "http://x.net/a/1", "<BASE target=x href='sub/'><link rel=canonical href=2>"),
            page(3, "http://x.net", "<link rel=canonical href=2>"), page(4, "no scheme", "<link rel=canonical href=2>")]
    assert sorted(r.dst for r in url_filter.link_edges(shipped.createDataFrame(rows, SCHEMA)).collect()) == [
        "http://x.net/2", "http://x.net/a/sub/2", "http://y.net/b/2"]


def test_blocks_travel_along_relative_chains(shipped):
    """A chain of pages, each naming the next by a relative link, with the blocked one at its end."""
    rows = [page(i, f"http://x.net/c/{i}/", f"<link rel=canonical href='../{i + 1}/'>") for i in range(30)]
    rows += [page(30, "http://x.net/c/30/", "<meta http-equiv=refresh content='0;url=http://a.com/de/1'>"),
             page(31, "http://x.net/d/1", "<link rel=canonical href='2'>"), page(32, "http://x.net/d/2")]
    found = {k: v[3] for k, v in verdicts(shipped, rows).items()}
    assert found == {i: "block" if i < 31 else "allow" for i in range(33)}


# Sharding


def test_shards_messy(messy, empty):
    out = sharding.shard_documents(messy, shards=3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in MESSY)
    for shard in range(3):
        places = sorted(r.slot for r in out if r.shard == shard)
        assert places == list(range(len(places)))
    assert sharding.shard_documents(empty).collect() == []


def test_shards_even(documents):
    out = sharding.shard_documents(documents)
    loads = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = out.agg(F.max("size")).first()[0]
    assert len(loads) == 8 and max(loads) - min(loads) <= largest
    gaps = out.groupBy("shard").agg(
        F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n"), F.count("*").alias("k"))
    assert all(r.lo == 0 and r.hi == r.n - 1 == r.k - 1 for r in gaps.collect())


def test_rebalancing_moves_into_new_shards_only(documents):
    first = sharding.slot_map(sharding.slot_bytes(documents), 8)
    grown = sharding.rebalance(first, 10)
    both = first.select("vslot", F.col("shard").alias("was")).join(grown, "vslot").collect()
    assert {r.version for r in both} == {2}
    assert all(r.shard == r.was or r.shard in (8, 9) for r in both)
    load = {}
    for r in both:
        load[r.shard] = load.get(r.shard, 0) + r.bytes
    assert len(load) == 10 and max(load.values()) < 1.5 * sum(load.values()) / 10
    same = sharding.rebalance(first, 8)
    assert first.select("vslot", "shard").exceptAll(same.select("vslot", "shard")).count() == 0


def test_shards_with_a_hot_key(shipped):
    """A third of the rows under one key, another third without one, many of them alike in text: bytes stay even."""
    rows = [(7, "same text " * 40) for _ in range(1500)] + [(None, f"no id {i} " * (1 + i % 50)) for i in range(1500)]
    rows += [(100 + i, "x" * (i % 300)) for i in range(1500)]
    out = sharding.shard_documents(shipped.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    loads, slots = Counter(), Counter()
    for r in out:
        loads[r.shard] += r.size
        slots[r.vslot] += 1
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= max(r.size for r in out) * 3
    assert max(slots.values()) < 15
    for shard in loads:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_shards_equal_a_brute_force_placing(documents):
    """Slots by the leading bits of MD5, then the heaviest slot to the lightest shard, places by slot and key."""
    rows = [(r.doc_id, len((r.text or "").encode()) + 1) for r in documents.select("doc_id", "text").collect()]
    slot = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % sharding.SLOTS for i, _ in rows}
    weight = Counter()
    for i, size in rows:
        weight[slot[i]] += size
    load, home = [0] * 8, {}
    for s in sorted(weight, key=lambda s: (-weight[s], s)):
        home[s] = load.index(min(load))
        load[home[s]] += weight[s]
    want, used = {}, Counter()
    for i, size in sorted(rows, key=lambda r: (slot[r[0]], r[0])):
        shard = home[slot[i]]
        want[i] = (size, shard, used[shard])
        used[shard] += 1
    assert {r.doc_id: (r.size, r.shard, r.slot) for r in sharding.shard_documents(documents).collect()} == want


def test_slot_maps_are_kept_by_version(documents, tmp_path):
    path = str(tmp_path / "maps")
    first = sharding.slot_map(sharding.slot_bytes(documents), 8)
    assert sharding.save_map(first, path) == 1
    grown = sharding.rebalance(sharding.load_map(documents.sparkSession, path), 9)
    assert sharding.save_map(grown, path) == 2
    again = sharding.load_map(documents.sparkSession, path)
    assert again.columns == first.columns and sorted(again.collect()) == sorted(grown.collect())
    assert sorted(sharding.load_map(documents.sparkSession, path, 1).collect()) == sorted(first.collect())
    assert sharding.load_map(documents.sparkSession, path, 5).collect() == []
    with pytest.raises(AnalysisException):
        sharding.save_map(grown, path)
    empty = sharding.slot_map(sharding.slot_bytes(documents.filter("false")), 8)
    assert empty.collect() == [] and sharding.rebalance(empty, 9).collect() == []
    with pytest.raises(ValueError):
        sharding.save_map(empty, path)


def test_sharding_is_native(documents, plan):
    text = plan(sharding.shard_documents(documents))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
