"""Set-similarity join of documents by a token-group matrix.

A document is the set of its 4-word shingles; two link when their Jaccard
similarity is at least 0.85. Documents with one and the same set are one class.
Classes that look alike form a group, and the matrix says which tokens occur
in which group. A document can only link into a group whose token union holds
enough of its set, so groups are opened for it only then:

1. Tokens are ordered, rare ones first, by a count sketch of fixed size. Sets
   that link share at least m tokens among the first ``n - ceil(0.85 n) + m`` of
   each (m grows with the set), so the matrix keeps those tokens only, and a set
   that shares fewer links with nothing.
2. Every such token votes for its least class; a class joins the group of the
   leader most of its tokens name. Large groups are split.
3. The members of a (split) group are compared by multiplying their
   document-by-token matrix with its transpose, block by block of tokens.
4. A document visits the other groups that share m tokens, unless all it could
   find there is already in its component. A group is opened for a visitor only
   if the visitor's overlap with the token union reaches the bound.

Links become components in between, so near copies by the thousands cost a few
comparisons each and never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import numbered, stored, text_or_empty
from .components import components
from .rolling import prefix_hashes, span_hashes

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 18
SKETCH_CHUNK = 1 << 12
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 21
WINDOW_BYTES = 1 << 20
TOKEN_COLUMNS = 1 << 13


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are what ASCII white space separates, A-Z lower-cased. Long texts are
    hashed window by window, each window beginning ``width - 1`` words early.
    """
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    found, begin = [], 0
    while True:
        part = np.frombuffer(data, np.uint8, min(WINDOW_BYTES, len(data) - begin), begin)
        last = begin + len(part) == len(data)
        spaces = np.flatnonzero(part == 32)
        if not last and len(spaces) <= width:  # hardly a space: words longer than the window
            part, last = np.frombuffer(data, np.uint8, -1, begin), True
            spaces = np.flatnonzero(part == 32)
        if not last:
            part, spaces = part[:spaces[-1]], spaces[:-1]
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(part))
        k = min(width, len(starts))
        found.append(span_hashes(prefix_hashes(part), starts[:len(starts) - k + 1], ends[k - 1:]))
        if last:
            break
        begin += int(starts[-(width - 1)])
    return np.unique(np.concatenate(found))


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """What a set of ``n`` shares with any set it links to, at least."""
    return (PERCENT * n + 99) // 100


def in_common(n: int) -> int:
    """How many of its rarest tokens a set of ``n`` shares with a set of its size that it links to."""
    return min(2 + n // 20, least_overlap(n))


def fewest_in_common(n: Column) -> Column:
    """The same for the smallest set it can link to."""
    smaller = F.floor((PERCENT * n + 99) / 100)
    return F.least(2 + F.floor(smaller / 20), F.floor((PERCENT * smaller + 99) / 100))


def count_sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How many (document, token) pairs hash into each of a fixed number of buckets.

    Each task sums its own table and sends it in chunks that are added up per
    chunk; the driver receives one table, whatever the number of documents.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0):
                table += np.bincount((shingles(t.as_py()) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                     minlength=size)
        chunks = table.reshape(-1, SKETCH_CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())],
            ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, counts in zip(b.column(0).to_pylist(), b.column(1)):
                sums[c] = sums.get(c, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())],
            ["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = docs.select(text).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    total = np.zeros(size, np.int64)
    for r in rows:
        total[r["chunk"] * SKETCH_CHUNK:][:SKETCH_CHUNK] = np.frombuffer(r["counts"], np.int64)
    return total


def rarity(sketch: np.ndarray) -> np.ndarray:
    """A level per bucket: 0 for a bucket as full as chance makes it, then up with its excess."""
    usual = float(np.median(sketch))
    excess = sketch - usual - 6 * np.sqrt(usual) - 6
    return np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint64)


def token_prefixes(docs: DataFrame, key: str, text: str, levels: np.ndarray) -> DataFrame:
    """``_id, n, sig, prefix``: set size, digest of the set, and its rarest tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sigs, prefixes = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                order = (levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(57)) | (
                    s >> np.uint64(7))
                keep = len(s) - least_overlap(len(s)) + in_common(len(s))
                prefixes.append(s[np.argsort(order, kind="stable")[:keep]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.ListArray.from_arrays(offsets, values)], ["_id", "n", "sig", "prefix"])

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(
        run, "_id long, n long, sig binary, prefix array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block, as a product of 0/1 matrices."""
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[inverse] > 1
    column = np.cumsum(times > 1) - 1
    rows, cols = rows[shared], column[inverse[shared]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(sets), len(sets)))
    for begin in range(0, int(cols[-1]) + 1 if len(cols) else 0, TOKEN_COLUMNS):
        lo, hi = np.searchsorted(cols, [begin, begin + TOKEN_COLUMNS])
        m = np.zeros((len(sets), min(TOKEN_COLUMNS, int(cols[-1]) + 1 - begin)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - begin] = 1
        out += m @ m.T
    return out


def _stars(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member of a connected part to its least id."""
    left, edges = np.ones(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if not left[i]:
            continue
        part = frontier = np.zeros(len(ids), bool)
        part[i] = True
        while frontier.any():
            frontier = linked[frontier].any(axis=0) & ~part & left
            part = part | frontier
        left &= ~part
        edges += [(int(ids[j]), int(ids[i])) for j in np.flatnonzero(part) if ids[j] != ids[i]]
    return edges


def _compare(home: list[tuple[int, str]], visitors: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Links inside a group (no visitors), or between visitors and the group."""
    ids = [i for i, _ in home]
    sets = [shingles(t) for _, t in home]
    if visitors:
        union = np.unique(np.concatenate(sets))
        for i, t in visitors:
            s = shingles(t)
            at = np.searchsorted(union, s)
            overlap = int((union[np.minimum(at, len(union) - 1)] == s).sum())
            if overlap >= least_overlap(len(s)):  # the group is opened
                ids.append(i)
                sets.append(s)
        if len(ids) == len(home):
            return []
    both = _overlaps(sets)
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
    if visitors:
        linked[:len(home), :len(home)] = False
        linked[len(home):, len(home):] = False
    return _stars(linked, np.array(ids))


def _links(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` links found in blocks ``g, sub, part, visitor, cls``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home, visitors = None, [], []

        def ended():
            edges = _compare(home, visitors) if len(home) + len(visitors) > 1 and home else []
            return pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

        for b in batches:
            for g, sub, part, visitor, cls, text in zip(*(c.to_pylist() for c in b.columns)):
                if (g, sub, part) != current:
                    if current is not None:
                        yield ended()
                    current, home, visitors = (g, sub, part), [], []
                (visitors if visitor else home).append((cls, text))
        if current is not None:
            yield ended()

    return (
        blocks.join(texts, "cls").repartition("g", "sub", "part")
        .sortWithinPartitions("g", "sub", "part", "visitor", "cls")
        .select("g", "sub", "part", "visitor", "cls", "text").mapInArrow(run, "a long, b long"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id``: one row per input row.

    The component is the least key reachable over links, itself included. NULL
    texts and texts without words have no shingle and link with nothing; fewer
    than four words are one shingle. Equal texts link. Rows that repeat a key
    are one node of the link graph; rows without a key join no other set than
    their own. Keys that are not whole numbers are numbered in their order
    first. Other columns are ignored; an empty table gives an empty result.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        return _by_numbered_keys(docs, key, text)
    levels = rarity(count_sketch(docs, text))
    rows = stored(token_prefixes(docs, key, text, levels), "prefixes")
    classes = stored(rows.filter("n > 0 and _id is not null").groupBy("sig").agg(F.min("_id").alias("cls")), "classes")
    postings = rows.withColumnRenamed("_id", "cls").join(classes.hint("merge"), ["sig", "cls"]).select(
        "cls", "n", F.explode("prefix").alias("token"))
    lead = stored(postings.groupBy("token").agg(
        F.count("*").alias("k"), F.min("cls").alias("lead")).filter("k > 1"), "leads")
    shared = stored(postings.join(lead.hint("merge"), "token").select("token", "cls", "n", "lead"), "shared")
    able = shared.groupBy("cls", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= fewest_in_common(F.col("n")))
    shared = stored(shared.join(able.select("cls"), "cls", "left_semi"), "shared")

    votes = shared.groupBy("cls", "n", "lead").agg(F.count("*").alias("v"))
    homes = votes.groupBy("cls", "n").agg(
        F.max(F.struct("v", (-F.col("lead")).alias("lead"))).alias("best")).select(
        "cls", "n", (-F.col("best.lead")).alias("g"))
    homes = stored(homes, "homes")
    sizes = stored(homes.groupBy("g").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("subs")),
        "sizes")
    homes = stored(homes.join(sizes, "g").withColumn(
        "sub", F.pmod(F.xxhash64("cls"), F.col("subs")).cast("int")), "homes")
    wanted = homes.select(F.col("cls").alias("_cls"))
    texts = stored(docs.select(F.col(key).cast("long").alias("cls"), text_or_empty(text).alias("text")).join(
        wanted.hint("merge"), F.col("cls") == F.col("_cls"), "left_semi"), "texts", "zstd")

    # Inside groups; the leader is compared in every part of a split group.
    several = homes.filter("size > 1")
    inside = several.select("g", "sub", "cls").unionByName(
        several.select("g", "sub", F.col("g").alias("cls"))).distinct()
    near = stored(_links(inside.select(
        "g", "sub", F.lit(0).alias("part"), F.lit(False).alias("visitor"), "cls"), texts), "near-links")
    found = components(near).withColumnsRenamed({"node": "cls", "component": "comp"})
    homes = stored(homes.join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "homes")

    # Between groups, and between the parts of a group for who is not with its leader.
    spans = homes.groupBy("g").agg(
        F.first("subs").alias("subs"), F.first("least").alias("least"), F.first("most").alias("most"),
        F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    matrix = shared.join(homes.select("cls", "g"), "cls").select("token", "g").distinct()
    queries = shared.select("token", "cls").join(homes.select("cls", F.col("g").alias("home"), "n", "comp"), "cls")
    visits = (
        queries.join(matrix, "token").filter("g < home").groupBy("cls", "n", "comp", "g").agg(F.count("*").alias("k"))
        .filter(F.col("k") >= fewest_in_common(F.col("n"))).join(spans, "g")
        .filter((F.col("c0") != F.col("c1")) | (F.col("c0") != F.col("comp")))
        .filter((100 * F.col("n") >= PERCENT * F.col("least")) & (100 * F.col("most") >= PERCENT * F.col("n")))
        .select("g", "cls", "n", F.lit(-1).alias("own"), "subs"))
    leaders = homes.select(F.col("cls").alias("_lead"), F.col("comp").alias("lead_comp"))
    apart = homes.filter("subs > 1").join(leaders, F.col("g") == F.col("_lead"), "left").filter(
        F.col("lead_comp").isNull() | (F.col("comp") != F.col("lead_comp"))).select(
        "g", "cls", "n", F.col("sub").alias("own"), "subs")
    calls = visits.unionByName(apart).select(
        "g", "cls", "n", "own", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).filter("sub != own")
    calls = stored(calls.select("g", "sub", "cls", "n").distinct(), "calls")
    parts = calls.groupBy("g", "sub").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    callers = calls.join(parts, ["g", "sub"]).select(
        "g", "sub", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("visitor"), "cls")
    hosts = homes.select("g", "sub", "cls").join(parts, ["g", "sub"]).select(
        "g", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("visitor"), "cls")
    far = stored(_links(hosts.unionByName(callers), texts), "far-links")

    joined = components(near.unionByName(far)).withColumnsRenamed({"node": "cls", "component": "comp"})
    named = classes.select("sig", "cls").join(joined, "cls", "left").select(
        "sig", F.coalesce("comp", "cls").alias("comp"))
    return rows.select("_id", "n", "sig").join(named, "sig", "left").select(
        F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("comp", "_id").alias("component_id"))


def _by_numbered_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same for keys of any ordered type, by numbers that ascend with them."""
    keys = stored(docs.select(F.col(key).alias("_key")).filter("_key is not null").distinct().orderBy("_key").select(
        "_key", F.monotonically_increasing_id().alias("_number")), "keys")
    rows = stored(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(keys, "_key", "left").select(
        "_number", "_text"), "keyed-rows", "zstd")
    found = jaccard_components(rows, "_number", "_text").join(keys, "_number", "left")
    least = keys.select(F.col("_number").alias("component_id"), F.col("_key").alias("_least"))
    return found.join(least, "component_id", "left").select(
        F.col("_key").alias(key), "n_shingles", F.col("_least").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the least key, with its own columns.

    Rows are the nodes here, so keys, NULL ones too, may repeat; as in the exact
    stage NULL is the least key. Rows without a shingle all stay.
    """
    rows = numbered(docs, "near-rows")
    found = jaccard_components(rows.select("_row", F.col("row")[text].alias("text")), "_row", "text")
    keys = rows.select("_row", F.col("row")[key].alias("key"))
    kept = found.join(keys.hint("merge"), "_row").groupBy("component_id").agg(
        F.min(F.struct("key", "_row")).alias("best")).select(F.col("best._row").alias("_kept"))
    return rows.join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi").select("row.*")
