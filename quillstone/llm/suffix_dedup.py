"""Repeated passages by a distributed merge sort of suffixes.

Every byte covered by a 200-byte string that starts anywhere else as well is
removed. Such strings are found where the suffixes that begin with them become
neighbours in sorted order:

1. Each window of 200 bytes hangs on one byte of it, its anchor, chosen by
   content alone; the windows that hang on one anchor are a block. Equal windows
   have equal anchors, so a block whose anchor string is met once is dropped, and
   with it nearly all text that does not repeat (the duplicate detection that
   precedes string sorting in Bingmann, Sanders and Schimek, 2020).
2. What is left is cut into segments: runs of blocks; where a block repeats in
   part, runs of nodes, its groups of 16 windows; where a node does, runs of single
   windows. A segment begins wherever occurrences of the same content have
   different predecessors, so equal content is cut alike.
3. The suffixes at segment starts are sorted in each task, and the sorted runs are
   front-coded and exchanged by key range: a string is sent as the length it
   shares with the one before it and the bytes that differ.
4. A loser tree merges the runs of a range. It keeps with every string the prefix
   it shares with the last winner, compares those lengths first, and reads bytes
   only beyond them. Two neighbours that share 200 bytes or more are repeats.
5. Positions do not travel through the merge. It names the entries of a run that
   repeat, and these are joined back to the run's positions.

Hashes only say what is worth sorting; the bytes decide.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, new_place, stored, written_lean
from .rolling import mix, prefix_hashes, span_hashes

WINDOW = 200
ANCHOR = 32
GRAM = 16
NODE = 16
HEAD = 32
RUN_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
ROW_BYTES = 1 << 20
SAMPLE_TEXTS = 1000
_LOW = np.uint64((1 << 24) - 1)


# Anchors and blocks of one text


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m, size = a, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(a) - width + 1
    return np.minimum(m[:n], m[width - size:width - size + n])


def blocks(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Hashes of all prefixes; first and last window start and anchor of each block.

    A window's anchor is the place of the least 16-byte hash, the leftmost of
    equal ones, among those with 32 bytes of the window from there on. Long
    texts are scanned in overlapping stretches, with the same result.
    """
    p = prefix_hashes(data)
    width, found = window - ANCHOR + 1, []
    windows = len(data) - window + 1
    stretch = int(_LOW) - window
    for begin in range(0, windows, stretch):
        count = min(stretch, windows - begin)
        i = np.arange(begin, begin + count + width - 1)
        h = span_hashes(p, i, i + GRAM)
        ordered = (h & ~_LOW) | (i - begin).astype(np.uint64)
        found.append((_sliding_min(ordered, width) & _LOW).astype(np.int64) + begin)
    anchor = np.concatenate(found)
    lo = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    hi = np.append(lo[1:] - 1, windows - 1)
    return p, lo, hi, anchor[lo]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


# Passes over texts


def _flat(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = []
    for name, kind in zip(names, kinds):
        parts = [r[name] for r in rows]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        columns.append(pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
    return pa.RecordBatch.from_arrays(columns, names)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _values(column: pa.Array) -> Iterator:
    """The values of a column one by one; lists as numpy arrays, NULL lists as empty ones."""
    if not pa.types.is_list(column.type):
        return (v.as_py() for v in column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return (flat[i:j] for i, j in zip(np.append(0, ends), ends))


def _packed(*fields: tuple[str | Column, int]) -> Column:
    """Whole numbers in one: each but the first shifted in with its number of bits."""
    out = None
    for field, bits in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("long")
        out = value if out is None else F.shiftleft(out, bits).bitwiseOR(value)
    return out


_UNIT_BITS = 16  # of a length or an anchor's distance inside a block
_UNIT_MASK = (1 << _UNIT_BITS) - 1
MAX_WINDOW = 1 << _UNIT_BITS


def _each_text(df: DataFrame, schema: str, make) -> DataFrame:
    """``make(text, *others)`` gives arrays for one row; flush about every 200,000 results."""
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = [_KINDS[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for values in zip(*map(_values, b.columns)):
                made = make(*values)
                if made is not None:
                    out.append(made)
                    size += len(made[names[0]])
                if size > 200_000:
                    yield _flat(out, names, kinds)
                    out, size = [], 0
        yield _flat(out, names, kinds)

    return df.mapInArrow(run, schema)


def _anchor_rows(window: int):
    def make(text: str, key: int):
        data = _bytes_of(text)
        if len(data) < window:
            return None
        p, lo, _, x = blocks(data, window)
        return {"anchor": span_hashes(p, x, x + ANCHOR), "_key": np.full(len(lo), key), "lo": lo}
    return make


def _block_rows(window: int):
    """Content hash of every block that is left, and that of the block before it."""
    def make(text: str, key: int, left: np.ndarray):
        p, lo, hi, x = blocks(_bytes_of(text), window)
        content = mix(span_hashes(p, lo, hi + window) + (x - lo).astype(np.uint64))
        before = np.append(np.uint64(0), content[:-1])
        at = np.flatnonzero(np.isin(lo, left))
        return {"content": content[at], "before": before[at], "anchor": span_hashes(p, x, x + ANCHOR)[at],
                "_key": np.full(len(at), key),
                "unit": (lo << 2 * _UNIT_BITS | (hi - lo) << _UNIT_BITS | x - lo)[at]}
    return make


def _node_rows(window: int):
    """Groups of up to 16 windows of a block: their content, and the bytes that all of them have in common."""
    def make(text: str, key: int, parts: np.ndarray):
        p = prefix_hashes(_bytes_of(text))
        lo, size, x = parts >> 2 * _UNIT_BITS, parts >> _UNIT_BITS & _UNIT_MASK, parts & _UNIT_MASK
        hi, x = lo + size, lo + x
        nearest, farthest = (x - hi) // NODE, (x - lo) // NODE
        times = farthest - nearest + 1
        of = np.repeat(np.arange(len(parts)), times)
        j = farthest[of] - np.arange(len(of)) + np.repeat(np.cumsum(times) - times, times)
        core = x[of] - NODE * j
        begin, end = np.maximum(lo[of], core - NODE + 1), np.minimum(hi[of], core)
        content = mix(span_hashes(p, begin, end + window) + (x[of] - begin).astype(np.uint64))
        before = np.where(begin == lo[of], np.uint64(0), np.append(np.uint64(0), content[:-1]))
        shared = mix(span_hashes(p, core, core + window - NODE + 1) + j.astype(np.uint64))
        return {"content": content, "before": before, "core": shared, "_key": np.full(len(of), key),
                "unit": begin << 2 * _UNIT_BITS | (end - begin) << _UNIT_BITS}
    return make


def _window_rows(window: int):
    """Hash of every window of a node, and of the window before it in the node (else 0)."""
    def make(text: str, key: int, nodes: np.ndarray):
        p = prefix_hashes(_bytes_of(text))
        lo, times = nodes >> 2 * _UNIT_BITS, (nodes >> _UNIT_BITS & _UNIT_MASK) + 1
        of = np.repeat(np.arange(len(nodes)), times)
        s = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        content = span_hashes(p, s, s + window)
        before = np.where(s == lo[of], np.uint64(0), np.append(np.uint64(0), content[:-1]))
        return {"content": content, "before": before, "_key": np.full(len(s), key), "unit": s << 2 * _UNIT_BITS}
    return make


# Sorted runs and their merge


def segments(units: np.ndarray) -> list[tuple[int, int]]:
    """First and last window start of each segment.

    A unit is its first start, its length less one, its kind and whether a
    segment must begin there, packed. Units of one kind that follow on each
    other make a segment.
    """
    units = np.sort(units)
    kind = units >> 1 & 3
    units = units[np.argsort(kind, kind="stable")]
    lo, size, kind, cut = units >> _UNIT_BITS + 3, units >> 3 & _UNIT_MASK, units >> 1 & 3, units & 1
    hi = lo + size
    begins = np.append(True, (cut[1:] == 1) | (lo[1:] != hi[:-1] + 1) | (kind[1:] != kind[:-1]))
    ends = np.append(begins[1:], True)
    return list(zip(lo[begins].tolist(), hi[ends].tolist()))


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    i, step, n = known, 32, min(len(a), len(b))
    while i < n and a[i:i + step] == b[i:i + step]:
        i += step
        step *= 2
    x, y = a[i:min(i + step, n)], b[i:min(i + step, n)]
    if x == y:
        return n
    while len(x) > 1:
        half = len(x) // 2
        if x[:half] == y[:half]:
            x, y, i = x[half:], y[half:], i + half
        else:
            x, y = x[:half], y[:half]
    return i


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: what each shares with the one before it, and the rest of it."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = shared_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


class Run:
    """A cursor over one front-coded run."""

    def __init__(self, coded: Iterator[tuple[int, bytes, object]]) -> None:
        self.coded = coded
        self.text, self.item = b"", None
        self.known = 0  # prefix shared with the last winner

    def advance(self) -> bool:
        try:
            shared, rest, self.item = next(self.coded)
        except StopIteration:
            self.text = None
            return False
        self.text = self.text[:shared] + rest
        self.known = shared
        return True


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, bytes, object]]:
    """Prefix shared with the string before, string and item, in sorted order.

    A loser tree: every inner place keeps the loser of its match. All strings
    know what they share with the last winner, so the one that shares more is
    the smaller, and bytes are read only from there on when both share the same.
    """
    live = [r for r in runs if r.advance()]
    if not live:
        return
    for r in live:
        r.known = 0
    k = 1
    while k < len(live):
        k *= 2
    entries: list[Run | None] = live + [None] * (k - len(live))
    losers: list[Run | None] = [None] * k

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if b is None or b.text is None:
            return a, b
        if a is None or a.text is None:
            return b, a
        if a.known != b.known:
            return (a, b) if a.known > b.known else (b, a)
        n = shared_prefix(a.text, b.text, a.known)
        if n == len(a.text) or (n < len(b.text) and a.text[n] < b.text[n]):
            b.known = n
            return a, b
        a.known = n
        return b, a

    def build(node: int) -> Run | None:
        if node >= k:
            return entries[node - k]
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    place = {id(r): i + k for i, r in enumerate(live)}
    winner = build(1) if k > 1 else entries[0]
    while winner is not None and winner.text is not None:
        yield winner.known, winner.text, winner.item
        node = place[id(winner)] // 2
        winner.advance()
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeats(merged: Iterator[tuple[int, bytes, tuple]], window: int) -> Iterator[tuple[tuple, int]]:
    """Entries and the length they share with another suffix, where that is a window or more.

    An entry ends in the number of its positions: they repeat each other.
    """
    last = None
    for shared, text, entry in merged:
        if last is not None:
            reach = max(last[0], shared)
            if reach >= window:
                yield last[1], reach
        last = max(shared, len(text) if entry[-1] > 1 else 0), entry
    if last is not None and last[0] >= window:
        yield last[1], last[0]


_RUN_SCHEMA = pa.schema([
    ("range", pa.int32()), ("run", pa.string()), ("seq", pa.int32()), ("shared", pa.binary()),
    ("rest_len", pa.binary()), ("rest", pa.binary()), ("times", pa.binary()), ("where", pa.binary())])
_MERGED_SCHEMA = pa.schema([
    ("range", pa.int32()), ("run", pa.string()), ("seq", pa.int32()), ("repeated", pa.binary())])


def _coded_rows(table: dict[bytes, list[tuple[int, int]]], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One sorted run as front-coded rows, cut at the range splitters."""
    name, rows = uuid.uuid4().hex, []
    by_range: dict[int, list[bytes]] = {}
    for s in sorted(table):
        by_range.setdefault(bisect_right(splitters, s[:HEAD]), []).append(s)
    for r, strings in by_range.items():
        begin = seq = 0
        while begin < len(strings):
            end, size = begin, 0
            while end < len(strings) and size < ROW_BYTES:
                size += len(strings[end])
                end += 1
            part = strings[begin:end]
            shared, rest = front_code(part)
            where = [table[s] for s in part]
            rows.append({
                "range": r, "run": name, "seq": seq, "shared": np.array(shared, "<u4").tobytes(),
                "rest_len": np.array([len(x) for x in rest], "<u4").tobytes(), "rest": b"".join(rest),
                "times": np.array([len(w) for w in where], "<u4").tobytes(),
                "where": np.array([q for w in where for q in w], "<i8").tobytes()})
            begin, seq = end, seq + 1
    yield pa.RecordBatch.from_pylist(rows, _RUN_SCHEMA)


def _read_run(rows: list[dict]) -> Iterator[tuple[int, bytes, tuple]]:
    """Front-coded entries ``((run, seq), index, times)``; each row begins a new coding, so is joined to the last."""
    last = b""
    for row in rows:
        shared = np.frombuffer(row["shared"], "<u4").tolist()
        lengths = np.frombuffer(row["rest_len"], "<u4").tolist()
        times = np.frombuffer(row["times"], "<u4").tolist()
        rest, at, place = row["rest"], 0, (row["run"], row["seq"])
        for i, (n, length, t) in enumerate(zip(shared, lengths, times)):
            tail = rest[at:at + length]
            if i == 0:
                n = shared_prefix(last, tail)
                tail = tail[n:]
            last = last[:n] + tail
            yield n, tail, (place, i, t)
            at += length


def _merge_ranges(window: int):
    """Of each run's rows, the entries that repeat, by index, and how far; their positions stay behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, {}

        def merged():
            found: dict[tuple, list[tuple[int, int]]] = {}
            for (place, i, _), reach in repeats(merge_runs([Run(_read_run(r)) for r in rows.values()]), window):
                found.setdefault(place, []).append((i, reach))
            return pa.RecordBatch.from_pylist(
                [{"range": current, "run": r, "seq": seq, "repeated": np.array(e, "<i8").tobytes()}
                 for (r, seq), e in found.items()], _MERGED_SCHEMA)

        for b in batches:
            for row in b.to_pylist():
                if row["range"] != current:
                    if rows:
                        yield merged()
                    current, rows = row["range"], {}
                rows.setdefault(row["run"], []).append(row)
        if rows:
            yield merged()
    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``times, where, repeated`` of a row of a run: the positions of its entries that repeat."""
    for b in batches:
        for times, where, repeated in zip(*map(_values, b.columns)):
            times = np.frombuffer(times, "<u4").astype(np.int64)
            where = np.frombuffer(where, "<i8").reshape(-1, 2)
            index, reach = np.frombuffer(repeated, "<i8").reshape(-1, 2).T
            reaches = np.zeros(len(times), np.int64)
            reaches[index] = reach
            reaches = np.repeat(reaches, times)
            at = reaches > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[at, 0]), pa.array(where[at, 1]), pa.array(reaches[at])], ["_key", "begin", "reach"])


# The operator


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table bucketed by ``key`` to the shared folder: later joins on it move the other side only.

    Buckets are a property of catalog tables, so it is one until it is read back.
    """
    spark = df.sparkSession
    name, place = f"suffix_dedup_{uuid.uuid4().hex}", new_place(spark, "rows")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with written_lean(spark):
        df.repartition(buckets, key).write.option("compression", "zstd").option("path", place).bucketBy(
            buckets, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.stored_in = place
    spark.sql(f"DROP TABLE {name}")  # of the catalog; the files are not the catalog's
    return out


def _met_again(df: DataFrame, on: str) -> DataFrame:
    """Values met twice or more; stored, so that a join with a hot value among them can be split."""
    return stored(df.groupBy(on).agg(F.count("*").alias("n")).filter("n > 1").select(on), "met-again")


def _predecessors(df: DataFrame) -> DataFrame:
    """Contents met twice or more, the least text with each, and whether they follow different contents."""
    return stored(df.groupBy("content").agg(
        F.count("*").alias("n"), F.min("before").alias("b0"), F.max("before").alias("b1"),
        F.min("_key").alias("first_key"),
    ).filter("n > 1").withColumn("cut", (F.col("b0") != F.col("b1")) | (F.col("b0") == 0)).drop("b0", "b1", "n"),
        "predecessors")


def _stored_judged(units: DataFrame, *columns: str) -> DataFrame:
    """Units with ``cut``, NULL where their content is met once, and whether they stand for it; in place of the units."""
    known = _predecessors(units)
    judged = stored(units.join(known.hint("merge"), "content", "left").select(
        "_key", *columns, "cut", (F.col("_key") == F.col("first_key")).alias("first")), "judged")
    discard(units.sparkSession, units, known)
    return judged


def _opened(judged: DataFrame, by: str) -> DataFrame:
    """Units that do not repeat as a whole, and one text's for each content that does and shares ``by`` with such."""
    in_part = judged.filter("cut is null")
    return in_part.unionByName(judged.filter("first").join(in_part.select(by).distinct(), by, "left_semi")
                               .select(in_part.columns))


def _per_text(units: DataFrame, unit: str | Column = "unit") -> DataFrame:
    """``_key, units``: the distinct units of each text, at most as many as it has bytes."""
    return units.groupBy("_key").agg(F.collect_set(unit).alias("units"))


def repeated_spans(docs: DataFrame, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """``_key, row, text``, all input rows under a number of their own, and ``_key, begin, reach`` of repeated stretches."""
    spark = docs.sparkSession
    rows = _bucketed(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct("*").alias("row")), "_key")
    rows = rows.withColumn("text", F.coalesce(F.col(f"row.{text}"), F.lit("")))
    anchors = stored(_each_text(
        rows.select("text", "_key"), "anchor long, _key long, lo int", _anchor_rows(window)), "anchors")
    again = _met_again(anchors, "anchor")
    left = stored(anchors.join(again.hint("merge"), "anchor").groupBy("_key").agg(F.collect_set("lo").alias("lo")), "left")
    discard(spark, anchors, again)

    def with_units(units: DataFrame) -> DataFrame:
        return rows.select("text", "_key").join(units.hint("merge"), "_key").select("text", "_key", units.columns[1])

    made = stored(_each_text(
        with_units(left), "content long, before long, anchor long, _key long, unit long", _block_rows(window)), "blocks")
    blocks_left = _stored_judged(made, "unit", "anchor")
    discard(spark, left)
    made = stored(_each_text(
        with_units(_per_text(_opened(blocks_left, "anchor"))),
        "content long, before long, core long, _key long, unit long", _node_rows(window)), "nodes")
    again = _met_again(made, "core")
    met = stored(made.join(again.hint("merge"), "core"), "nodes-left")
    discard(spark, made, again)
    nodes = _stored_judged(met, "unit", "core")
    made = stored(_each_text(
        with_units(_per_text(_opened(nodes, "core"))), "content long, before long, _key long, unit long",
        _window_rows(window)), "windows")
    windows = _stored_judged(made, "unit")

    units = None
    for kind, judged in enumerate((blocks_left, nodes, windows)):
        first = F.shiftright("unit", 2 * _UNIT_BITS)
        size = F.shiftright("unit", _UNIT_BITS).bitwiseAND(F.lit(_UNIT_MASK))
        repeated = judged.filter("cut is not null").select(
            "_key", _packed((first, 0), (size, _UNIT_BITS), (F.lit(kind), 2), ("cut", 1)).alias("unit"))
        units = repeated if units is None else units.unionByName(repeated)
    units = stored(_per_text(units), "units")
    discard(spark, blocks_left, nodes, windows)
    splitters = _splitters(rows, units)

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list[tuple[int, int]]] = {}
        size = 0
        for b in batches:
            for t, k, us in zip(*map(_values, b.columns)):
                data = t.encode("utf-8", "surrogatepass")
                for lo, hi in segments(us):
                    where = table.setdefault(data[lo:hi + window], [])
                    size += (0 if where else hi - lo + window) + 16
                    where.append((k, lo))
                if size > RUN_BYTES:
                    yield from _coded_rows(table, splitters)
                    table, size = {}, 0
        yield from _coded_rows(table, splitters)

    # stored, since both readers must see the same runs; the merge leaves the positions out, so that a passage of very
    # many copies comes to its range once from each run
    runs = stored(with_units(units).mapInArrow(
        sort_runs, "range int, run string, seq int, shared binary, rest_len binary, rest binary, "
        "times binary, where binary"), "runs", "zstd")
    merged = stored(runs.drop("where").repartition("range").sortWithinPartitions("range", "run", "seq").mapInArrow(
        _merge_ranges(window), "range int, run string, seq int, repeated binary"), "merged")
    spans = stored(runs.join(merged, ["range", "run", "seq"]).select("times", "where", "repeated").mapInArrow(
        _positions, "_key long, begin long, reach long"), "repeats")
    discard(spark, units, runs, merged)
    return rows, spans


def _splitters(rows: DataFrame, units: DataFrame) -> list[bytes]:
    """First bytes that part the segments into ranges of about equal size, from a bounded sample of texts."""
    total = units.agg(
        F.count("*").alias("texts"),
        F.sum(F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + F.shiftright(u, 3).bitwiseAND(F.lit(_UNIT_MASK)) + 1))
        .alias("starts")).first()
    ranges = int((total["starts"] or 0) // RANGE_BYTES) + int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, (total["texts"] or 0) // SAMPLE_TEXTS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, us in zip(*map(_values, b.columns)):
                data = t.encode("utf-8", "surrogatepass")
                out += [data[lo:lo + HEAD] for lo, _ in segments(us)][:10_000]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["head"])

    chosen = units.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0)
    found = rows.select("text", "_key").join(chosen, "_key").select("text", "units").mapInArrow(
        heads, "head binary").orderBy(F.xxhash64("head")).limit(64 * SAMPLE_TEXTS).collect()
    sample = sorted({bytes(r["head"]) for r in found})
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row`` (the input row), ``n_bytes, n_removed, n_spans, kept_sha256, kept_text``: one row per input row.

    ``kept_text`` is what is left, NULL where nothing was removed; where a cut
    splits a character, its remaining bytes are dropped from ``kept_text`` only.
    NULL counts as empty; texts shorter than a window are never cut. Matches
    count inside one text, overlapping ones too, and never cross texts. Rows
    that repeat each other, in id and text too, are texts of their own. Other
    columns travel along in ``row``; an empty table gives an empty result.
    Windows have 32 to 65,535 bytes.
    """
    if not ANCHOR <= window < MAX_WINDOW:
        raise ValueError(f"windows of {ANCHOR} to {MAX_WINDOW - 1} bytes")
    rows, spans = repeated_spans(docs, text, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, us in zip(_values(b.column(1)), _values(b.column(2))):
                data = t.encode("utf-8", "surrogatepass")
                kept, at, runs = [], 0, 0
                us = np.sort(us)
                for begin, reach in zip((us >> 31).tolist(), (us & (1 << 31) - 1).tolist()):
                    if begin > at or not runs:
                        runs += 1
                        kept.append(data[at:begin])
                    at = max(at, begin + reach)
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(),
                            rest.decode("utf-8", "ignore") if runs else None))
            made = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(made, kinds))], ["row", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    stretches = _per_text(spans, _packed(("begin", 0), ("reach", 31)))
    joined = rows.join(stretches, "_key", "left").select("row", "text", "units")
    return joined.mapInArrow(
        cut, f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, kept_text string")


def drop_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed from their text; what is emptied stays as an empty text."""
    out = remove_repeats(docs, text, window)
    return out.select(*[
        F.coalesce("kept_text", f"row.{c}").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
