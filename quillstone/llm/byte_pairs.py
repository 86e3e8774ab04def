"""Byte-level BPE by prefix dynamic programming.

The merges of a rank file leave every byte string with exactly one encoding, and
every prefix of an encoding is the encoding of the bytes it covers. So each
prefix of a string has one valid last token: a token that ends there, starts
where another prefix ends, and fits that prefix's own last token, two tokens
fitting when merging their bytes gives back just the two. A table of these last
tokens, filled from left to right, encodes the string without merging it:

* an append fills new places of the table and touches no old one;
* an edit fills it again from the changed byte, until as many places in a row as
  the longest token has bytes repeat the old table: from there on it is the same.

The split pattern decides a match by what follows it and never by what stands
before, so texts are handled alike: matches are kept up to an edit, made anew
behind it, and kept again once a match ends where one used to.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TABLE_CHUNKS = 1 << 17
FITS = 1 << 19
CHUNK_CHARS = 64  # longer chunks are encoded where they stand, and not kept
STRETCH = 1 << 20
LOOK = 2  # characters behind a match that may have decided it: white space looks past the next one
BATCH_IDS = 1 << 21
NONE = -1


class Vocabulary:
    """Tokens of a rank file, and which of them may follow each other."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary has no token for some byte")
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._fits: dict[int, bool] = {}
        # A token's halves are the two tokens before its last merge; of a token
        # that no merge makes there are none, and it only ever stands alone.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged = {self.rank[bytes([b])] for b in range(256)}
        for token, rank in sorted(self.rank.items(), key=lambda item: item[1]):
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left in self.merged and right in self.merged and self._meet(left, right, rank):
                    self.halves[rank] = left, right
                    self.merged.add(rank)
                    break
        self._ending = ahocorasick.Automaton()
        for rank in self.merged:
            self._ending.add_word(self.token[rank].decode("latin-1"), (len(self.token[rank]), rank))
        self._ending.make_automaton()

    def _meet(self, left: int, right: int, until: float) -> bool:
        """Whether no merge below ``until`` crosses from ``left`` into ``right``.

        Goes back in time: of the two tokens at the border the one formed last
        is taken apart. While both stand there, a merge across is done if its
        rank comes before those that made their parents; of equal ranks the
        leftmost comes first, so before the right parent and after the left.
        """
        left_parent = right_parent = until
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < left_parent and across <= right_parent and across < until:
                return False
            left_halves, right_halves = self.halves.get(left), self.halves.get(right)
            if left_halves and (not right_halves or left > right):
                left_parent, left = left, left_halves[1]
            elif right_halves:
                right_parent, right = right, right_halves[0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode to just these two tokens."""
        if len(self._fits) > FITS:
            self._fits.clear()
        found = self._fits[left << 32 | right] = self._meet(left, right, float("inf"))
        return found

    def fill(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Extend the table ``last`` (``last[0]`` is the empty prefix) to the prefix of ``upto`` bytes."""
        upto, known = len(data) if upto is None else upto, self._fits
        filled = len(last) - 1
        begin = max(0, filled - self.longest + 1)
        last.extend([NONE] * (upto - filled))
        for end, (length, token) in self._ending.iter(data[begin:upto].decode("latin-1")):
            end += begin + 1
            if last[end] == NONE:
                start = end - length
                if start <= 0:
                    last[end] = token
                else:
                    fit = known.get(last[start] << 32 | token)
                    if self.fits(last[start], token) if fit is None else fit:
                        last[end] = token
        return last

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens of ``data`` from its table; a chunk that is itself a token is that token."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        return [whole] if whole is not None else self.walk(data, self.fill(data, [NONE]))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = RANKS) -> Vocabulary:
    """The vocabulary, once per worker."""
    return Vocabulary(path)


class Chunk:
    """One chunk of bytes with its table of last tokens."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"") -> None:
        self.vocab, self.data = vocab, data
        self.last = vocab.fill(data, [NONE])

    def ids(self) -> list[int]:
        return self.vocab.walk(self.data, self.last)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the table so far stays."""
        self.data += more
        self.vocab.fill(self.data, self.last)

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes [begin, end); the number of places filled anew."""
        old, shift, step = self.last, len(new) - (end - begin), self.vocab.longest
        self.data = self.data[:begin] + new + self.data[end:]
        last, at = old[:begin + 1], begin + len(new)
        while at < len(self.data):
            at = min(at + step, len(self.data))
            self.vocab.fill(self.data, last, at)
            # the places that follow hang on these and on bytes behind the edit, so they are the old ones
            if at - step >= begin + len(new) and last[at - step + 1:] == old[at - step + 1 - shift:at + 1 - shift]:
                self.last = last + old[at + 1 - shift:]
                return at - begin
        self.last = self.vocab.fill(self.data, last)
        return len(self.data) - begin


def split(text: str, pattern: regex.Pattern, stretch: int = STRETCH) -> Iterator[list[str]]:
    """All matches of the pattern, a bounded stretch of the text at a time.

    The matches of a stretch count up to the last whose following characters are
    all in it; where a single match is longer than that, the stretch grows.
    """
    begin, size = 0, stretch
    while len(text) - begin > size:
        part = pattern.findall(text[begin:begin + size])
        seen = size - LOOK
        at = sum(map(len, part))
        while part and at > seen:
            at -= len(part.pop())
        if part:
            yield part
            begin, size = begin + at, stretch
        else:
            size *= 2
    yield pattern.findall(text[begin:] if begin else text)


class Text:
    """A text with the ids of its matches, kept under appends and edits."""

    def __init__(self, vocab: Vocabulary, text: str = "", pattern: str = PATTERN) -> None:
        self.vocab, self.pattern, self.text = vocab, regex.compile(pattern), text
        self.matches = [w for part in split(text, self.pattern) for w in part]
        self.encoded = [vocab.encode(w.encode()) for w in self.matches]

    def ids(self) -> list[int]:
        return [i for ids in self.encoded for i in ids]

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> int:
        """Put ``new`` in place of the characters [begin, end); the number of matches made anew."""
        ends = list(accumulate(map(len, self.matches)))
        shift = len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        kept = sum(e + LOOK <= begin for e in ends)
        old_ends = {e + shift: i + 1 for i, e in enumerate(ends) if e >= end}
        at, made, rest = ends[kept - 1] if kept else 0, [], len(self.matches)
        for m in self.pattern.finditer(self.text, at):
            made.append(m.group())
            if m.end() >= begin + len(new) and m.end() in old_ends:
                rest = old_ends[m.end()]
                break
        before, after = self.encoded[:kept], self.encoded[rest:]
        replaced = {}
        if len(made) == 1 and rest - kept == 1:
            # one match for one: edit its table in place of filling a new one
            chunk, old, now = Chunk(self.vocab, self.matches[kept].encode()), self.matches[kept], made[0]
            same = 0
            while same < min(len(old), len(now)) and old[same] == now[same]:
                same += 1
            tail = 0
            while tail < min(len(old), len(now)) - same and old[-1 - tail] == now[-1 - tail]:
                tail += 1
            first = len(now[:same].encode())
            chunk.edit(first, len(old[:len(old) - tail].encode()), now[same:len(now) - tail].encode())
            replaced[0] = chunk.ids()
        fresh = [replaced.get(i) or self.vocab.encode(w.encode()) for i, w in enumerate(made)]
        self.matches = self.matches[:kept] + made + self.matches[rest:]
        self.encoded = before + fresh + after
        return len(made)


class ChunkTable(dict):
    """Ids of the chunks met so far, as bytes.

    Two generations of a fixed size: when the younger is full it becomes the
    older one, and what is met again moves back. Forgetting never changes a result.
    """

    def __init__(self, vocab: Vocabulary, limit: int = TABLE_CHUNKS) -> None:
        super().__init__()
        self.vocab, self.limit, self.older = vocab, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = np.array(self.vocab.encode(chunk.encode()), "<i4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def encode_bytes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS,
    pattern: str = PATTERN, table_chunks: int = TABLE_CHUNKS,
) -> DataFrame:
    """``key, ids``: the ids of each whole text, every match of the pattern by itself, no special tokens.

    NULL and empty texts have no ids. Narrow: one row for each input row, keys
    may be NULL or repeat, equal texts give equal ids, other columns are ignored
    and an empty table gives an empty result. A task holds a stretch of matches,
    the bounded table of distinct ones and the ids of the texts of one batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, compiled = ChunkTable(vocabulary(ranks), table_chunks), regex.compile(pattern)

        def made(keys: list, ids: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), "<i4")
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.ListArray.from_arrays(ends, values)], ["_id", "ids"])

        for b in batches:
            begin, size, ids = 0, 0, []
            for row, t in enumerate(b.column(1)):
                coded = b"".join(b"".join(map(table.__getitem__, part)) for part in split(t.as_py() or "", compiled))
                ids.append(coded)
                size += len(coded) // 4
                if size > BATCH_IDS:
                    yield made([b.column(0).slice(begin, row + 1 - begin)], ids)
                    begin, size, ids = row + 1, 0, []
            if ids:
                yield made([b.column(0).slice(begin, b.num_rows - begin)], ids)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", key)


def decode_bytes(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``key, ids, decoded`` (binary): the bytes of the ids; NULL ids count as none.

    Ids may be cut anywhere, so the bytes need not be whole characters. An id
    that is not in the vocabulary is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks).token.__getitem__
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            data = [b"".join(map(token, flat[i:j].tolist())) for i, j in zip(np.append(0, ends), ends)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, pa.array(data, pa.binary())], ["_id", "_ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("_id"), F.col(ids).alias("_ids")).mapInArrow(
        run, f"_id {kind}, _ids array<int>, decoded binary")
    return out.withColumnsRenamed({"_id": key, "_ids": ids})
