"""SentencePiece encoding and decoding through tables of distinct marked words.

No piece of the vocabulary crosses from a letter into a white-space marker, so
no merge does either: a text falls apart before each run of markers, and a word
is segmented alike wherever it stands. Each task keeps a table of the distinct
words it has met, segments a word once, and joins the ids back by position.

The table is per task and not one table of the whole corpus: joining by position
through a shuffle would move a row for every word of every text, many times the
input. It is emptied when it reaches a fixed size, which costs repeated
segmenting and never a different result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TABLE_WORDS = 1 << 17
WINDOW_CHARS = 1 << 20
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(maxsize=2)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    """The library's model, once per worker; refuses one whose pieces cross a marker."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers")
    return sp


class WordTable:
    """Distinct marked words with their ids: one flat id array and each word's slice of it."""

    def __init__(self, model: str, limit: int = TABLE_WORDS) -> None:
        self.sp, self.limit = processor(model), limit
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _segment(self, words: list[str]) -> list[list[int]]:
        # The library puts one marker in front of what it is given, but leaves
        # an empty text empty, so a lone marker has to be named.
        lone = [self.sp.piece_to_id(MARK)]
        return [ids if w != MARK else lone
                for w, ids in zip(words, self.sp.encode([w[1:] for w in words], num_threads=1))]

    def add(self, words: Iterable[str]) -> None:
        new = sorted(set(words) - self.row.keys())
        if not new:
            return
        if len(self.row) + len(new) > self.limit and self.row:
            self._clear()
            return self.add(words)
        found = self._segment(new)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32, lengths.sum())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order of position, and how many each word gave."""
        self.add(words)
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        first, lengths = self.starts[rows], np.diff(self.starts)[rows]
        total = int(lengths.sum())
        shift = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
        return self.ids[shift + np.arange(total)], lengths


def windows(text: str, size: int = WINDOW_CHARS) -> Iterator[str]:
    """The marked text in pieces of about ``size``, cut only in front of a run of markers."""
    if not text:
        return
    marked = MARK + text.replace(" ", MARK)
    begin = 0
    while len(marked) - begin > size:
        cut = marked.find(MARK, begin + size)
        while cut > 0 and marked[cut - 1] == MARK:
            cut = marked.find(MARK, cut + 1)
        if cut < 0:
            break
        yield marked[begin:cut]
        begin = cut
    yield marked[begin:]


def encode_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL,
    table_words: int = TABLE_WORDS, window_chars: int = WINDOW_CHARS,
) -> DataFrame:
    """``key, ids``: the ids that the library's ``encode`` gives for each whole text.

    NULL and empty texts have no ids. Narrow: rows keep their number, repeated
    rows are encoded alike, other columns are ignored. A task holds one window
    of words, the bounded table, and the ids of the texts in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model, table_words)
        for b in batches:
            keys, texts, begin = b.column(0), b.column(1), 0
            while begin < b.num_rows:
                end, words, of, chars = begin, [], [], 0
                flat, counts = [], []

                def flush():
                    if words:
                        ids, lengths = table.encode(words)
                        flat.append(ids)
                        counts.append((np.array(of), lengths))
                    words.clear()
                    of.clear()

                while end < b.num_rows and chars < window_chars:
                    for part in windows(texts[end].as_py() or "", window_chars):
                        found = _WORD.findall(part)
                        words.extend(found)
                        of.extend([end - begin] * len(found))
                        chars += len(part)
                        if chars >= window_chars:
                            flush()
                    end += 1
                flush()
                per_row = np.zeros(end - begin, np.int64)
                for rows, lengths in counts:
                    per_row += np.bincount(rows, lengths, end - begin).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, end - begin), pa.ListArray.from_arrays(offsets, values)], ["_id", "ids"])
                begin = end

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", key)


def decode_pieces(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``key, ids, decoded``: the text that the library's ``decode`` gives; NULL ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = [sp.decode(flat[i:j].tolist()) for i, j in zip(np.append(0, ends), ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["_id", "_ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("_id"), F.col(ids).alias("_ids")).mapInArrow(
        run, f"_id {kind}, _ids array<int>, decoded string")
    return out.withColumnsRenamed({"_id": key, "_ids": ids})
