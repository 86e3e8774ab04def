"""Byte-level BPE against the library that reads the same rank files, and tables under appends and edits."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import byte_pairs
from quillstone.llm.byte_pairs import PATTERN, RANKS, Chunk, ChunkTable, Text, Vocabulary, split, vocabulary

from .conftest import by_row

LETTERS = st.text(st.sampled_from("aeinstéß日 \n\t'lr1! 😀"), max_size=40)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "rank file", pat_str=PATTERN, mergeable_ranks=vocabulary().rank, special_tokens={})


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A rank file whose last token is reached by no merge."""
    import base64
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaaa", b"xyz"]
    path = tmp_path_factory.mktemp("ranks") / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)


def test_pairs_that_fit(library):
    rnd, vocab = random.Random(3), vocabulary()
    tokens = list(vocab.rank.items())
    for _ in range(5000):
        (a, i), (b, j) = rnd.choice(tokens), rnd.choice(tokens)
        if a + b not in vocab.rank:
            assert vocab._meet(i, j, float("inf")) == (library._core_bpe.encode_single_piece(a + b) == [i, j])


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_chunks_equal_the_library(name):
    vocab, rnd = vocabulary(public_tokenizers.path(name)), random.Random(4)
    encode = tiktoken.Encoding(
        name, pat_str=PATTERN, mergeable_ranks=vocab.rank, special_tokens={})._core_bpe.encode_single_piece
    tokens = list(vocab.rank)
    for _ in range(1500):
        data = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6)))
        assert vocab.encode(data) == encode(data)
        data = bytes(rnd.choice(b"etaoin \xc3\xa9\xff") for _ in range(rnd.randint(1, 60)))
        assert vocab.encode(data) == encode(data)


def test_a_token_no_merge_reaches(small):
    vocab = Vocabulary(small)
    encode = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    for text in ["xyz", "axyz", "xyzxyz", "abcabc", "aaaaaaa", "aabc", "aaabcc", ""]:
        assert vocab.encode(text.encode()) == encode._core_bpe.encode_single_piece(text.encode()) if text else True
    with pytest.raises(ValueError):
        path = small + ".part"
        with open(small) as all_ranks, open(path, "w") as part:
            part.writelines(all_ranks.readlines()[1:])
        Vocabulary(path)


@settings(max_examples=150, deadline=None)
@given(LETTERS, LETTERS)
def test_append_touches_no_old_place(a, b):
    a, b = a.encode(), b.encode()
    chunk = Chunk(vocabulary(), a)
    before = list(chunk.last)
    chunk.append(b)
    assert chunk.last[:len(before)] == before
    assert chunk.last == Chunk(vocabulary(), a + b).last


@settings(max_examples=150, deadline=None)
@given(LETTERS, LETTERS, st.integers(0, 40), st.integers(0, 6))
def test_edit_equals_a_new_table(a, new, begin, size):
    a, new = a.encode(), new.encode()
    begin = min(begin, len(a))
    chunk = Chunk(vocabulary(), a)
    chunk.edit(begin, min(begin + size, len(a)), new)
    assert chunk.last == Chunk(vocabulary(), a[:begin] + new + a[begin + size:]).last


def test_edit_of_a_long_chunk_is_local():
    rnd, vocab = random.Random(5), vocabulary()
    data = bytes(rnd.choice(b"etaoinshrdlu") for _ in range(20_000))
    chunk = Chunk(vocab, data)
    assert chunk.edit(10_000, 10_003, b"zq") < 600
    assert chunk.data == data[:10_000] + b"zq" + data[10_003:]
    assert chunk.last == Chunk(vocab, chunk.data).last


@settings(max_examples=200, deadline=None)
@given(LETTERS, LETTERS, st.integers(0, 40), st.integers(0, 6))
def test_text_edits_equal_the_library(text, new, begin, size):
    library = tiktoken.Encoding("e", pat_str=PATTERN, mergeable_ranks=vocabulary().rank, special_tokens={})
    begin = min(begin, len(text))
    kept = Text(vocabulary(), text)
    kept.edit(begin, min(begin + size, len(text)), new)
    assert kept.ids() == library.encode_ordinary(text[:begin] + new + text[begin + size:])
    kept.append(text)
    assert kept.ids() == library.encode_ordinary(kept.text)


def test_edit_of_a_long_text_is_local(library):
    text = Text(vocabulary(), "the cat sat on the mat, 12 times.\n" * 2000)
    assert text.edit(30_000, 30_004, "moon") < 10
    assert text.ids() == library.encode_ordinary(text.text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t'sl!é"), max_size=60), st.integers(3, 12))
def test_stretches_give_all_matches(text, stretch):
    pattern = regex.compile(PATTERN)
    assert [w for part in split(text, pattern, stretch) for w in part] == pattern.findall(text)


def test_forgetting_changes_nothing(library):
    vocab, words = vocabulary(), PATTERN.split("|") * 3 + ["x" * 100] * 2
    for limit in (1, 2, 1000):
        table = ChunkTable(vocab, limit)
        for w in words:
            assert table[w] == b"".join(i.to_bytes(4, "little") for i in library._core_bpe.encode_single_piece(w.encode()))
        assert len(table) <= limit


def test_documents_equal_the_library(documents, messy, empty, library, monkeypatch):
    for docs in (documents, messy):
        texts = {}
        for row in docs.select("doc_id", "text").collect():
            texts.setdefault(row.doc_id, set()).add(row.text or "")
        out = byte_pairs.decode_bytes(byte_pairs.encode_bytes(docs)).collect()
        assert len(out) == docs.count()
        for row in out:
            assert bytes(row.decoded).decode() in texts[row.doc_id]
            assert row.ids == library.encode_ordinary(bytes(row.decoded).decode())
    assert byte_pairs.decode_bytes(byte_pairs.encode_bytes(empty)).collect() == []
    assert by_row(byte_pairs.encode_bytes(messy, table_chunks=3), "doc_id", "ids") == by_row(
        byte_pairs.encode_bytes(messy), "doc_id", "ids")


def test_ids_cut_inside_a_character(shipped):
    ids = vocabulary(RANKS).encode("𐍈".encode())
    assert len(ids) > 1
    rows = shipped.createDataFrame([(1, ids[:1]), (2, ids), (None, None), (4, [])], "doc_id long, ids array<int>")
    out = {r.doc_id: bytes(r.decoded) for r in byte_pairs.decode_bytes(rows).collect()}
    assert out == {1: "𐍈".encode()[:len(out[1])], 2: "𐍈".encode(), None: b"", 4: b""} and out[1]
