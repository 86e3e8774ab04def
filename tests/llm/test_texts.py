import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import chat, language_id, packing, pieces, quality

from .conftest import LONG, MESSY, by_row

ODD = [None, "", " ", "  ", "▁", "▁ a", "a  b   c ", "\n\t x", "日本語 テスト", "😀 á", "x" * 5000, " " * 50,
       "a\x00b", "▁▁▁", "<s> </s> <0x41>", "nbsp x　y", "word " * 3000, "<|endoftext|> it's 12 3½ "]


# Pieces


@pytest.mark.parametrize("sizes", [{}, {"table_words": 3, "window_chars": 7}])
def test_pieces_equal_library(shipped, sizes):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    df = shipped.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in pieces.decode_pieces(pieces.encode_pieces(df, **sizes)).collect():
        want = sp.encode(ODD[r.doc_id] or "")
        assert (r.ids, r.decoded) == (want, sp.decode(want))


def test_pieces_documents(documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in pieces.encode_pieces(documents).collect():
        assert r.ids == sp.encode(texts[r.doc_id])


def test_pieces_messy(messy, empty):
    assert pieces.encode_pieces(messy).count() == len(MESSY)
    assert pieces.decode_pieces(pieces.encode_pieces(empty)).collect() == []


# Packing


def check_packing(rows, df, window=2048):
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*vocabulary.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    pieces_of = df.collect()
    sequences, spans = {}, {}
    want = Counter((i, len(v)) for (i, _), v in zip(rows, ids))
    by_doc = {(i, len(v), zlib.crc32(v.tobytes())): v for (i, _), v in zip(rows, ids)}
    for p in pieces_of:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        spans.setdefault((p.doc_id, p.doc_tokens), Counter())[p.start, p.length] += 1
        assert any(zlib.crc32(v[p.start:p.start + p.length].tobytes()) == p.ids_crc32
                   for k, v in by_doc.items() if k[:2] == (p.doc_id, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or (at <= window and at & (at - 1) == 0)
    assert set(spans) == set(want)
    for key, found in spans.items():
        assert sum(n * c for (_, n), c in found.items()) == key[1] * want[key]
        covered = Counter()
        for (start, n), c in found.items():
            covered[start] += c
            covered[start + n] -= c
        level = 0
        for at in sorted(covered):
            if at < key[1]:
                level += covered[at]
                assert level == want[key]


def test_packing_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(documents))


def test_packing_messy(messy, empty):
    check_packing([r[:2] for r in MESSY], packing.pack(messy))
    assert packing.pack(empty).collect() == []


def test_packing_hot_ids(shipped):
    """A third of the rows without an id, a third under one id, copies among both."""
    rows = [(None, f"row {i % 7} " * (3 + i % 11)) for i in range(120)] + [(5, "one text of some words") for _ in range(120)]
    rows += [(10 + i, "z " * (i % 40)) for i in range(120)]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_packing(rows, packing.pack(df, window=16), window=16)


def test_packing_small_window(shipped):
    rows = list(enumerate(["a b c d e f g h"] * 40 + ODD + ["one two three"] * 31))
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    check_packing(rows, packing.pack(df, window=16), window=16)


def test_solver_uses_what_is_there():
    draw = np.random.default_rng(3)
    histogram = {int(n): int(c) for n, c in zip(draw.permutation(2047)[:900] + 1, draw.integers(1, 60, 900))}
    ranges, sequences = packing.solve(histogram)
    used, filled = Counter(), Counter()
    for n, low, high, first, offset in ranges:
        assert low == used[n] and high <= histogram[n]
        used[n] = high
        filled[first] += n
    assert set(filled.values()) == {2048}
    total = sum(n * c for n, c in histogram.items())
    assert sequences * 2048 > 0.3 * total


def test_least_squares_reaches_an_exact_histogram():
    combos = np.array([[10, 2038, 0], [20, 2028, 0], [10, 20, 2018]])
    target = np.zeros(2049)
    for combo, times in zip(combos, (7, 5, 3)):
        for n in combo[combo > 0]:
            target[n] += times
    assert np.allclose(packing.non_negative_least_squares(combos, target, 3000), (7, 5, 3), atol=1e-3)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_token_ids_equal_tokenizers(text):
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist() == [*vocabulary.encode(text, add_special_tokens=False).ids, 1]


# Language


def test_language_accuracy(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_language_model(docs)
    out = language_id.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
        F.avg(F.col("rejected").cast("int")).alias("gone"), F.count("*").alias("n")).first()
    assert r["n"] > 150 and r["right"] > 0.98 and r["gone"] < 0.01
    foreign = shipped.createDataFrame([(1, "Вся власть советам, мир народам и земля крестьянам")], "doc_id long, text string")
    assert language_id.identify_language(foreign, model).first()["score"] < 0.9


FOREIGN = [
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "z" * 300,
]


def test_language_rejects_what_it_never_saw(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_language_model(docs)
    draw = random.Random(5)
    letters = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400)) for _ in range(100)]
    odd = shipped.createDataFrame(list(enumerate(FOREIGN + letters)), "doc_id long, text string")
    kept = [r.doc_id for r in language_id.identify_language(odd, model).filter("not rejected").collect()]
    assert kept == []
    clean = language_id.identify_language(docs, model).filter("held_out")
    assert clean.filter("rejected").count() <= clean.count() // 100


def test_language_scores_whole_text(documents):
    model = language_id.fit_language_model(documents)
    texts = [r.text for r in documents.limit(6).collect()]
    together, _ = language_id._scores(texts, model)
    for t, row in zip(texts, together):
        want = language_id.subwords(t) @ model.table + model.bias
        assert np.allclose(row, want, atol=1e-3)


def test_predictions_against_their_definition(documents):
    """Every document judged n-gram by n-gram, from the fitted model alone."""
    model = language_id.fit_language_model(documents)
    found = {r.doc_id: r for r in language_id.identify_language(documents, model).collect()}
    for r in documents.filter("length(text) < 3000").collect():
        data = language_id.letters(r.text).encode()
        total, seen = np.zeros((2, len(model.labels))), 0
        for n in language_id.GRAMS:
            for i in range(len(data) - n + 1):
                b = int(language_id.hashed(np.frombuffer(data[i:i + n], np.uint8), n)[0])
                total += model.table[b], model.usual[b]
                seen += 1
        logits = (total[0] / max(seen, 1) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        n = len(language_id.GRAMS) * len(data)
        strange = (total[1] / max(seen, 1)).max() * np.sqrt(n / (n + language_id.SHORT)) < model.familiar_from
        got = found[r.doc_id]
        if not any(map(str.isalpha, r.text)):
            assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)
            continue
        assert got.lang_pred == model.labels[int(p.argmax())] and abs(got.score - p.max()) < 1e-3
        assert got.rejected == (strange or p.max() < model.reject_below)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_three_hundred_labels(shipped):
    """No label is left out, and the rare ones get their rows beside one that holds most of the table."""
    rows = [(i, f"{'qwzx'[i % 4]}{chr(97 + i // 26)}{chr(97 + i % 26)} " * 9, f"l{i % 300:03}") for i in range(300)] * 12
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)] + [(n, "a hot label", "hot") for n in range(5000, 9000)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, x, y, _ = language_id.labelled_sample(docs, "doc_id", "text", "lang", 600)
    assert len(labels) == 301 and len(x) <= 301 * language_id.LEAST_PER_LABEL
    assert max(np.bincount(y)) <= language_id.LEAST_PER_LABEL and min(np.bincount(y)) >= 1


def test_repeated_rows_are_one_hash(shipped):
    docs = shipped.createDataFrame([(1, "the same text", "en")] * 500 + [(2, "der andere", "de")] * 3, "doc_id long, text string, lang string")
    labels, x, y, _ = language_id.labelled_sample(docs, "doc_id", "text", "lang", 8)
    assert labels == ["de", "en"] and np.bincount(y).tolist() == [3, 4]


def test_language_messy(messy, empty):
    model = language_id.fit_language_model(messy)
    out = language_id.identify_language(messy, model).collect()
    assert len(out) == len(MESSY)
    for r in out:
        assert 0 <= r.score <= 1 and (r.lang_pred in model.labels or r.lang_pred == "und")
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {3, 4, 5, 6}
    kept = language_id.keep_known_languages(messy, model)
    assert kept.columns == messy.columns and kept.filter("doc_id in (3, 4, 5, 6)").count() == 0
    nothing = language_id.fit_language_model(empty)
    assert language_id.identify_language(empty, nothing).collect() == []
    assert {r.lang_pred for r in language_id.identify_language(messy, nothing).collect()} == {"und"}
    single = language_id.fit_language_model(messy.filter("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify_language(messy, single).collect()} <= {"en", "und"}


# Quality


def brute_measures(t):
    import re
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {j for i, x in enumerate(triples) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(covered), len(lines))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1c é#%|"), max_size=60))
def test_measures(text):
    assert quality.measure_text(text) == brute_measures(text)


def test_quality_messy(messy, empty):
    out = quality.judge_quality(messy).collect()
    assert len(out) == len(MESSY)
    by_id = {r.doc_id: r for r in out}
    assert by_id[3].n_words == 0 and by_id[3].base_failed and not by_id[3].kept
    assert by_id[7].base_failed  # one passage repeated throughout
    assert quality.judge_quality(empty).collect() == []


def test_adaptive_limits(shipped):
    """The same symbols are normal for one source and too many for another."""
    clean, wordy = " ".join(f"word{i}" for i in range(80)), " ".join(f"#tag{i} *x{i}" for i in range(40))
    rows = [(i, clean, "en", "news") for i in range(150)] + [(1000 + i, wordy, "en", "social") for i in range(150)]
    rows += [(5000, wordy, "en", "news"), (5001, wordy, None, None)]
    out = {r.doc_id: r.kept for r in quality.judge_quality(
        shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[0] and out[1000] and not out[5000]


def test_sketches_merge(shipped):
    """Group sketches merged are those of the whole."""
    rows = [(i, " ".join(f"{'x' * (i % 7)}{j}" for j in range(60)), "en", f"s{i % 3}") for i in range(200)]
    counts = quality.measured(shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
                              "doc_id", "text", "lang", "source")
    fine = quality._merged(quality.sketches(counts)).collect()
    coarse = quality._merged(quality.sketches(counts.withColumn("_source", F.lit("all")))).collect()
    assert {(r.measure, r.total, frozenset(r.sketch)) for r in fine} == {
        (r.measure, r.total, frozenset(r.sketch)) for r in coarse}


def brute_bucket(v):
    drop = max(v.bit_length() - quality.BUCKET_BITS, 0)
    return v >> drop << drop


def brute_kept(rows, fence=quality.FENCE, prior=quality.PRIOR):
    """``doc_id -> kept``, with the limits recounted from all rows for each group."""
    docs = []
    for i, text, lang, source in rows:
        m = dict(zip(quality._COUNTS, brute_measures(text)))
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        docs.append((i, lang, source, failed, m, {
            k.name: k.scale * m[k.top] // max(m[k.per], 1) for k in quality.MEASURES}))
    shaping = [d for d in docs if not d[3]]

    def limits(lang, source, name):
        parts = Counter()

        def counted(level):
            return Counter(brute_bucket(d[5][name]) for d in shaping if level(d))

        of_lang, of_all = counted(lambda d: d[1] == lang), counted(lambda d: True)
        for b, c in counted(lambda d: d[1:3] == (lang, source)).items():
            parts[b] += 1000 * c
        for b, c in of_lang.items():
            parts[b] += prior * 1000 * c // (of_lang.total() + prior)
        for b, c in of_all.items():
            parts[b] += prior * prior * 1000 * c // (of_all.total() * (of_lang.total() + prior))
        out = []
        for share, of in ((1, 4), (3, 4), (7, 8)):
            upto = 0
            for b in sorted(parts):
                upto += parts[b]
                if of * upto >= share * parts.total():
                    out.append(b)
                    break
        return out

    kept = {}
    for i, lang, source, failed, m, values in docs:
        fits = not failed
        for k in quality.MEASURES:
            if fits:
                q1, q3, q7 = limits(lang, source, k.name)
                chance = int(fence * k.chance / min(max(m[k.per], 1), quality.ALIKE) ** 0.5)
                reach = max(fence * (q3 - q1), fence * (q7 - q3), chance)
                fits &= (q1 - reach if k.both_sides else 0) <= values[k.name] <= q3 + reach
        kept[i] = fits
    return kept


def test_quality_equals_brute_force(shipped):
    rng, rows = random.Random(5), []
    for i in range(240):
        source, words = rng.choice(["news", "news", "tiny", "social", None]), []
        for _ in range(rng.randrange(40, 160)):
            w = "".join(rng.choices("abcdefg", k=rng.randrange(2, 9)))
            words.append(w + rng.choice(["#", "", ""]) if source == "social" or i % 17 == 0 else w)
        lines = [" ".join(words[j:j + 9]) for j in range(0, len(words), 9)]
        rows.append((i, "\n".join(lines + lines[:i % 4]), rng.choice(["en", "fr"]) if source != "tiny" else None, source))
    out = {r.doc_id: r.kept for r in quality.judge_quality(
        shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out == brute_kept(rows) and len(set(out.values())) == 2


def test_limits_move_with_the_group_without_a_step(shipped):
    """Limits differ between sources, and one document more moves a small group's limits little."""
    def found(n):
        rows = [(i, " ".join(f"word{j}" for j in range(60 + i)), "en", "news") for i in range(60)]
        rows += [(100 + i, " ".join(f"longerword{j}" for j in range(60 + i)), "en", "new") for i in range(n)]
        counts = quality.measured(shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        return {r._source: r.word_length_q3 for r in quality.limits(quality.sketches(counts)).collect()}
    few, many = found(4), found(120)
    assert many["news"] < many["new"]
    steps = [found(n)["new"] for n in (98, 99, 100, 101)]
    assert max(steps) - min(steps) <= 32 and few["new"] <= steps[0]


# Chat

CONTROLS = st.lists(st.sampled_from(
    ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "s>", "a", "\n", "é"]),
    max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(CONTROLS, CONTROLS)
def test_turns_round_trip(role, text):
    segment = chat.render_turn(role, text)
    assert chat.parse_turn(segment) == (role, text)
    assert chat.unescape(chat.escape(text)) == text
    body = segment[len(chat.OPEN):-len(chat.CLOSE)]
    assert [m[0] for m in chat._CONTROL.finditer(body)] == [chat.END_ROLE]


def test_chat_messy(shipped):
    schema = "conv_id long, turn long, role string, text string, segment string, _conv string"
    rows = [(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x", "y"), (2, 0, None, None, "x", "y"),
            (None, 0, "assistant", LONG, "x", "y"), (1, 1, "assistant", "tie", "x", "y"), (3, None, "user", "", "x", "y"),
            (3, None, "user", "", "x", "y")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(shipped.createDataFrame(rows, schema))).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert out[None].loss_chars == len(LONG) and out[None].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert out[1].loss_chars == len("</s>[INST] ok [/INST]tie")
    none = shipped.createDataFrame([], schema)
    assert chat.read_back(chat.format_turns(none)).collect() == []


def test_segments_outside_the_grammar_are_no_turns(shipped):
    good = chat.render_turn("assistant", "fine")
    rows = [(1, 0, "no turn at all"), (1, 1, good), (1, 2, None), (1, 3, good[:-1]), (2, 0, "<s>[ROLE]user</s>"), (None, 0, good)]
    out = {r.conv_id: r for r in chat.read_back(shipped.createDataFrame(rows, "conv_id long, turn long, segment string")).collect()}
    said = hashlib.sha256(b"assistant\nfine\n").hexdigest()
    assert (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars) == (1, said, 4)
    assert out[1].formatted_chars == len("no turn at all") + 2 * len(good) - 1
    assert (out[2].n_turns, out[2].loss_chars, out[2].formatted_chars) == (0, 0, 17)
    assert out[None].n_turns == 1


def test_a_joined_conversation_reads_back(shipped):
    """Segments put together hold no other turn ends than their own, so the whole splits into the same turns."""
    said = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<s>[ROLE]x[/ROLE]y</s>"), ("a</s>b", "<\\\\/s>"), ("", "")]
    whole = "".join(chat.render_turn(*t) for t in said)
    turns = [chat.parse_turn(s + chat.CLOSE) for s in whole.split(chat.CLOSE)[:-1]]
    assert turns == said
