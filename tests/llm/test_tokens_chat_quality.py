import random
import zlib

import numpy as np
import pytest

from framelog.llm import chat_format, quality, token_counts

from .helpers import ODD, docs

TRICKY = [
    "", " ", "  a", "a  ", "\n\n a\t b", "it's I'll 'S ''s", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext", "1234 ½ ²x", "é́ ñ", "中文字 テスト", "\U0001f600\U0001f600 ok",
    "a b c　", "\x1c\x1d\x1e\x1f\x85 x", "\x00\x01", "%%% &&& a%%%", "'" * 50, "ab" * 3000, "\r\n\r\n", "﻿bom", "ａｂｃ１２", "​‍x", "AͅB",
]


@pytest.fixture(scope="module")
def library():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def test_counts_are_the_librarys(library):
    counter = token_counts.PieceCounter(token_counts.default_path())
    rng = random.Random(4)
    alphabet = "ab '\n\t.,1é中 \U0001f600<|>"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False)), repr(t)


def test_every_character_splits_as_in_the_library(library):
    counter = token_counts.PieceCounter(token_counts.default_path())
    wrong = []
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 64):
        part = points[k : k + 64]
        texts = [f"a{chr(c)}1 {chr(c)}b{chr(c)} {chr(c)}" for c in part]
        for c, t, e in zip(part, texts, library.encode_batch(texts, add_special_tokens=False)):
            if counter.count(t) != len(e):
                wrong.append(hex(c))
    assert wrong == []


def test_streamed_text(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 100)
    counter = token_counts.PieceCounter(token_counts.default_path())
    text = "Words, and 12 more words. " * 40
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False))


def test_odd_rows(spark, library):
    got = token_counts.count_tokens(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (1, 2):
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False)
        if r.doc_id == 6:
            assert r.over_limit and r.n_tokens == len(library.encode(dict(ODD)[6], add_special_tokens=False))
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def render(turns):
    out, spans = "", []
    for role, text in turns:
        head = f"<|{role}|>\n"
        if role == "assistant":
            spans.append(f"{len(out) + len(head)}:{len(text) + len('<|end|>') + 1}")
        out += f"{head}{text}<|end|>\n"
    return out, ",".join(spans)


def test_preference_pairs(spark):
    rng = random.Random(6)
    conv = lambda: [(rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])) for _ in range(rng.randint(0, 6))]
    pairs = [(k, conv(), conv()) for k in range(60)]
    pairs = [(k, a, a[: rng.randint(0, len(a))] + b if k % 2 else b) for k, a, b in pairs]
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    rows = [(k, [(i, *t) for i, t in enumerate(a)], [(10 + i, *t) for i, t in enumerate(b)]) for k, a, b in pairs] + [(99, None, [(0, "user", "q")])]
    got = {r.pair_id: r for r in chat_format.preference_format(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    for k, a, b in [*pairs, (99, [], [("user", "q")])]:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        r = got[k]
        assert (r.n_prompt_turns, r.prompt) == (n, render(a[:n])[0])
        assert (r.chosen, r.chosen_mask) == render(a[n:]) and (r.rejected, r.rejected_mask) == render(b[n:])


def test_conversations(spark):
    rows = [(0, 1, "assistant", "A0"), (0, 0, "user", "q"), (1, 0, "user", "p"), (1, 1, "assistant", "A1"), (2, None, None, None), (None, 0, "user", "lost"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: r for r in chat_format.preference_format(chat_format.swapped_replies(chat_format.gather(turns))).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert got[0].prompt == "<|user|>\nq<|end|>\n" and "A0" in got[0].chosen and "A1" in got[0].rejected
    assert got[2].n_prompt_turns == 1 and got[4].n_prompt_turns == 2 and got[4].chosen == got[4].rejected == ""
    assert chat_format.preference_format(chat_format.swapped_replies(chat_format.gather(turns.limit(0)))).count() == 0


def labelled(n, rng):
    good = ["the river runs slowly past the old stone mill", "a letter came from the north in winter", "they sat and spoke of harvest and of rain"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(rng.choice(good) for _ in range(rng.randint(1, 9)))
        if bad:
            text = " ".join(w + rng.choice(["%%%", "$$$", "!!"]) for w in text.upper().split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = labelled(600, rng)
    table = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows + [(None, "no id"), (700, None), (701, "")]), table).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items() if i is not None)
    held = [(by[i].predicted, q) for i, q, _ in labels if by[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert by[700].score == by[701].score


def test_quality_never_reads_held_out_labels(spark):
    rows, labels = labelled(200, random.Random(9))
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(map(tuple, quality.classify(docs(spark, rows), spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert quality.classify(docs(spark, []), none).count() == 0


def test_context_sums_do_not_depend_on_the_split():
    texts = ["a b c a b", "b c d", "", None, "a a a a"]
    whole = quality.context_sums(iter(texts))
    assert (whole == sum(quality.context_sums(iter([t])) for t in texts)).all() and whole.any()
    assert np.allclose(np.linalg.norm(quality.word_vectors(whole), axis=1).max(), 1)


def test_vocabulary_files_that_split_otherwise_are_refused():
    from framelog.llm.token_counts import check_covered

    good = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    check_covered(good, "x")
    for change in ({"normalizer": {"type": "NFC"}}, {"model": {"type": "Unigram"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError, match="can't be counted"):
            check_covered(good | change, "x")


def test_repeated_ids_are_learned_from_once(spark):
    rows = [(k % 10, "good words here " * (k % 10 + 1)) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    got = quality.classify(docs(spark, rows), labels).collect()
    once = quality.classify(docs(spark, rows[:10]), labels).collect()
    assert len(got) == 400 and {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in once}
