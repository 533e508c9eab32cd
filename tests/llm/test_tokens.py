import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import splitting, tokenizer
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZERS), reason="no vocabulary here")


@pytest.fixture(scope="module")
def own():
    return tokenizer.Encoder()


@pytest.fixture(scope="module")
def reference():
    with open(os.path.join(tokenizer.TOKENIZERS, tokenizer.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SAMPLES = ["", " ", "Hello world", "<|endoftext|> is text", "it's we'll I'D", "中文，没有空格的一段文字。", "a\r\n\r\n  b\t\tc   ", "👩‍👩‍👧 é́ ﬁ", "ᚠᛇᚻ ሰላም", "x" * 5000, "汉" * 3000, " " * 300 + "a", "1234567890" * 50, "​　﻿", "aA" * 900]


def test_equals_the_tokenizer(own, reference):
    ids, ends = own.encode([None, *SAMPLES])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [[], *map(reference, SAMPLES)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("abcdeésn't 中文的 \n", max_size=60), max_size=5))
def test_random_texts(own, reference, texts):
    ids, ends = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == list(map(reference, texts))


def test_only_failing_words_are_merged(own):
    before = own.merges
    own.encode(["The quick brown fox"])
    assert own.merges == before
    proposed = own._propose("untransformed".encode())
    assert b"".join(own.bytes_of[x] for x in proposed) == b"untransformed"


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT_WORDS", 3)
    small = tokenizer.Encoder()
    for text in SAMPLES:
        assert small.encode([text])[0].tolist() == reference(text)


def test_table(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    assert rows(tokenizer.encode_table(frame)) == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokenizer.encode_table(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- splitting


def check(text, own, reference, limit=splitting.LIMIT, overlap=splitting.OVERLAP):
    pieces = splitting.split_text(text, own, limit, overlap)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for piece in pieces:
        assert len(reference(text[piece.start : piece.end])) == piece.tokens <= limit
    for one, two in zip(pieces, pieces[1:]):
        assert one.start < two.start < one.end < two.end
        assert 1 <= len(reference(text[two.start : one.end])) == two.overlap <= overlap
    return pieces


LINES = "\n".join(f"Host {'AB'[n % 2]}: The queue number {n} is short, and it is tried again. Then it ends." for n in range(400))


@pytest.mark.parametrize("text", [LINES, "x" * 20_000, "汉" * 9_000, "字，" * 4000, "word " * 5000, " " * 9000, "\n\n" * 3000, "👩‍👩‍👧" * 900, ("para one.\n\n" * 9 + "# head\n") * 120, "é" * 5000, "a.b" * 4000, "\n  \n x" * 2000])
def test_pieces(text, own, reference):
    assert len(check(text, own, reference)) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "中文", "。", "\n", "\n\n", "# h\n", "  ", "A: ", "longlonglong", "é", "1", "\r\n", "\t", "'s "]), min_size=60, max_size=400).map("".join))
def test_random_pieces(own, reference, text):
    check(text, own, reference, limit=150, overlap=64)


def test_boundaries_are_chosen_by_strength(own, reference):
    for one in check(LINES, own, reference)[:-1]:
        assert LINES[one.end :].startswith("Host") and one.strength == splitting.TURN
    heads = ("A sentence of some words stands here. " * 40 + "\n\n# Heading\n\n") * 8
    for one in check(heads, own, reference)[:-1]:
        assert one.strength >= splitting.PARAGRAPH


def test_range_maximum():
    import numpy as np

    values = np.asarray([3, 1, 3, 2, 3, 0, 1])
    table = splitting.RangeMaximum(values)
    for first in range(7):
        for last in range(first, 7):
            best = values[first : last + 1].max()
            assert table.query(first, last) == max(n for n in range(first, last + 1) if values[n] == best)


def test_split_table(spark):
    frame = spark.createDataFrame([(1, LINES, 0), (2, "short", 0), (3, "", 0), (4, None, 0), (5, "  ", 0)], "doc_id long, text string, piece int")
    out = splitting.split_table(frame).collect()
    assert {x.doc_id for x in out} == {1, 2, 5} and [x.piece for x in sorted(out) if x.doc_id == 1] == list(range(sum(x.doc_id == 1 for x in out)))
    assert all(x.text == LINES[x.start : x.end] for x in out if x.doc_id == 1)
    assert splitting.split_table(frame.limit(0)).count() == 0
