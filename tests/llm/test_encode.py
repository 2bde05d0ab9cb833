import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import encode

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    return encode.encoder()


@pytest.fixture(scope="module")
def back():
    return encode.decoder()


TEXTS = [" ", "  \n\t x  ", "<|endoftext|> and <|startoftext|>", "naïve coördinated 12345", "東京都に行く。在第8872步，内部的曲线", "a" * 50_000, "🙂👩‍👩‍👧 ok", "\r\n\r\n", "don't WE'LL I'm", "ab" * 20_000, "\u0000\u0001"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text, library, mine, back):
    ids = mine(text)
    assert ids == library(text)
    assert back(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=300))
def test_round_trip(text):
    global _pair
    try:
        e, d = _pair
    except NameError:
        e, d = _pair = encode.encoder(), encode.decoder()
    assert d(e(text)) == text.encode()


def test_priority_queue_equals_plain_merging():
    ranks = encode.load_ranks()
    rng = random.Random(3)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        word = bytes(rng.choice(b"abcdeost \xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert encode.bpe(word, ranks) == plain(word)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    e = encode.encoder()
    text = "one two three four five six one two seven"
    assert e(text) == library(text)


def test_columns_and_cases(spark):
    rows = [(1, "hello", "x"), (2, "", "y"), (3, None, "z"), (1, "hello", "x"), (None, "hello", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode.encoded(df, "doc_id", "text")
    assert out.columns == ["doc_id", "ids"]
    assert sorted(((r.doc_id, r.ids) for r in out.collect()), key=str) == sorted([(1, [31373]), (2, []), (3, []), (1, [31373]), (None, [31373])], key=str)
    assert encode.encoded(df.limit(0), "doc_id", "text").collect() == []
    assert sorted(r.n_tokens for r in encode.token_counts(df, "doc_id", "text").collect()) == [0, 0, 1, 1, 1]
