"""Token counts of every character and of random strings against the library, and a long text without spaces."""

import random

import pytest

from gleanery.llm import token_counts
from test_operators import path


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(path("word_bpe_49k.json"))


def expected(counter, text):
    return len(counter.tok.encode(text, add_special_tokens=False).ids)


def test_every_byte_and_code_point(counter):
    for c in map(chr, range(1, 0x3000)):
        for text in (c, f"one {c} two", f"a{c}b", f"7{c}{c}"):
            assert counter.count(text) == expected(counter, text), repr(text)


def test_random_strings(counter):
    rng = random.Random(8)
    chars = [chr(c) for c in [*range(1, 0x250), 0x301, 0x3A9, 0x3042, 0xAC00, 0x1F600, 0x200D, 0x2028]] + list(" '\x7f<|") * 20
    for _ in range(10_000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 30)))
        if rng.random() < 0.1:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>", "'ll", "'S"])
        n = counter.count(text)
        assert n == expected(counter, text), repr(text)
        table = counter.counts(counter.composed(text))
        assert table[-1] == n
        assert counter.within(text, n // 2) == max(i for i, k in enumerate(table.tolist()) if k <= n // 2), repr(text)


def test_a_text_of_control_characters_in_spark(spark):
    rows = [(1, "one \x7f two"), (2, "\x7f" * 50), (3, "\x00\x01\x1c\x85\xa0")]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path("word_bpe_49k.json"), budget=2).collect()}
    c = token_counts.counter(path("word_bpe_49k.json"))
    assert got == {i: expected(c, t) for i, t in rows}


def test_a_long_text_without_spaces(counter):
    text = "".join(random.Random(3).choices("abcdefgh", k=300_000))
    assert counter.count(text) == expected(counter, text)
