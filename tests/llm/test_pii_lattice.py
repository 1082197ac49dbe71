"""The random field's decoding against a plain dynamic program, and its memory on texts that are one lattice."""

import random
import tracemalloc

import pytest

from gleanery.llm import pii

BITS = ["0", "12", "345", "6789", "1234567890123", "4111 1111 1111 1111", "+1 (555) 010-9999", "a@b.co", "10.0.0.1", "300.1.1.1", "deadbeef12345678", "abcd", "Key", ": ", '"', "'", " ", "  ", "\n", "-", ".", "(", ")", "@", "+", "é", "_", "token = ", "x1y2", "5" * 30, "٣", "Ǆ"]


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def slow_decode(model, text, margin):
    """All paths' best, with every place's scores kept and no segment left out."""
    tokens = pii.Tokens(text)
    by_end = model.lattice(text, tokens)
    best = [{pii.OUTSIDE: (0.0, ())}]
    for j in range(1, len(tokens) + 1):
        v, before = max((v + model.move(b, pii.OUTSIDE), b) for b, (v, _) in best[j - 1].items())
        here = {pii.OUTSIDE: (v, best[j - 1][before][1])}
        for i, features in by_end.get(j, ()):
            for kind, own in zip(pii.KINDS, model.values(features), strict=True):
                v, before = max((v + model.move(b, kind), b) for b, (v, _) in best[i].items())
                v += own - margin
                if kind not in here or v > here[kind][0]:
                    here[kind] = (v, (*best[i][before][1], (tokens.starts[i], tokens.ends[j - 1], kind)))
        best.append(here)
    return list(best[-1][max((v, k) for k, (v, _) in best[-1].items())[1]][1])


def test_decoding_equals_the_plain_program(model):
    rng = random.Random(12)
    found = 0
    for _ in range(200):
        text = "".join(rng.choice(BITS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40)))
        for margin in (0.0, pii.MARGIN):
            want = slow_decode(model, text, margin)
            assert model.decode(text, margin) == want, repr(text)
            found += len(want)
    assert found > 200


@pytest.mark.parametrize("text", ["0 " * 8000, "+1" * 8000, " ".join(random.Random(1).choices("0123456789", k=8000)), ("7" * 1000 + " ") * 40])
def test_a_long_lattice_takes_little_memory(model, text):
    tracemalloc.start()
    try:
        pii.all_spans(text, model)
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
