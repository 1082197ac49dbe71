"""Words of Arrow texts, and postings gathered into lists by lexeme, so that no row stands for a single word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IN_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Lists of one Arrow batch.
BATCH_LISTS = 8192


def words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words ``[a-z0-9]+`` of texts in lower case, in their order, and how many each text has. Texts aren't null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[:-1] < at[-1]], at[1:][at[1:] > 0] - 1  # words end where texts do
    first[heads], last[tails] = inside[heads], inside[tails]
    begins = np.flatnonzero(first)
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - begins, out=offsets[1:])
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[inside])), np.diff(np.searchsorted(begins, at))


def places(counts: np.ndarray, start: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its text's number, and its position, from ``start`` on, where texts have so many words."""
    before = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(before - start, counts)


def ranked(coded: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers in the order of the values, -1 for nulls, and the values in order."""
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.full(len(order) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.fill_null(len(order)).to_numpy()], coded.dictionary.take(pa.array(order))


def lists(lexemes: tuple[np.ndarray, pa.Array], weights: tuple[np.ndarray, pa.Array], ids: pa.Array, owners: np.ndarray, positions: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lexeme, weight, entity_ids, positions) in the order of lexeme and weight, of postings that are given by columns.

    Lexemes and weights are numbers and what they stand for, as ``ranked`` gives them; ``owners`` are places in ``ids``. Postings whose lexeme is -1 drop out.
    """
    (lexeme, names), (weight, kinds) = lexemes, weights
    kept = np.flatnonzero(lexeme >= 0)
    if not len(kept):
        return
    packed = np.sort((lexeme[kept] * len(kinds) + weight[kept]) << 32 | kept)
    key, order = packed >> 32, packed & 0xFFFFFFFF
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    offsets = pa.array(np.append(begins, len(key)), pa.int32())
    columns = {
        "lexeme": names.take(pa.array(key[begins] // len(kinds))),
        "weight": kinds.take(pa.array(key[begins] % len(kinds))),
        "entity_ids": pa.ListArray.from_arrays(offsets, ids.take(pa.array(owners[order]))),
        "positions": pa.ListArray.from_arrays(offsets, pa.array(positions[order], pa.int32())),
    }
    made = pa.RecordBatch.from_pydict(columns)
    for k in range(0, made.num_rows, BATCH_LISTS):
        yield made.slice(k, BATCH_LISTS)
