"""Words of whole Arrow batches, cut by classes of bytes with numpy.

The classes are given per byte, so they suit rules whose separators are all ASCII: every byte of a longer
UTF-8 character is then part of a word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WORD, BLANK, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32   # A-Z only


class Words(NamedTuple):
    words: object        # pyarrow string array, in text order
    row: np.ndarray      # row of each word
    opens: np.ndarray    # whether a word is the first of its row or stands behind a BREAK


def class_table(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(blanks)] = BLANK
    table[list(breaks)] = BREAK
    return table


def cut(texts, table: np.ndarray) -> Words:
    """Lower-cased (A-Z) words of a pyarrow string array without nulls."""
    import pyarrow as pa

    rows = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset:texts.offset + rows + 1].astype(np.int64)
    data = (np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]]
            if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8))
    offsets = offsets - offsets[0]
    kinds = table[data]
    inside = kinds == WORD
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[filled] = inside[filled]
    starts = np.flatnonzero(begin)
    row = np.searchsorted(offsets, starts, "right") - 1
    kept = _LOWER[data[inside]]
    # A word ends where the count of word bytes reaches the next word's first byte.
    first = np.cumsum(inside, dtype=np.int64)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    bounds = np.append(first, int(np.count_nonzero(inside))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(kept))
    opens = np.ones(len(starts), bool)
    if len(starts) > 1:
        piece = np.searchsorted(np.flatnonzero(kinds == BREAK), starts)
        opens[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return Words(words, row, opens)
