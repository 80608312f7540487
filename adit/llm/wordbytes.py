"""Words of Arrow string arrays by byte classes, without a Python object per word.

A table gives every byte its class: inside a word, separator, or separator that
also ends a piece. Separators are ASCII, so the bytes of a multi-byte character
are always inside a word. The bytes of words, laid end to end, are the data of
a new Arrow array.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INSIDE, BETWEEN, ENDS = 0, 1, 2


class Words(NamedTuple):
    """``text``: the words in order; ``row``: the text of each; ``piece``: a number that changes at every piece's end."""

    text: pa.StringArray
    row: np.ndarray
    piece: np.ndarray


def byte_classes(between: bytes, ends: bytes = b"") -> np.ndarray:
    classes = np.full(256, INSIDE, np.uint8)
    classes[list(between)] = BETWEEN
    classes[list(ends)] = ENDS
    return classes


#: The six ASCII white spaces.
WHITE_SPACE = byte_classes(b" \t\n\x0b\x0c\r")


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of at most ``most_bytes``, or of one longer text."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most_bytes, "right")) - 1)
        yield at, to
        at = to


def cut(texts: pa.StringArray, classes: np.ndarray, lower: bool = False) -> Words:
    """Words of all texts; null texts have none. ``lower`` turns A-Z into a-z."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    found = classes[raw]
    inside = found == INSIDE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    row = (np.searchsorted(bounds, starts, "right") - 1).astype(np.int32)
    kept = raw[inside]
    if lower:
        upper = (kept >= ord("A")) & (kept <= ord("Z"))
        kept = kept + upper.astype(np.uint8) * np.uint8(32)
    before = np.cumsum(inside, dtype=np.int32)
    ends = np.append(before[starts] - 1, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept)))
    piece = np.cumsum(found == ENDS, dtype=np.int32)[starts] + row
    return Words(words, row, piece)
