"""Words of many texts as arrays: no Python object per word.

Separators are ASCII characters, so a text's UTF-8 bytes can be cut without
decoding it. Words come as numbers into a dictionary of the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut together; a longer text is cut alone.
SLICE = 4 << 20

#: Every byte as it is, but A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(members: str | bytes) -> np.ndarray:
    """True for the bytes in ``members``."""
    out = np.zeros(256, dtype=bool)
    out[list(members.encode() if isinstance(members, str) else members)] = True
    return out


@dataclass
class Words:
    """The words of some texts in order: ``ids`` into ``dictionary``, the text ``doc`` of each, and a number ``piece`` that changes between pieces and texts."""

    ids: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    dictionary: pa.Array


def cut_words(texts: pa.StringArray, word_break: np.ndarray, piece_break: np.ndarray | None = None) -> Words:
    """``texts`` has no nulls. A-Z are lower-cased; ``piece_break`` bytes (word breaks as well) part words that do not lie next to each other."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~word_break[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    letters = LOWER[raw[inside]]
    bounds = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    coded = words.dictionary_encode()
    doc = np.searchsorted(offsets[1:], starts, "right")
    piece = doc if piece_break is None else doc + np.searchsorted(np.flatnonzero(piece_break[raw]), starts)
    return Words(coded.indices.to_numpy().astype(np.int64), doc, piece, coded.dictionary)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of up to ``limit`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield begin, end
        begin = end
