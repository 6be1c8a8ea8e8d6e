"""Words of whole texts as numbers of a slice's own vocabulary: exact, and without a Python object a word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tensorloom.llm.common import lower_ascii, utf8

#: Bytes of text that become words at once; a longer text is taken alone, at about 60 bytes a word.
SLICE_BYTES = 4 << 20


def byte_set(chars: bytes, invert: bool = False) -> np.ndarray:
    """A table of the 256 bytes: those of `chars`, or all others."""
    out = np.full(256, invert)
    out[list(chars)] = not invert
    return out


#: Digits, letters in lower case and every byte of a character beyond ASCII.
ALNUM = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), invert=True)


class Words(NamedTuple):
    """ids: each word's place in the vocabulary; bounds: each row's first word, and one more; piece: where a piece changes."""

    ids: np.ndarray
    vocabulary: pa.Array
    bounds: np.ndarray
    piece: np.ndarray | None

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(column: pa.Array, solid: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """The words (maximal runs of `solid` bytes, A-Z in lower case) of a column of texts, in order; nulls have none.

    With `breaks`, each word also gets the number of its piece: rows and these bytes end pieces.
    """
    data, offsets = utf8(column)
    low = lower_ascii(data)
    ok = solid[low]
    n = len(low)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(ok & (first[:n] | np.concatenate(([True], ~ok))[:n]))
    ends = np.flatnonzero(ok & (first[1:] | np.concatenate((~ok, [True]))[1:])) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[ok])))
    coded = strings.dictionary_encode()
    bounds = np.searchsorted(starts, offsets)
    piece = None
    if breaks is not None:
        ended = np.cumsum(breaks[low])[starts] if n else np.zeros(0, np.int64)
        piece = ended + np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(np.asarray(coded.indices, dtype=np.int64), coded.dictionary, bounds, piece)
