"""Tokenizing whole texts with a public tokenizer file, remembering the ids of pieces that come again."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Pieces remembered per worker process (twice as many while older ones are still asked for), and the longest that is.
CACHE_PIECES = 400_000
CACHE_CHARS = 48

#: Unicode's white space but for the space and the line feed.
_RARE_WHITE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    return not (text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS) or _RARE_WHITE.search(text))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Punctuation that follows a word as a token run of its own (no apostrophe: it may start a contraction).
_TAIL = ".,;:!?%$&*#|"

#: How byte-level vocabularies write the bytes that are not printable Latin-1, in ascending order from U+0100.
_BYTES = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}


class PieceTokenizer(dict):
    """ids of a text, equal to those of the tokenizer on the whole text; as a dict, the ids of pieces seen so far.

    Both kinds of tokenizer file used here start a new token at a single space or line feed that stands between two
    characters that are not white space, so a text whose white space is all of that form may be encoded piece by piece:
    a line's first word, a space with the next word, a line feed. All other texts are encoded whole. For a tokenizer
    that drops white space (`drops_white`) the pieces are the words. A call looks each distinct piece of its texts up
    once. Pieces are remembered up to CACHE_PIECES.
    """

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.drops_white = not self.tok.encode("\n", add_special_tokens=False).ids

    def forget(self) -> None:
        """Drops the remembered pieces: a worker process outlives its task, and other tasks need the memory."""
        self.clear()
        self.older = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._learn(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _learn(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        letters = word[1:] if word[:1] == " " else word
        if not (letters.isalpha() and (letters.isascii() or max(letters) < "ɐ")):
            return self._whole(piece)
        if len(word) < len(piece):
            return self[word] + self[piece[len(word) :]]
        if self.drops_white and not (word := word.lower()).isalpha():
            return self._whole(piece)
        spelled = word.replace(" ", _BYTES[32]) if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A slice of texts at a time: about 30 bytes are held for each byte of them."""
        plain = [bool(t) and "\0" not in t and _plain(t) for t in texts]
        pieces = iter(self._pieces([t.encode() for t, p in zip(texts, plain, strict=True) if p]))
        return [next(pieces) if p else np.frombuffer(self._whole(t), "<u4") if t else np.zeros(0, "<u4") for t, p in zip(texts, plain, strict=True)]

    def _pieces(self, plain: list[bytes]) -> list[np.ndarray]:
        """The ids of texts that may be cut at their white space."""
        if not plain:
            return []
        data, ends = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([len(t) for t in plain])
        line = data == 10
        first = line | (data == 32)
        first[1:] |= line[:-1]
        first[0] = first[ends[:-1]] = True
        starts = np.flatnonzero(first)
        cut = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        known = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        spelled = [self[p.strip(" \n")] for p in known] if self.drops_white else [self[p] for p in known]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        piece = cut.indices.to_numpy()
        n = size[piece]
        stops = np.cumsum(n)
        shift = (np.cumsum(size) - size)[piece] - (stops - n)
        ids = np.frombuffer(b"".join(spelled), "<u4")[np.repeat(shift, n) + np.arange(stops[-1])]
        return np.split(ids, stops[np.searchsorted(starts, ends[:-1]) - 1])


_LOADED: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]
