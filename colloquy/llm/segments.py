"""Splitting a text where no byte-level BPE token can cross, and memos over the pieces.

The pre-tokenizer's pattern only lets a token hold white space in front of other characters, and
looks no further than the next character. Cutting before each run of white space is therefore
exact: the ids of a text are the ids of its segments in order. The cuts of a whole column are found
together on its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# White space as the tokenizers library takes it, the vocabulary's pre-token
# pattern, and the string it holds as one special token.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKENS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
             rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SPECIAL = "<|endoftext|>"

_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_WHITE = [c.encode() for c in map(chr, [
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_LEADS = sorted({(w[0], len(w)) for w in _WIDE_WHITE})
# ASCII letters, digits and other signs; 0 for white space and for bytes of longer characters.
_KIND = np.array([0 if b > 127 or _ASCII_WHITE[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
                  for b in range(256)], np.uint8)
_find_special = re.compile(re.escape(SPECIAL.encode())).finditer


def pieces(texts: pa.Array, most_bytes: int = 1 << 22) -> Iterator[pa.Array]:
    """The texts in runs of about so many bytes; one text is never cut."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most_bytes, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def as_strings(column: pa.Array) -> list[str]:
    """What to_pylist gives, without a scalar object per value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = _ASCII_WHITE[data]
    for lead, size in _LEADS:
        at = np.flatnonzero(data[: len(data) - size + 1] == lead)
        if len(at):
            code = np.zeros(len(at), np.int64)
            for i in range(size):
                code = code << 8 | data[at + i]
            at = at[np.isin(code, [int.from_bytes(w) for w in _WIDE_WHITE if len(w) == size])]
            for i in range(size):
                white[at + i] = True
    return white


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All segments of the texts in order, and for each text, and the end, the place of its first one.

    Segments also end where ASCII letters, digits and other signs meet, since a token ends there too; only
    an apostrophe may hold the letters after it. The special token is a segment of its own. `texts` is an array of strings without nulls; the
    segments share its bytes.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(ends[0]), int(ends[-1])
    if low == high:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    buffer = texts.buffers()[2].slice(low, high - low)
    data, ends = np.frombuffer(buffer, np.uint8), ends - low
    white = _white(data)
    begin = np.zeros(len(data) + 1, bool)
    kind = _KIND[data]
    here, before = kind[1:], kind[:-1]
    begin[1:-1] = (white[1:] & ~white[:-1]) | (
        (here != before) & (here > 0) & (before > 0) & ((data[:-1] != ord("'")) | (here != 1)))
    begin[ends] = True
    for found in _find_special(buffer):
        if np.searchsorted(ends, found.start(), "right") == np.searchsorted(ends, found.end() - 1, "right"):
            begin[found.start() : found.end()] = False
            begin[[found.start(), found.end()]] = True
    starts = np.flatnonzero(begin).astype(np.int32)
    segments = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), buffer)
    return segments, np.searchsorted(starts, ends)


class Memo(dict):
    """Remembers what `make` gives for short keys; cleared when it has `most` entries."""

    def __init__(self, make: Callable, most: int = 900_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
