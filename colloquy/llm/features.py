"""Hashed word features: n-grams and skip-grams of whole texts."""

from __future__ import annotations

import re
import zlib

import numpy as np

from colloquy.llm.segments import Memo

BITS = 20
words_of = re.compile(r"\w+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word(word: str) -> int:
    raw = word.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 1)


def word_memo() -> Memo:
    return Memo(_word)


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * _A
    return ((x ^ (x >> np.uint64(29))) * _B) >> np.uint64(64 - BITS)


def hashed(text: str, memo: Memo, grams: int = 2, skips: int = 1) -> np.ndarray:
    """The distinct buckets of a text's word n-grams up to `grams` and skip-grams over up to `skips` words."""
    h = np.fromiter(map(memo.__getitem__, words_of(text.lower())), np.uint64)
    out, run = [_mix(h, 1)], h
    for n in range(2, grams + 1):
        if len(h) < n:
            break
        run = run[:-1] * _B + h[n - 1 :]
        out.append(_mix(run, n))
    for gap in range(2, skips + 2):
        if len(h) > gap:
            out.append(_mix(h[:-gap] * _B + h[gap:], 100 + gap))
    return np.unique(np.concatenate(out)).astype(np.int32)
