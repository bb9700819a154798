"""Hashed word-shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash

from harborline.llm.common import mix64, worker_cache

WIDTH = 5
MAX_ENTRIES = 250_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h



def shingle_set(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles (A-Z lower-cased); a shorter
    text is one shingle as a whole; without words the set is empty."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], _U)
    known = worker_cache("shingles", _WordHashes)
    if len(known) > MAX_ENTRIES:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    n = len(h) - width + 1
    s = h[:n] * _MULT[0]
    for k in range(1, width):
        s += h[k:k + n] * _MULT[k % len(_MULT)]
    s = np.sort(mix64(s))
    if n > 1:
        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
    return s


def set_key(s: np.ndarray) -> bytes:
    """128-bit key of a set."""
    return xxhash.xxh3_128_digest(s.astype("<u8", copy=False).tobytes())
