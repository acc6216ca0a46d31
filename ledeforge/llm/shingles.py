"""Word shingle sets as arrays of 64-bit hashes, for operators that run in Python."""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5
#: Bytes of a text that are hashed at once, but for one longer word.
CHUNK = 1 << 16
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: A word's hash is a polynomial of its bytes' codes, with this odd factor; its inverse modulo 2 ** 64 takes a place away again.
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT[1])


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse."""
    up, down = np.full(size, _STEP, dtype=np.uint64), np.full(size, _BACK, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hashed(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words in some bytes: differences of one running sum, each shifted to the word's own places."""
    word = np.zeros(len(raw) + 2, dtype=bool)
    word[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(CHUNK, 1 << len(raw).bit_length()))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased; bytes have exactly those rules for case and white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(raw) <= CHUNK:
        return _hashed(raw)
    cuts, spaces = [0], np.flatnonzero(_SPACE[raw])
    while len(raw) - cuts[-1] > CHUNK:
        # the last space within reach, else the next one
        k = int(np.searchsorted(spaces, cuts[-1] + CHUNK))
        at = spaces[k - 1] if k and spaces[k - 1] > cuts[-1] else spaces[k] if k < len(spaces) else len(raw)
        cuts.append(int(at))
    return np.concatenate([_hashed(raw[x:y]) for x, y in zip(cuts, [*cuts[1:], len(raw)], strict=True)])


def windows(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One hash for each run of ``width`` words, in order: a sum with odd factors, which tells orders apart, then mixed."""
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + n] * (_MULT[k % 5] + np.uint64(2 * (k // 5)))
    return mixed(total)


def shingle_list(text: str | None, width: int = WIDTH) -> np.ndarray:
    """All shingles in order; a shorter text is one shingle, one without words has none."""
    h = word_hashes(text)
    return windows(h, min(width, len(h))) if len(h) else h


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(shingle_list(text, width))
