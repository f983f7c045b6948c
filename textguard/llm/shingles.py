"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are what stands between spaces and \\t to \\r, with A-Z lower-cased. A word's hash comes from prefix
sums of its bytes' random values times powers of an odd number (mod 2**64), so no Python code runs per word;
it is then mixed, and a shingle's hash is a mixed sum over its words.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_STEP = np.uint64(0xD1342543DE82EF95)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
CHUNK_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    step = base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step & (2**64 - 1)
    return out


class _PowerTables:
    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = 2 * n
            self.up = _powers(int(_BASE), self.size)
            self.down = _powers(pow(int(_BASE), -1, 2**64), self.size)
        return self.up, self.down


_tables = _PowerTables()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts).

    ``letters_only`` lower-cases all letters and also ends words at ASCII punctuation.
    """
    if letters_only:
        raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY) for t in texts]
    else:
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    text_start = np.concatenate([[0], sizes.cumsum()])
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _tables.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, text_start)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    hashes, begin = word_hashes(texts)
    n = len(hashes)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(size):
                total += hashes[k : n - size + 1 + k] * factor
                factor = factor * _WORD_STEP
        total = mix(total)
    out = []
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo >= size:
            part = np.sort(total[lo : hi - size + 1])
            if len(part) > 1:
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            out.append(part)
        elif hi > lo:
            one, factor = np.uint64(hi - lo), np.uint64(1)
            with np.errstate(over="ignore"):
                for h in hashes[lo:hi]:
                    factor = factor * _WORD_STEP
                    one = one + h * factor
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_chunks(texts: list[str | None]):
    """Index ranges of about ``CHUNK_BYTES`` characters each (one longer text is a range of its own)."""
    return in_chunks_of([len(t or "") for t in texts])


def in_chunks_of(sizes: list[int], most: int = CHUNK_BYTES):
    """The same from the sizes of texts."""
    start, size = 0, 0
    for k, more in enumerate(sizes):
        size += more
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
