"""Word shingles of many texts at once, hashed to 64 bits with numpy.

Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased. A word's hash is made of two
polynomials in the bytes' random values modulo the prime 2 ** 31 - 1, taken from prefix sums, so that no loop runs over
words (modulo a power of two, long words of two letters would collide); a shingle's is one in the words' hashes. Texts
longer than a chunk are hashed chunk by chunk, cut at white space.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Of polynomials modulo 2 ** 64, for strings of a few dozen bytes.
_STEP = 0x9E3779B97F4A7C15
_WORD_STEP = np.uint64(0xD1342543DE82EF95)
CHUNK = 1 << 18

PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step, and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, step in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2 ** 62."""
    x = (x & PRIME) + (x >> _BITS)
    x = (x & PRIME) + (x >> _BITS)
    return np.where(x >= PRIME, x - PRIME, x)


class Polynomial:
    """Values of the bytes (capital letters as small ones), and powers of the step and of its inverse, modulo the prime."""

    def __init__(self, salt: int, number: int):
        rng = np.random.default_rng([7_151_924, salt, number])
        self.values = rng.integers(1, int(PRIME), 256, dtype=np.uint64)[_LOWER]
        self.step = int(rng.integers(1 << 20, int(PRIME)))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._powers(s, max(n, 2 * CHUNK + 1)) for s in (self.step, pow(self.step, -1, int(PRIME))))
        return self.up, self.down

    @staticmethod
    def _powers(step: int, size: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < size:  # each doubling multiplies by one power
            out = np.concatenate([out, reduced(out * np.uint64(pow(step, len(out), int(PRIME))))])
        return out[:size].copy()


@functools.lru_cache(2)
def polynomials(salt: int) -> tuple[Polynomial, Polynomial]:
    return Polynomial(salt, 0), Polynomial(salt, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_words(data: np.ndarray, starts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words lie before each text start. ``starts``: where texts start, ascending."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:] = space
    edge[starts[starts < len(data)]] = True
    edge[0] = True
    first = np.flatnonzero(edge[:-1] & ~space)
    edge[:-1] = space
    edge[-1] = True
    ends = starts[(starts > 0) & (starts <= len(data))]
    edge[ends] |= True
    last = np.flatnonzero(edge[1:] & ~space)
    parts = []
    for own in polynomials(salt):
        up, down = own.powers(len(data))
        terms = own.values[data] * up[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        # Terms are folded to 32 bits, so that sums of fewer than 2 ** 29 of them stay below 2 ** 61.
        np.cumsum((terms & PRIME) + (terms >> _BITS), out=sums[1:])
        parts.append(reduced(reduced(sums[last + 1] - sums[first]) * down[first]))
    return mixed((parts[0] << np.uint64(32)) | parts[1]), np.searchsorted(first, starts)


def words_of(texts: pa.Array, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text where its words start (one more at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    if len(data) <= 2 * CHUNK:
        hashes, before = _hashed_words(data, starts, salt)
        return hashes, before
    parts, counts, at, done = [], np.zeros(len(starts), np.int64), 0, 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and not _SPACE[data[to]]:  # a word isn't cut
            gap = np.flatnonzero(_SPACE[data[to : to + CHUNK]])
            to = to + int(gap[0]) if len(gap) else min(to + CHUNK, len(data))
        own = (starts >= at) & (starts <= to)
        hashes, before = _hashed_words(data[at:to], np.unique(starts[own] - at), salt)
        counts[own] = done + before[np.searchsorted(np.unique(starts[own] - at), starts[own] - at)]
        parts.append(hashes)
        done += len(hashes)
        at = to
    return np.concatenate(parts), counts


def shingle_sets(texts: pa.Array, n: int, salt: int = 0) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: of ``n`` words, or of all words where there are fewer.

    Other salts give other hashes, for the case that two different shingles had one hash.
    """
    words, starts = words_of(texts, salt)
    step = _WORD_STEP
    whole = words.copy()
    for k in range(1, n):
        whole[:-k] = whole[:-k] * step + words[k:]
    whole = mixed(whole)
    out = []
    for i in range(len(texts)):
        low, high = int(starts[i]), int(starts[i + 1])
        if high - low >= n:
            out.append(np.unique(whole[low : high - n + 1]))
        elif high > low:
            h = words[low : low + 1].copy()
            for k in range(low + 1, high):
                h = h * step + words[k]
            out.append(mixed(h ^ np.uint64(high - low)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_CASE = bytes(_LOWER)


def normalised(text: str) -> bytes:
    """The words with A-Z in lower case, one space between them; equal ones have equal shingles."""
    return b" ".join(text.encode().translate(_CASE).split())


def exact_shingles(words: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves, of what ``normalised`` returns."""
    every = words.split(b" ") if words else []
    if len(every) < n:
        return {tuple(every)} if every else set()
    return set(zip(*(every[i:] for i in range(n)), strict=False))


def signatures(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """Minwise hashes, one row a set and one column of 32 bits for each of ``n`` functions. Empty sets get zeros."""
    functions = np.random.default_rng(seed).integers(1, 1 << 63, (n, 2), dtype=np.uint64)
    out = np.zeros((len(sets), n), np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    every = np.concatenate([sets[i] for i in filled])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])[:-1]])
    for k, (flip, factor) in enumerate(functions):
        x = (every ^ flip) * (factor | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[filled, k] = np.minimum.reduceat(x, at) >> np.uint64(32)
    return out
