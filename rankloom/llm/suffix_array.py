"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost smaller ones (LMS) are
sorted by their substrings up to the next LMS place, which one induced pass does; equal substrings get one name, and
where names repeat, the string of names is sorted by recursion: names are written as one, two or three bytes, and the
order of its suffixes is the order of the places at which names begin. From the sorted LMS suffixes two linear passes
induce the order of all others. A pass goes through the symbols in order and handles a whole bucket at once: places that
a run of the bucket's own symbol leads to are found from the runs' lengths, all others are appended to the buckets of
their symbols in stable order, which is the order of the one-by-one scan.

Names in bytes may have as many LMS places as there are names, and then recursion doesn't shorten its string. Where the
string of names isn't SHORTER than its text, names are sorted by pairs, fours and so on instead, which is n log n.
"""

from __future__ import annotations

import numpy as np

N_SYMBOLS = 256
#: Share of a text's length that the string of its names may have to be sorted by recursion.
SHORTER = 0.75


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the one at the end is larger than the empty one."""
    n = len(text)
    rises = np.empty(n, bool)
    differs = np.empty(n, bool)
    rises[:-1], differs[:-1] = text[:-1] < text[1:], text[:-1] != text[1:]
    rises[-1], differs[-1] = False, True
    # A run of one symbol is of the type of its last place.
    at = np.flatnonzero(differs)
    return np.repeat(rises[at], np.diff(at, prepend=-1))


def _run_places(text: np.ndarray) -> np.ndarray:
    """How many places of its run of one symbol lie up to each place, itself included."""
    starts = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
    sizes = np.diff(starts, append=len(text))
    return (np.arange(1, len(text) + 1) - np.repeat(starts, sizes)).astype(np.int32)


def _dealt(buckets: list[list[np.ndarray]], text: np.ndarray, places: np.ndarray) -> None:
    """Appends places to the buckets of their symbols, in their order."""
    if not len(places):
        return
    symbols = text[places]
    if len(places) == 1:
        buckets[symbols[0]].append(places)
        return
    places, counts = places[np.argsort(symbols, kind="stable")], np.bincount(symbols, minlength=N_SYMBOLS)
    at = 0
    for c in np.flatnonzero(counts).tolist():
        buckets[c].append(places[at : at + counts[c]])
        at += counts[c]


def _with_runs(places: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that end runs of one symbol, followed by the places before them in their runs, those one before first, then
    those two before; and which of all begin a run."""
    sizes = run[places]
    if not len(places) or sizes.max() == 1:
        return places, places
    back = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    every = (np.repeat(places, sizes) - back)[np.argsort(back, kind="stable")]
    return every, every[run[every] == 1]


def _induced(text: np.ndarray, smaller: np.ndarray, run: np.ndarray, lms: np.ndarray) -> list[np.ndarray]:
    """All suffixes by bucket, induced from LMS suffixes in the given order."""
    empty = np.empty(0, np.int32)
    joined = lambda parts: empty if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts)
    starts: list[list[np.ndarray]] = [[] for _ in range(N_SYMBOLS)]
    _dealt(starts, text, lms)
    larger: list[list[np.ndarray]] = [[] for _ in range(N_SYMBOLS)]
    larger[text[-1]].append(np.array([len(text) - 1], np.int32))  # from the empty suffix
    l_part: list[np.ndarray] = [empty] * N_SYMBOLS
    for c in range(N_SYMBOLS):
        if larger[c]:
            l_part[c], heads = _with_runs(joined(larger[c]), run)
            larger[c] = []
            before = heads[heads > 0] - 1
            _dealt(larger, text, before[~smaller[before]])
        if starts[c]:
            before = joined(starts[c]) - 1  # an LMS place has a larger one before it
            _dealt(larger, text, before)
    done: list[np.ndarray] = [empty] * N_SYMBOLS
    small: list[list[np.ndarray]] = [[] for _ in range(N_SYMBOLS)]
    for c in range(N_SYMBOLS - 1, -1, -1):
        s_part = empty
        if small[c]:
            s_part, heads = _with_runs(joined(small[c]), run)
            small[c] = []
            before = heads[heads > 0] - 1
            _dealt(small, text, before[smaller[before]])
        if len(l_part[c]):
            back = l_part[c][::-1]
            before = back[back > 0] - 1
            _dealt(small, text, before[smaller[before]])
        done[c] = np.concatenate([l_part[c], s_part[::-1]]) if len(s_part) else l_part[c]
    return done


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names (0 or more): by names, then pairs, fours and so on until none repeats.

    A suffix's rank is the place of the first of its group; only groups of two or more are sorted again.
    """
    n, counts = len(names), np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names].astype(np.int64)
    open_, width = np.flatnonzero(counts[names] > 1), 1
    while len(open_):
        after = np.zeros(len(open_), np.int64)
        inside = open_ + width < n
        after[inside] = rank[open_[inside] + width] + 1
        key = rank[open_] * (n + 1) + after
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = rank[open_]
        first = np.ones(len(open_), bool)
        first[1:] = group[1:] != group[:-1]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        place = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(first, place, 0))
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - start
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_, width = open_[~alone], 2 * width
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _names_sorted(names: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes of the string of names of a text of n symbols."""
    count = int(names.max()) + 1
    width = 1 if count <= 1 << 8 else 2 if count <= 1 << 16 else 3 if count <= 1 << 24 else 4
    if width * len(names) > SHORTER * n:
        return _by_doubling(names)
    order = suffix_array(names.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width :].ravel())
    return order if width == 1 else order[order % width == 0] // width


def _words(text: np.ndarray, more: int) -> np.ndarray:
    """The eight symbols from each place on as one integer, zeros after the end; ``more`` places after the end too."""
    padded = np.concatenate([text, np.zeros(more + 8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, shape=(len(text) + more + 1, 8), strides=(1, 1)).copy().view("<u8").ravel()


def _equal_to_previous(text: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it."""
    same = np.zeros(len(places), bool)
    same[1:] = sizes[1:] == sizes[:-1]
    words, whole = _words(text, 8), None
    open_, k = np.flatnonzero(same), 0
    while len(open_) > 16:  # eight symbols at once
        left = np.minimum(sizes[open_] - k, 8).astype(np.uint64)
        differ = (words[places[open_] + k] ^ words[places[open_ - 1] + k]) << (np.uint64(8) * (np.uint64(8) - left))
        same[open_[differ != 0]] = False
        open_ = open_[(differ == 0) & (sizes[open_] > k + 8)]
        k += 8
    for i in open_.tolist():
        whole = whole or text.tobytes()
        a, b, size = int(places[i]), int(places[i - 1]), int(sizes[i])
        same[i] = whole[a + k : a + size] == whole[b + k : b + size]
    return same


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a uint8 array in ascending order."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int32)
    smaller, run = _types(text), _run_places(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = np.concatenate([b[is_lms[b]] for b in _induced(text, smaller, run, lms)])
        ends = np.empty(n, np.int32)
        ends[lms] = np.append(lms[1:] + 1, n)
        same = _equal_to_previous(text, by_substring, ends[by_substring] - by_substring)
        # The substring at the end of the text is followed by nothing and equals no other.
        last = lms[-1]
        same[1:] &= (by_substring[1:] != last) & (by_substring[:-1] != last)
        names_sorted = np.cumsum(~same) - 1
        if names_sorted[-1] + 1 < len(lms):
            name = np.empty(n, np.int32)
            name[by_substring] = names_sorted
            lms = lms[_names_sorted(name[lms], n)]
        else:
            lms = by_substring
    return np.concatenate(_induced(text, smaller, run, lms))


def _agreement(text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many symbols each two suffixes have in common; ``right`` may be n, the empty suffix."""
    n, out = len(text), np.zeros(len(left), np.int32)
    words, most = _words(text, 8), n - np.maximum(left, right)
    open_, k = np.flatnonzero(most > 0), 0
    while len(open_) > 16:
        differ = words[left[open_] + k] ^ words[right[open_] + k]
        # The lowest bit that differs tells how many of the eight agree.
        agree = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
        out[open_] = np.minimum(k + agree, most[open_])
        k += 8
        open_ = open_[(differ == 0) & (most[open_] > k)]
    whole = text.tobytes() if len(open_) else b""
    for i in open_.tolist():
        a, b, size = int(left[i]) + k, int(right[i]) + k, int(most[i]) - k
        low, step = 0, 64
        while low < size:  # longer and longer parts while they agree, then shorter ones
            step = min(step, size - low)
            if whole[a + low : a + low + step] == whole[b + low : b + low + step]:
                low, step = low + step, 2 * step
            elif step == 1:
                break
            else:
                step = max(1, step // 4)
        out[i] = k + low
    return out


def common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """The permuted array of common prefixes: in text order, how many symbols a suffix has in common with the one before
    it in sorted order.

    If the symbols before both are equal, the value is one less than that of the place before. Only the other values are
    found by comparing, of which there are few in repetitive text.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int32)
    before = np.full(n, n, np.int32)
    before[suffixes[1:]] = suffixes[:-1]
    compared = np.ones(n, bool)
    inner = (before[1:] > 0) & (before[1:] < n)
    compared[1:] = ~inner | (text[:-1] != text[np.where(inner, before[1:] - 1, 0)])
    at = np.flatnonzero(compared)
    found = _agreement(text, at, before[at])
    sizes = np.diff(at, append=n)
    return np.maximum(np.repeat(found + at, sizes) - np.arange(n), 0).astype(np.int32)
