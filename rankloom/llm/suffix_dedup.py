"""Removal of repeated passages with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. All documents that
hold a string must meet in one suffix array, and no array may hold the whole corpus; so windows of LENGTH bytes are dealt
to shards by content:

1. The anchor of a window is the smallest hash of its GRAM-byte strings; equal windows have equal anchors. Each document
   sends its distinct anchors, packed, to the partition of their hash, which returns to each document those that another
   document has too. All other windows cannot repeat elsewhere and need no further work.
2. Runs of windows with one shared anchor are segments of text. A segment goes to the shard of its anchor; if more than
   HOT documents share an anchor, its windows are dealt by second anchors of FINE bytes instead, so that no more than
   LENGTH - FINE bytes on each side of a common passage gather with it.
3. A shard keeps distinct segments, each with its smallest document. Those whose anchor another distinct one has too are
   laid end to end; their suffix array is built by induced sorting, and the runs of suffixes whose permuted common
   prefixes hold LENGTH bytes give each window's smallest document. Windows owned by a smaller document than their own
   are returned as ranges of bytes.
4. Ranges of a document are united and cut out of its bytes.

Exact copies need none of this: all windows of a copy start in the first of its kind too, so it goes whole (if it has a
window), and only the first sends segments; of a task's copies, only the first sends anchors. Copies are found by the SHA-256 of the text, counted before it is shuffled.

Anchors only narrow down what is compared: they are cut to 48 bits, where a chance hit sends a segment to a shard in
vain. Segments are compared byte by byte, windows by the suffix arrays.

A task gathers what it sends by partition, not by slice of text or by shard, and a partition holds several shards: there
are as many packed rows as tasks (more, if they read more than SEND_BYTES) times partitions.

Bound: the entries of one anchor (14 bytes for each document that isn't a copy) meet in one task, and so do those of one
window of 50 bytes (some 70 bytes each). A passage that ten million different documents share takes such a task about a
gigabyte; beyond that, entries of one anchor would have to be split too.

Defined results: a null text is empty; a document without an id is judged as the largest; rows of one id are not smaller
than each other, so repeated rows don't remove each other; texts under LENGTH bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expanded, extended, keeps, lean, prepared, release, scope, slices, squeezed, table, written
from .shingles import _up_to, forget_powers, mixed
from .suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 20
#: Documents that share an anchor beyond which its windows are dealt by second anchors, and the bytes of those.
HOT, FINE = 20_000, 44
#: Bytes of text that are hashed at once: few enough for what is computed from them to stay in a core's cache.
HASH_BYTES = 1 << 16
#: Anchors that a partition of the first exchange, and bytes that a shard of the second, should hold.
PART_ANCHORS, SHARD_BYTES = 1_200_000, 2_000_000
#: Shards that a partition of the second exchange holds, and how many parts of anchors there are to a bucket of documents.
PART_SHARDS, PART_BUCKETS = 8, 4
#: One anchor in so many bytes, roughly, and bytes of a segment; only to size partitions.
ANCHOR_EVERY, SEGMENT_BYTES = 16, 64

_VALUE = np.random.default_rng(50_210).integers(1, 1 << 63, 256, dtype=np.uint64)
_LARGEST = np.iinfo(np.int64).max
_U16 = np.uint64(16)

keeps(__name__, forget_powers)


def _rows(batch: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row keys, all bytes of some rows, and where each row's bytes start (one more at the end)."""
    texts = batch.column("text").slice(low, high - low).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    ids, keys = (batch.column(n).slice(low, high - low).to_numpy(zero_copy_only=False) for n in ("id", "row"))
    return ids, keys, data, offsets - offsets[0]


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any string of bytes is taken."""
    up, _ = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    _, down = _up_to(len(sums))
    return mixed((sums[starts + sizes] - sums[starts]) * down[starts])


def anchored(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, one past the last window, anchor (48 bits)."""
    n, span = len(data), LENGTH - GRAM + 1
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.empty(0, np.uint64)
    sums = _sums(data)
    _, down = _up_to(n + 1)
    least = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    size = 1
    while 2 * size <= span:  # smallest of 2, 4, ... hashes
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: n - LENGTH + 1], least[span - size : span - size + n - LENGTH + 1])
    least = least >> _U16
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= starts[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    past = np.append(first[1:], len(least))
    keep = inside[first]
    first, past = first[keep], past[keep]
    return row[first], first, past, least[first]


def _packed48(anchors: np.ndarray) -> bytes:
    """Six bytes each: the upper four of all, then the lower two of all."""
    return (anchors >> _U16).astype("<u4").tobytes() + (anchors & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpacked48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << _U16) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows whose text a row of a smaller or equal id before them in the task has too: only a text's first row needs
    to know its anchors, so that a text that very many rows hold is sent about once a task."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        keep = []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            digest = hashlib.blake2b(text.as_buffer(), digest_size=16).digest()
            keep.append(i < seen.get(digest, i + 1))
            if keep[-1]:
                seen[digest] = i
        yield batch if all(keep) else batch.filter(pa.array(keep))


#: Anchors that a task gathers before it sends them on.
SEND_ANCHORS = 1_500_000


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """The stable order of whole numbers from 0, all smaller than ``below``; fast where two bytes hold them."""
    return np.argsort(values.astype(np.uint16 if below <= 1 << 16 else np.int64), kind="stable")


def _anchors(n_parts: int):
    """Distinct anchors of each document, packed by part."""

    def sent(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc, anchor, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        part = (anchor % np.uint64(n_parts)).astype(np.int64)
        order = _order(part, n_parts)
        doc, anchor, part = doc[order], anchor[order], part[order]
        at, out = _starts(part), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = _starts(doc[a:b])
            out.append((int(part[a]), _packed48(anchor[a:b]), np.diff(own).astype("<i4").tobytes(), keys[doc[a:b][own[:-1]]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["part", "anchors", "counts", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0
        for batch in _first_copies(batches):
            for low, high in slices(batch.column("text"), HASH_BYTES):
                _, keys, data, starts = _rows(batch, low, high)
                row, _, _, anchor = anchored(data, starts)
                if not len(row):
                    continue
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                once = _starts(row, anchor)[:-1]
                held.append((row[once] + docs, anchor[once], keys))
                docs, size = docs + len(keys), size + len(once)
                if size >= SEND_ANCHORS:
                    yield sent(held)
                    docs = size = 0
        if held:
            yield sent(held)

    return run


#: Values of documents, packed by bucket of documents.
_DEALT = "bucket long, ids binary, rows binary, counts binary, values binary"


def _to_documents(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Rows of _DEALT from a value (64 bits) with its document's id and row key each."""
    bucket = (mixed(keys.view(np.uint64) ^ ids.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((values, keys, ids, bucket))
    ids, keys, values, bucket = ids[order], keys[order], values[order], bucket[order]
    pack, at, out = zstandard.ZstdCompressor(level=1).compress, _starts(bucket), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = _starts(ids[a:b], keys[a:b])
        out.append((int(bucket[a]), ids[a:b][own[:-1]].tobytes(), keys[a:b][own[:-1]].tobytes(), np.diff(own).astype("<i4").tobytes(), pack(values[a:b].tobytes())))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "ids", "rows", "counts", "values"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, values): one row a document, its values in ascending order."""
    unpack, held = zstandard.ZstdDecompressor().decompress, ([], [], [])
    for batch in batches:
        for i, k, n, v in zip(*(batch.column(c) for c in ("ids", "rows", "counts", "values")), strict=True):
            counts = np.frombuffer(n.as_py(), "<i4")
            held[0].append(np.repeat(np.frombuffer(i.as_py(), "<i8"), counts))
            held[1].append(np.repeat(np.frombuffer(k.as_py(), "<i8"), counts))
            held[2].append(np.frombuffer(unpack(v.as_py()), "<u8"))
    if not held[0]:
        return
    ids, keys, values = (np.concatenate(x) for x in held)
    order = np.lexsort((values, keys, ids))
    ids, keys, values = ids[order], keys[order], values[order]
    at = _starts(ids, keys)
    for low in range(0, len(at) - 1, 2048):
        own = at[low : low + 2049]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[own[:-1]]), pa.array(keys[own[:-1]]), pa.array([values[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())],
            names=["id", "row", "values"],
        )


def _shared(n_buckets: int):
    """Anchors that another row has, to their rows; bit 63 marks those that very many have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, keys = [], []
        for batch in batches:
            for a, n, k in zip(*(batch.column(c) for c in ("anchors", "counts", "rows")), strict=True):
                anchors.append(_unpacked48(a.as_py()))
                keys.append(np.repeat(np.frombuffer(k.as_py(), "<i8"), np.frombuffer(n.as_py(), "<i4")))
        if not anchors:
            return
        anchor, key = np.concatenate(anchors), np.concatenate(keys)
        del anchors, keys
        order = np.argsort(anchor)
        anchor, key = anchor[order], key[order]
        at = _starts(anchor)
        count, at = np.diff(at), at[:-1]
        apart = np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at)
        keep, hot = np.repeat(apart, count), np.repeat(count > HOT, count)
        anchor, key = anchor[keep] | (hot[keep].astype(np.uint64) << np.uint64(63)), key[keep]
        if len(key):
            yield _to_documents(np.zeros(len(key), np.int64), key, anchor, n_buckets)

    return run


def _marked(column: pa.Array, row: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (row, anchor) is in the row's list of packed anchors, and whether it is marked there as hot."""
    lists = [np.frombuffer(x.as_py(), "<u8") for x in column]
    every = np.concatenate(lists)
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.uint64) << np.uint64(48)
    known, hot = (every & np.uint64((1 << 48) - 1)) | of, every >> np.uint64(63) > 0
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    asked = anchor | (row.astype(np.uint64) << np.uint64(48))
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    found = known[at] == asked
    return found, found & hot[at]


#: Bytes of segments that a task gathers before it sends them on; longer parts compress better.
SEND_BYTES = 24 << 20


def _finer(sums: np.ndarray, row: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut where the second anchor of their windows changes, the smallest hash of their FINE-byte strings."""
    width = past - first
    segment = np.repeat(np.arange(len(row)), width)
    each = np.arange(len(segment)) + (first - np.cumsum(width) + width)[segment]
    least = _hashes(sums, each, FINE)
    for k in range(1, LENGTH - FINE + 1):
        least = np.minimum(least, _hashes(sums, each + k, FINE))
    at = _starts(segment, least)
    head = at[:-1]
    return row[segment[head]], each[head], each[head] + np.diff(at), least[head]


def _segments(n_shards: int, n_parts: int):
    """Segments of windows with shared anchors, packed by part; the shards of a part lie one after another."""

    def sent(held: list[tuple]) -> pa.RecordBatch:
        row, first, past, start, shard, ids, keys, texts = zip(*held, strict=True)
        held.clear()
        row, first, past, start, shard, ids, keys = (np.concatenate(x) for x in (row, first, past, start, shard, ids, keys))
        whole, pack, out = b"".join(texts), zstandard.ZstdCompressor(level=3).compress, []
        part = shard % n_parts
        order = _order(part * -(-n_shards // n_parts) + shard // n_parts, n_shards + n_parts)
        row, first, past, start, shard, part = (x[order] for x in (row, first, past, start, shard, part))
        at = _starts(part)
        for a, b in zip(at[:-1], at[1:], strict=True):
            docs = _starts(shard[a:b], row[a:b])
            some, of = row[a:b][docs[:-1]], shard[a:b][docs[:-1]]
            shards = _starts(of)
            cut = b"".join([whole[i:j] for i, j in zip(first[a:b].tolist(), (past[a:b] + (LENGTH - 1)).tolist(), strict=True)])
            out.append((
                int(part[a]), of[shards[:-1]].astype("<i4").tobytes(), np.diff(shards).astype("<i4").tobytes(), ids[some].tobytes(), keys[some].tobytes(), np.diff(docs).astype("<i4").tobytes(),
                pack(start[a:b].astype("<i8").tobytes()), pack((past - first + LENGTH - 1)[a:b].astype("<i4").tobytes()), pack(cut),
            ))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[f.split(" ")[0] for f in _SEGMENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, place, size = [], 0, 0, 0
        for batch in expanded(batches):
            for low, high in slices(batch.column("text"), HASH_BYTES):
                own = batch.slice(low, high - low)
                ids, keys, data, starts = _rows(own, 0, own.num_rows)
                row, first, past, anchor = anchored(data, starts)
                if not len(row):
                    continue
                keep, hot = _marked(own.column("values"), row, anchor)
                row, first, past, anchor, hot = row[keep], first[keep], past[keep], anchor[keep], hot[keep]
                if hot.any():
                    fine = _finer(_sums(data), row[hot], first[hot], past[hot])
                    row, first, past, anchor = (np.concatenate([x[~hot], y]) for x, y in zip((row, first, past, anchor), fine, strict=True))
                    order = np.lexsort((first, row))
                    row, first, past, anchor = row[order], first[order], past[order], anchor[order]
                if not len(row):
                    continue
                shard = (anchor % np.uint64(n_shards)).astype(np.int64)
                held.append((row + docs, first + place, past + place, first - starts[row], shard, ids, keys, data.tobytes()))
                docs, place, size = docs + len(ids), place + len(data), size + int((past - first + LENGTH - 1).sum())
                if max(place, size) >= SEND_BYTES:
                    yield sent(held)
                    docs = place = size = 0
        if held:
            yield sent(held)

    return run


#: Rows that ``_segments`` sends: of each shard how many documents, of each of these how many segments, and the segments.
_SEGMENTS = "part long, shards binary, documents binary, ids binary, rows binary, counts binary, starts binary, sizes binary, bytes binary"


def owned(ids: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments laid end to end: for each window, its segment and whether a smaller document holds it too."""
    begins = np.cumsum(sizes, dtype=np.int64) - sizes
    # Equal segments are one, of the smallest document.
    whole, known = data.tobytes(), {}
    kind = np.array([known.setdefault(whole[a : a + n], len(known)) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)], np.int64)
    del whole, known
    some = np.unique(kind, return_index=True)[1]
    least = np.full(len(some), _LARGEST)
    np.minimum.at(least, kind, ids)
    # Equal windows have equal anchors, so only segments whose anchor another one has may share windows with others.
    heads = data[(begins[some][:, None] + np.arange(LENGTH)).ravel()]
    anchor = anchored(heads, np.arange(len(some) + 1) * LENGTH)[3]
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    met = members[group] > 1
    n = (sizes - LENGTH + 1).astype(np.int64)
    of, owner = np.repeat(np.arange(len(sizes), dtype=np.int32), n), np.repeat(least[kind], n)
    if met.any():
        owned_by, to = _owners(data, begins[some[met]], sizes[some[met]].astype(np.int64), least[met])
        place = np.zeros(len(some), np.int64)
        place[met] = to
        inner = met[kind]
        m, first = n[inner], place[kind[inner]]
        owner[np.repeat(inner, n)] = owned_by[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())]
    return of, owner < ids[of]


def _owners(data: np.ndarray, begins: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each window of distinct segments, and where each segment's windows start in that array."""
    # Segments end to end, each followed by a zero byte, which ends no window.
    to = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.uint8)
    inside = np.ones(len(text), bool)
    inside[to + size] = False
    text[inside] = data[np.repeat((begins - np.cumsum(size) + size).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)]
    del inside
    suffixes = suffix_array(text)
    agree = common_prefixes(text, suffixes) >= LENGTH
    segment = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    window = np.zeros(len(text), bool)
    counts = size - LENGTH + 1
    window[np.repeat((to - np.cumsum(counts) + counts).astype(np.int32), counts) + np.arange(counts.sum(), dtype=np.int32)] = True
    # Suffixes that start no window keep their places, so that runs are cut where the common prefix is.
    owner = np.where(window[suffixes], least[segment[suffixes]], _LARGEST)
    heads = np.flatnonzero(~agree[suffixes])
    best = np.empty(len(text), np.int64)
    best[suffixes] = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(suffixes))))
    return best, to


def _removals(n_buckets: int):
    """Ranges of bytes that go, to their documents: the start in the upper, the size in the lower half of a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        cut: list[bytes] = []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda name, kind, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_py(), kind)
                counts = read("counts", "<i4")
                shard = np.repeat(read("shards", "<i4"), read("documents", "<i4"))
                for own, values in zip(held, (shard, read("ids", "<i8"), read("rows", "<i8")), strict=False):
                    own.append(np.repeat(values, counts))
                for own, (name, kind) in zip(held[3:], (("starts", "<i8"), ("sizes", "<i4")), strict=True):
                    own.append(np.frombuffer(unpack(batch.column(name)[i].as_py()), kind))
                cut.append(unpack(batch.column("bytes")[i].as_py()))
        if not cut:
            return
        shards, *columns = (np.concatenate(x) for x in held)
        held.clear()
        whole = b"".join(cut)
        cut.clear()
        begins = np.cumsum(columns[3], dtype=np.int64) - columns[3]
        order = np.argsort(shards, kind="stable")
        at, found = _starts(shards[order]), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            some = order[a:b]
            ids, keys, starts, sizes = (x[some] for x in columns)
            data = np.frombuffer(b"".join([whole[i : i + n] for i, n in zip(begins[some].tolist(), sizes.tolist(), strict=True)]), np.uint8)
            of, gone = owned(ids, sizes, data)
            n = (sizes - LENGTH + 1).astype(np.int64)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            of, inner = of[gone], inner[gone]
            if not len(of):
                continue
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (inner[1:] != inner[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(of)) - 1
            own, low, size = of[head], starts[of[head]] + inner[head], inner[tail] - inner[head] + LENGTH
            found.append((ids[own], keys[own], (low.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)))
        if found:
            yield _to_documents(*(np.concatenate(x) for x in zip(*found, strict=True)), n_buckets)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what is left of each text, and what was cut; ``read`` is what is left as a string, null for a null text."""
    for batch in expanded(batches):
        left, removed, spans, total, read = [], [], [], [], []
        for text, ranges, copy in zip(batch.column("text"), batch.column("values"), batch.column("copy"), strict=True):
            data, at, out, cut = (text.as_py() or "").encode(), 0, [], []
            if copy.is_valid:
                cut = [[0, len(data)]] if len(data) >= LENGTH else []
            elif ranges.is_valid:
                packed = np.frombuffer(ranges.as_py(), "<u8")
                low, size = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
                for a, b in zip(low.tolist(), (low + size).tolist(), strict=True):
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], b)
                    else:
                        cut.append([a, b])
            for a, b in cut:
                out.append(data[at:a])
                at = b
            out.append(data[at:])
            left.append(b"".join(out))
            read.append(left[-1].decode(errors="ignore") if text.is_valid else None)
            total.append(len(data))
            removed.append(sum(b - a for a, b in cut))
            spans.append(len(cut))
        yield extended(batch.drop_columns(["values", "copy"]), n_bytes=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), left=pa.array(left, pa.binary()), read=pa.array(read, pa.string()))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, ``left`` (the bytes that stay) and ``read`` (their whole characters) to rows with
    doc_id and text; columns of these names are replaced."""
    prepared(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "left", "read")]
    # What rows carry is boxed, so that no column of theirs clashes with those needed here.
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST)).alias("id"), "text", row).withColumn("row", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    texts = rows.select("id", "row", F.coalesce("text", F.lit("")).alias("text"))
    with scope() as keep:
        digests = texts.select("id", "row", F.unhex(F.sha2("text", 256)).alias("digest"))
        first = written(digests.groupBy("digest").agg(F.min("id").alias("first")), "first")
        copies = keep(written(digests.join(first, "digest").where("id > first").select("id", "row", F.lit(True).alias("copy")).distinct(), "copies"))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_parts = max(-(-size // (ANCHOR_EVERY * PART_ANCHORS)), min(12, size // 1_000_000 + 1))
        n_buckets = max(-(-n_parts // PART_BUCKETS), min(12, n_parts))
        packed = texts.mapInArrow(lean(_anchors(n_parts)), "part long, anchors binary, counts binary, rows binary")
        dealt = packed.repartitionById(n_parts, F.col("part").cast("int")).mapInArrow(lean(_shared(n_buckets)), _DEALT)
        shared = written(dealt.repartitionById(n_buckets, F.col("bucket").cast("int")).mapInArrow(lean(_by_document), "id long, row long, values binary"), "shared")
        release(docs.sparkSession)
        n_shared = shared.agg(F.sum(F.octet_length("values") / 8)).first()[0] or 0
        n_shards = max(int(n_shared * SEGMENT_BYTES // SHARD_BYTES) + 1, min(12, size // 1_000_000 + 1))
        # Hints: a join by broadcast would put two functions of Python into one task.
        wanted = squeezed(texts).join(shared.select("row", "values").hint("merge"), "row").join(copies.select("id", "row"), ["id", "row"], "left_anti")
        own_parts = max(-(-n_shards // PART_SHARDS), min(12, n_shards))
        segments = wanted.mapInArrow(lean(_segments(n_shards, own_parts)), _SEGMENTS)
        dealt = segments.repartitionById(own_parts, F.col("part").cast("int")).mapInArrow(lean(_removals(n_buckets)), _DEALT)
        ranges = keep(written(dealt.repartitionById(n_buckets, F.col("bucket").cast("int")).mapInArrow(lean(_by_document), "id long, row long, values binary"), "ranges"))
    release(docs.sparkSession)
    gone = ranges.join(copies, ["id", "row"], "full")
    joined = squeezed(rows).join(gone.hint("merge"), ["id", "row"], "left").select("text", "carried", "values", "copy")
    fields = "n_bytes long, n_removed long, n_spans long, left binary, read string"
    done = joined.mapInArrow(lean(_cut), f"text string, carried {rows.schema['carried'].dataType.simpleString()}, {fields}")
    new = [f.split(" ")[0] for f in fields.split(", ")]
    return done.select(*["text" if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c == "text" or c in others], *new)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))


def stage_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; of a character that a cut splits, the rest goes too. All documents stay."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]  # the text is moved once
    done = deduplicated(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row")))
    new = {"text": F.col("read"), "n_chars": F.length("read").cast("long")}
    return done.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


#: By all strings of 50 bytes, which is too much for large tables.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS s FROM d, unnest(range(1, greatest(octet_length(b) - 48, 1))) AS t(i)),
o AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN o USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS h FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM r GROUP BY doc_id) USING (doc_id)
"""
