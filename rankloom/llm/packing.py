"""Bounded-space online packing of documents into training sequences.

Each partition tokenises its documents and packs them online, with at most OPEN_WINDOWS windows open: a document goes
to the open window that it fits best; when it fits none and no more may be opened, it fills the fullest window up,
which is emitted full, and the rest of it is placed anew. Documents of a sequence or more give full sequences first.
The windows left open at the end of a partition are merged by groups of MERGE partitions: their pieces are laid end to
end into full sequences, and the last tail of a group is cut at powers of two, which need no padding.

Memory is bounded by the open windows, whatever the partition holds; only left-over windows are shuffled, and a merge
task gets at most MERGE * OPEN_WINDOWS of them. Pieces are written once to the shared folder, as both the emitted and
the left-over ones are read.

Defined results: a null text is empty, and its document is the end id alone; repeated rows are packed each; an empty table
gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, lean, prepared, table, written

SEQUENCE = 2048
OPEN_WINDOWS = 64
MERGE = 8
END_ID = 1
#: Words longer than this aren't remembered; the memory is emptied beyond so many words.
LONG_WORD, MEMORY_WORDS = 48, 400_000
#: Marks that may follow a plain word, and how many runs of them are remembered.
MARKS, MEMORY_TAILS = ".,;:!?", 10_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: Characters at which str.split() cuts although the tokenizer does not take them for white space.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

PIECE_DDL = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merges:
    """The merges of a byte-level BPE vocabulary with word ends, run on one lower-case word at a time.

    A word end is written as byte 255, which UTF-8 never holds; the merge of a last byte with it ranks before all
    others. Only for vocabularies whose ids are in the order of their merges, as ``of`` makes sure.
    """

    END = b"\xff"

    def __init__(self, ranks: dict[bytes, int]):
        self.encode = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @classmethod
    def of(cls, path: str) -> Merges | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab, merges = model.get("end_of_word_suffix"), model.get("vocab"), model.get("merges")
        if model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix"):
            return None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if [vocab.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(sorted({*range(256)} - {*shown}))}
        ranks = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if ends else token
            if i < 512 + len(pairs):
                ranks[bytes(byte_of[c] for c in body) + (cls.END if ends else b"")] = i
        return cls(ranks)


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space: words between white space are encoded once and remembered.

    None of the tokenizer's steps (composition, lower case, splitting, merges with word ends) looks over white space,
    so the ids of a text are those of its words. Plain words (letters of Latin-1 texts) go through ``Merges``,
    which gives the tokenizer's ids; all others through the tokenizer. The strings of special tokens are these tokens, as
    the tokenizer has it by itself; a text with one goes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Merges.of(path)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the memory: a worker that lives on idle should be small."""
        self.known = {}

    def _slowly(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > MEMORY_TAILS:
                self.tails = {}
            self.tails[marks] = self._slowly([marks])[0]
        return self.tails[marks]

    def _plain(self, word: str) -> bytes:
        ids = self.merges.encode(word.encode() + Merges.END)
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _learn(self, new: set[str], plain: bool) -> list[str]:
        """Remembers the ids of words, and returns those that are to be forgotten after their text.

        plain: they are of a Latin-1 text in lower case. There, a run of marks after a letter or digit is split off,
        as the tokenizer does, so that only the words before them are remembered.
        """
        other, known, brief = [], self.known, []
        for word in new:
            if not plain:
                other.append(word)
            elif word.isalpha():
                known[word] = self._plain(word)
            else:
                core = word.rstrip(MARKS)
                if core.isalpha() and len(core) <= LONG_WORD:
                    if core not in known:
                        known[core] = self._plain(core)
                    known[word] = known[core] + self._tail(word[len(core) :])
                    brief.append(word)
                else:
                    other.append(word)
        known.update(zip(other, self._slowly(other), strict=True))
        return brief

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. A Latin-1 text is put in lower case, which changes no id."""
        if any(c in text for c in _ODD_SPACE) or any(c in text for c in self.special):
            return self._slowly([text])[0]
        plain = self.merges is not None and (text.isascii() or _is_latin1(text))
        lower = text.lower() if plain else text
        if any(c in lower for c in self.special):  # only in lower case, which the tokenizer doesn't take for the token
            return self._slowly([text])[0]
        words = lower.split()
        every = set(words)
        new = every.difference(self.known)
        brief: list[str] = []
        if new:
            if len(self.known) > MEMORY_WORDS:
                self.forget()
                new = every
            brief = self._learn(new, plain)
        ids = b"".join(map(self.known.__getitem__, words))
        for word in brief:
            del self.known[word]
        if len(text) > LONG_WORD:
            for word in [w for w in new if len(w) > LONG_WORD and w in self.known]:
                del self.known[word]
        return ids


_tokenizers: dict[str, WordTokenizer] = {}


keeps(__name__, _tokenizers.clear)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Best fit into a bounded number of open windows. A piece is (document, start, ids); ids are 4 bytes each."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.open: list[tuple[int, int]] = []  # (room left, number), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def _put(self, at: int, piece: tuple) -> list[tuple[int, list[tuple]]]:
        room, number = self.open.pop(at)
        self.held[number].append(piece)
        room -= len(piece[2]) // 4
        if room == 0:
            return [(number, self.held.pop(number))]
        bisect.insort(self.open, (room, number))
        return []

    def _fresh(self) -> int:
        self.held[self.next] = []
        bisect.insort(self.open, (self.size, self.next))
        self.next += 1
        return bisect.bisect_left(self.open, (self.size, self.next - 1))

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list[tuple]]]:
        """Packs one document; yields the sequences that this completes."""
        total, at, full = len(ids) // 4, 0, self.size * 4
        while total - at >= self.size:
            yield self.next, [(doc, at, ids[at * 4 : at * 4 + full])]
            self.next += 1
            at += self.size
        while at < total:
            need = total - at
            i = bisect.bisect_left(self.open, (need, -1))
            if i < len(self.open):
                yield from self._put(i, (doc, at, ids[at * 4 :]))
                return
            if len(self.open) < self.most_open:
                yield from self._put(self._fresh(), (doc, at, ids[at * 4 :]))
                return
            room = self.open[0][0]
            yield from self._put(0, (doc, at, ids[at * 4 : (at + room) * 4]))
            at += room

    def left(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from sorted(self.held.items())


def _rows(sequence: int, pieces: list[tuple]) -> Iterator[tuple]:
    at = 0
    for (row, total), start, ids in pieces:
        n = len(ids) // 4
        yield row, start, n, ids, total, sequence, at
        at += n


def _batch(keep: pa.Schema, rows: list[tuple], left_over: list[bool], group: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    arrays = [pa.array([r[i] for r in cols[0]], type=f.type) for i, f in enumerate(keep)]
    arrays += [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    arrays += [pa.array(left_over, pa.bool_()), pa.array([group] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep.names, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "__left", "__group"])


def _flushes(keep: pa.Schema, group: int, stream: Iterator[tuple[tuple, bool]]) -> Iterator[pa.RecordBatch]:
    rows, flags, held = [], [], 0
    for row, left in stream:
        rows.append(row)
        flags.append(left)
        held += len(row[3])
        if held >= 4 << 20:
            yield _batch(keep, rows, flags, group)
            rows, flags, held = [], [], 0
    if rows:
        yield _batch(keep, rows, flags, group)


def packed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, size: int = SEQUENCE, most_open: int = OPEN_WINDOWS, merge: int = MERGE) -> DataFrame:
    """One row for each piece: the ``keep`` columns of its document, then start, length, ids (little-endian unsigned
    32-bit, as binary), doc_tokens, sequence_id and offset; kept columns of these names are replaced."""
    prepared(docs.sparkSession)
    taken = {f.split(" ")[0] for f in PIECE_DDL.split(", ")} | {"__left", "__group", "__text"}
    keep = tuple(c for c in keep if c not in taken)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(*keep, F.col(text).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    keep_ddl = ", ".join(f"`{c}` {types[c]}" for c in keep)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, packer = TaskContext.get().partitionId(), tokenizer(path), Packer(size, most_open)
        schema: list[pa.Schema] = []
        end = np.array([END_ID], "<u4").tobytes()

        def stream():
            for batch in batches:
                own = batch.schema.names[:-1]
                schema[:] = [pa.schema([batch.schema.field(n) for n in own])]
                columns = [batch.column(n).to_pylist() for n in own]
                for i, value in enumerate(batch.column("__text")):
                    ids = encode(value.as_py() or "") + end
                    for number, pieces in packer.add((tuple(c[i] for c in columns), len(ids) // 4), ids):
                        for row in _rows((part << 32) + number, pieces):
                            yield row, False
            for number, pieces in packer.left():
                for row in _rows((part << 32) + number, pieces):
                    yield row, True
            encode.forget()

        stream = stream()
        first = next(stream, None)
        if first is not None:
            def again():
                yield first
                yield from stream
            yield from _flushes(schema[0], part // merge, again())

    pieces = written(source.mapInArrow(lean(pack), f"{keep_ddl}, {PIECE_DDL}, __left boolean, __group long"), "pieces")

    def join_up(batch: pa.Table) -> pa.Table:
        """Lays the left-over pieces of a group end to end; sequences keep the numbers of the windows that they use up."""
        names = [c for c in batch.schema.names if not c.startswith("__")]
        rows = sorted(batch.select(names).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        numbers = iter(sorted({r["sequence_id"] for r in rows}))
        spare = max((r["sequence_id"] for r in rows), default=0)
        rest = sum(r["length"] for r in rows)
        out, room, at, number = [], 0, 0, None
        for r in rows:
            ids, start = r["ids"], r["start"]
            while ids:
                if room == 0:
                    room = size if rest >= size else 1 << (rest.bit_length() - 1)
                    number, at = next(numbers, None), 0
                    if number is None:  # a tail has more parts than there were windows
                        spare += 1
                        number = spare | (1 << 31)
                take = min(room, len(ids) // 4)
                out.append(r | {"start": start, "length": take, "ids": ids[: take * 4], "sequence_id": number, "offset": at})
                ids, start, at, room, rest = ids[take * 4 :], start + take, at + take, room - take, rest - take
        return pa.Table.from_pylist(out, schema=batch.select(names).schema)

    done = pieces.where(~F.col("__left")).drop("__left", "__group")
    merged = pieces.where("__left").drop("__left").groupBy("__group").applyInArrow(join_up, f"{keep_ddl}, {PIECE_DDL}")
    return done.unionByName(merged)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids."""
    return packed(docs.select("doc_id", "text"))
