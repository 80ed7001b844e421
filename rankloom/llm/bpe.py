"""Byte-level BPE encoding and decoding as a monoid.

``encode`` halves a text recursively down to leaves that the rank library encodes, and joins the ids of neighbours by
encoding again a window around the cut, growing it on either side until the ids outside provably don't change:

* A side of the window may end at a *fixed boundary*: a place between a letter and one space that something other than
  white space follows. Every match of the pattern starts or ends there, whatever stands around, so the ids beyond it
  depend on the text beyond it alone.
* Inside a run of letters (no apostrophe near, so no contraction ends there) the text on both sides belongs to one
  match. A side may end between two tokens there if the two, encoded together, give the same two tokens again: a
  sequence of which all neighbours agree in this way is the one that the merges produce.
* Otherwise the window doubles, at most to the whole of both halves, which is always right.

``decode`` concatenates the tokens' bytes up the same kind of tree.

Ids are packed as little-endian unsigned 32-bit integers in a binary column. Defined results: a null text is empty, has
no ids and decodes to no bytes; repeated rows are encoded each; a text of any length is encoded whole; an empty table
stays empty; columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, keeps, lean, prepared, table, with_fields

#: Bytes of a leaf, and those that a window takes of either side at first.
LEAF = 4096
WINDOW = 32


class Codec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {rank: token for token, rank in ranks.items()}
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        return self._tree(text.encode())

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.library.encode_ordinary(data.decode())
        half = len(data) // 2
        while data[half] & 0xC0 == 0x80:  # within a character
            half += 1
        left, right = data[:half], data[half:]
        return self.joined(left, self._tree(left), right, self._tree(right))

    def joined(self, left: bytes, a: list[int], right: bytes, b: list[int]) -> list[int]:
        """Ids of ``left + right``, which are cut between characters, from the ids of both."""
        if not left or not right:
            return a + b
        whole, size_a, size_b = left + right, self.window, self.window
        while True:
            start, keep_a = self._left_edge(whole, len(left), a, size_a)
            end, drop_b = self._right_edge(whole, len(left), b, size_b)
            ids = self.library.encode_ordinary(whole[start:end].decode())
            ok_a = not keep_a or self._stable(whole, start, a[keep_a - 1], ids[0])
            ok_b = drop_b == len(b) or self._stable(whole, end, ids[-1], b[drop_b])
            if ok_a and ok_b:
                return a[:keep_a] + ids + b[drop_b:]
            size_a, size_b = (size_a if ok_a else 2 * size_a), (size_b if ok_b else 2 * size_b)

    @staticmethod
    def _around(data: bytes, at: int) -> tuple[str, str]:
        """Some characters before ``at`` and some from it on; ``at`` is between characters."""
        return data[max(at - 16, 0) : at].decode(errors="ignore"), data[at : at + 8].decode(errors="ignore")

    def _fixed(self, before: str, after: str) -> bool:
        """Whether a match starts here in any text that holds these characters."""
        return before[-1:].isalpha() and len(after) > 1 and after[0] == " " and not after[1].isspace()

    def _within(self, before: str, after: str) -> bool:
        """Whether the characters on both sides surely belong to one run of letters."""
        return len(before) >= 4 and before[-4:].isalpha() and after[:1].isalpha()

    def _stable(self, data: bytes, at: int, before: int, after: int) -> bool:
        if self._fixed(*self._around(data, at)):
            return True
        return self.library._encode_single_piece(self.token[before] + self.token[after]) == [before, after]

    def _serves(self, data: bytes, at: int) -> bool:
        if data[at] & 0xC0 == 0x80:
            return False
        around = self._around(data, at)
        return self._fixed(*around) or self._within(*around)

    def _left_edge(self, data: bytes, cut: int, ids: list[int], size: int) -> tuple[int, int]:
        """Where the window starts, at least ``size`` bytes before the cut or at 0, and how many ids stay before it."""
        at = cut
        for keep in range(len(ids) - 1, 0, -1):
            at -= len(self.token[ids[keep]])
            if cut - at >= size and self._serves(data, at):
                return at, keep
        return 0, 0

    def _right_edge(self, data: bytes, cut: int, ids: list[int], size: int) -> tuple[int, int]:
        """Where the window ends, at least ``size`` bytes after the cut or at the end, and the first id that stays."""
        at = cut
        for drop in range(1, len(ids)):
            at += len(self.token[ids[drop - 1]])
            if at - cut >= size and self._serves(data, at):
                return at, drop
        return len(data), len(ids)

    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[str, str], Codec] = {}


keeps(__name__, _codecs.clear)


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary)."""
    prepared(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for batch in batches:
            column = batch.column(text)
            for at in range(0, batch.num_rows, 512):
                own = [np.array(encode(x.as_py() or ""), "<u4").tobytes() for x in column.slice(at, 512)]
                yield extended(batch.slice(at, 512), ids=pa.array(own, pa.binary()))

    return docs.mapInArrow(lean(run), with_fields(docs.schema, ("ids", "binary")))


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of packed ids; null ids give no bytes."""
    prepared(rows.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decode
        for batch in batches:
            column = batch.column(ids)
            for at in range(0, batch.num_rows, 512):
                own = [decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in column.slice(at, 512)]
                yield extended(batch.slice(at, 512), decoded=pa.array(own, pa.binary()))

    return rows.mapInArrow(lean(run), with_fields(rows.schema, ("decoded", "binary")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return decoded(ids).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
