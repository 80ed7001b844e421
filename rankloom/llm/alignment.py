"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together.

Tokens A are those of a byte-level vocabulary over space + text, tokens B those of a piece vocabulary over text, which adds
the space itself. Both cover the same bytes: cumulative sums of the tokens' sizes are their ends, ends that both have
(``intersect1d``) cut the bytes into groups, ``searchsorted`` labels every token with its group, and the tokens that end at
a cut are linked with each other (counts at each cut, spread out by ``repeat``).

Texts are cut into units at every single space with no white space on either side: no token of A reaches over such a
place (a match of the vocabulary's pattern begins there), nor does one of B (no piece holds a space after something
else, which is checked). A text's ids, groups and links are those of its units, put together: new units are joined by spaces
and aligned many at once, and remembered, as most come again. Memory is that of a slice of texts, or of one text, and of
the remembered units.

Of two tokens that end together, one is a suffix of the other. So the id pairs that can ever be linked follow from the
vocabularies: at most one for each byte of each token of either, some hundred thousand. They are numbered in that order,
tasks count the links of their rows in one vector, counts are summed in two shuffles (by pair and salt, then by pair), and
the table of all counts, bounded by the vocabularies whatever the corpus holds, is broadcast to the rows' links.

Defined results: a text that is null or empty, or of which the joined bytes of A or B differ from space + text, has no
tokens: zeros and an empty digest. Repeated rows count each; an empty table stays empty; columns of the results' names are
replaced. Vocabularies with tokens without bytes are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import extended, keeps, lean, prepared, slices, table, with_fields, written

#: Units longer than this aren't remembered; of others about twice so many: beyond, those that didn't come again are forgotten.
LONG_UNIT, MEMORY_UNITS = 48, 250_000
#: Characters of new units that are aligned at once, and units of a text that are put together at once.
PART_BYTES, PART_UNITS = 1 << 19, 100_000
#: Parts of a pair's partial counts in the first of two sums.
SALTS = 16

#: A single space without white space around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(sorted({*range(256)} - {*shown}))}


class ByteLevel:
    """Ids of a byte-level vocabulary, special tokens' strings being plain text. Vocabularies whose ids are in the order of
    their merges are run by the rank library, which gives the same ids faster; others by the tokenizer itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        model, byte_of = spec["model"], byte_alphabet()
        special = {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        self.data = [b""] * (max([*model["vocab"].values(), *special]) + 1)
        for token, i in model["vocab"].items():
            if i not in special:
                self.data[i] = bytes(byte_of[c] for c in token)
        for i, content in special.items():
            self.data[i] = content.encode()
        split = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ranked = self.splits and ids == sorted(set(ids)) and not model.get("ignore_merges") and all(len(self.data[i]) == 1 for i in range(ids[0] if ids else 0))
        self.quick = None
        if ranked:
            ranks = {token: i for i, token in enumerate(self.data) if i not in special}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.quick is not None:
            return self.quick.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece vocabulary, which adds the space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.data = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Ids, groups and links of texts; holds the vocabularies and the units that were met."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if not all(self.a.data) or not all(self.b.data):
            raise ValueError("a token without bytes")
        self.size_a, self.size_b = (np.array([len(x) for x in side.data], "i8") for side in (self.a, self.b))
        self.n_b = len(self.b.data)
        self.splits = self.a.splits and self.b.splits
        self.pairs = self._pairs()
        shown = [[str(i).encode() for i in range(len(side.data))] for side in (self.a, self.b)]
        self.shown = [x + mark for own in shown for mark in (b",", b"|", b";") for x in own]
        #: Of a unit: how many tokens A and B it has, its links and its groups as they are written; None where the joined bytes differ.
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        self.before = self.known  # what was known when the memory was last full

    def _pairs(self) -> np.ndarray:
        """Codes a * n_b + b of all pairs of which one is a suffix of the other, ascending."""
        with_bytes: dict[bytes, tuple[list[int], list[int]]] = {}
        for side, own in enumerate((self.a, self.b)):
            for i, data in enumerate(own.data):
                with_bytes.setdefault(data, ([], []))[side].append(i)
        found = set()
        for i, data in enumerate(self.a.data):
            found.update(i * self.n_b + j for k in range(len(data)) for j in with_bytes.get(data[k:], ((), ()))[1])
        for j, data in enumerate(self.b.data):
            found.update(i * self.n_b + j for k in range(len(data)) for i in with_bytes.get(data[k:], ((), ()))[0])
        return np.array(sorted(found), "i8")

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of the text by either vocabulary; None where the joined bytes differ."""
        a, b, wanted = self.a.ids(text), self.b.ids(text), b" " + text.encode()
        same = b"".join(map(self.a.data.__getitem__, a)) == wanted and b"".join(map(self.b.data.__getitem__, b)) == wanted
        return (a, b) if same else None

    def _alone(self, text: str) -> tuple[int, int, bytes, bytes] | None:
        ids = self._encoded(text)
        return None if ids is None else self.align(*ids, [len(text.encode()) + 1])[0]

    def _learn(self, units: list[str]) -> dict[str, tuple[int, int, bytes, bytes] | None]:
        """Aligns units that neither start nor end with white space: joined by spaces, as many as PART_BYTES at once."""
        out = {}
        at = 0
        while at < len(units):
            held, high = 0, at
            while high < len(units) and (high == at or held < PART_BYTES):
                held += len(units[high])
                high += 1
            some = units[at:high]
            ids = self._encoded(" ".join(some))
            if ids is None:
                out.update((u, self._alone(u)) for u in some)
            else:
                out.update(zip(some, self.align(*ids, np.cumsum([len(u.encode()) + 1 for u in some])), strict=True))
            at = high
        return out

    def _unknown(self, cut: list[list[str]]) -> set[str]:
        """Units that aren't remembered; those of the time before are from now on."""
        new = set().union(*cut).difference(self.known)
        again = new.intersection(self.before)
        self.known.update((u, self.before[u]) for u in again)
        return new - again

    def aligned(self, texts: list[str | None]) -> list[tuple[int, int, int, bytes, str]]:
        """Tokens A and B, groups, links (numbers of their pairs) and the digest of the written groups of each text."""
        nothing = (0, 0, 0, b"", "")
        cut = [[] if not t else t.split(" ") if self.splits else [t] for t in texts]
        new = self._unknown(cut)
        edged = {u for u in new if not u or u[0].isspace() or u[-1].isspace()}
        if edged and self.splits:
            cut = [_CUT.split(t) if t and not edged.isdisjoint(units) else units for t, units in zip(texts, cut, strict=True)]
            new = self._unknown(cut)
            edged = {u for u in new if u[0].isspace() or u[-1].isspace()}  # at the ends of texts
        elif not self.splits:
            edged = new
        if len(self.known) > MEMORY_UNITS:
            self.before, self.known = self.known, {}
            new = self._unknown(cut) - edged
        brief = {u: self._alone(u) for u in edged} | self._learn([u for u in new if len(u) > LONG_UNIT and u not in edged])
        self.known.update(self._learn([u for u in new if len(u) <= LONG_UNIT and u not in edged]))
        out, known = [], self.known
        for text, units in zip(texts, cut, strict=True):
            if brief:
                found = [brief[u] if u in brief else known[u] for u in units]
            else:
                found = list(map(known.__getitem__, units))
            if None in found:  # whole, as nothing is known of how its parts are written
                found = [self._alone(text)]
            out.append(self._total(found) if found and found[0] is not None else nothing)
        return out

    def _total(self, found: list[tuple[int, int, bytes, bytes]]) -> tuple[int, int, int, bytes, str]:
        digest, n_a, n_b, n_groups, links = hashlib.sha256(), 0, 0, 0, []
        for at in range(0, len(found), PART_UNITS):
            a, b, some, shown = zip(*found[at : at + PART_UNITS], strict=True)
            text = b";".join(shown)
            digest.update(b";" + text if at else text)
            n_a, n_b, n_groups = n_a + sum(a), n_b + sum(b), n_groups + text.count(b";") + 1
            links.append(b"".join(some))
        return n_a, n_b, n_groups, b"".join(links), digest.hexdigest()

    def align(self, ids_a: list[int], ids_b: list[int], unit_ends) -> list[tuple[int, int, bytes, bytes]]:
        """What ``known`` holds for consecutive units that end at these bytes, from the ids of them all."""
        ids_a, ids_b = np.array(ids_a, "i8"), np.array(ids_b, "i8")
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # Tokens [low, high) end at a cut, all of either side with all of the other; those before high are in its group.
        low_a, high_a = np.searchsorted(ends_a, cuts), np.searchsorted(ends_a, cuts, "right")
        low_b, high_b = np.searchsorted(ends_b, cuts), np.searchsorted(ends_b, cuts, "right")
        n = (high_a - low_a) * (high_b - low_b)
        at, first = np.repeat(np.arange(len(cuts)), n), np.cumsum(n) - n
        nth, wide = np.arange(len(at)) - np.repeat(first, n), np.repeat(high_b - low_b, n)
        codes = ids_a[low_a[at] + nth // wide] * self.n_b + ids_b[low_b[at] + nth % wide]
        links = np.searchsorted(self.pairs, codes).astype("<i4").tobytes()
        shown = list(map(self.shown.__getitem__, self._order(ids_a, ids_b, group_a, group_b, high_a, high_b).tolist()))
        last = np.searchsorted(cuts, unit_ends)  # the last group of each unit
        out, a0, b0, l0 = [], 0, 0, 0
        for a1, b1, l1 in zip(high_a[last].tolist(), high_b[last].tolist(), (first + n)[last].tolist(), strict=True):
            out.append((a1 - a0, b1 - b0, links[4 * l0 : 4 * l1], b"".join(shown[a0 + b0 : a1 + b1])[:-1]))
            a0, b0, l0 = a1, b1, l1
        return out

    def _order(self, ids_a, ids_b, group_a, group_b, high_a, high_b) -> np.ndarray:
        """Tokens in the order in which groups are written, each as its place in ``shown`` (id and the mark after it)."""
        n_a, n_b = len(self.a.data), self.n_b
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], high_b])[group_a]
        place_b = np.arange(len(ids_b)) + high_a[group_b]
        last_a, last_b = np.zeros(len(ids_a), "i8"), np.zeros(len(ids_b), "i8")
        last_a[high_a - 1], last_b[high_b - 1] = 1, 2
        out = np.empty(len(ids_a) + len(ids_b), "i8")
        out[place_a], out[place_b] = ids_a + n_a * last_a, ids_b + 3 * n_a + n_b * last_b
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


keeps(__name__, _aligners.clear)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The ``keep`` columns with n_a, n_b, n_groups, n_links (long), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``) and ``links``:
    numbers of the linked pairs in the order of the text, as little-endian 32-bit integers (binary)."""
    prepared(docs.sparkSession)
    paths = _paths(path_a, path_b)
    fields = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("links", "binary")]
    keep = tuple(c for c in keep if c not in dict(fields) and c != "__text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for low, high in slices(batch.column("__text")):
                some = batch.slice(low, high - low)
                n_a, n_b, n_groups, links, shown = zip(*own.aligned(some.column("__text").to_pylist()), strict=True)
                columns = {
                    "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "n_groups": pa.array(n_groups, pa.int64()),
                    "n_links": pa.array([len(x) // 4 for x in links], pa.int64()), "groups_sha256": pa.array(shown, pa.string()), "links": pa.array(links, pa.binary()),
                }
                yield extended(some.drop_columns(["__text"]), **columns)

    return source.mapInArrow(lean(run), with_fields(source.drop("__text").schema, *fields))


def pair_counts(rows: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """pair, id_a, id_b, n (links that hold the pair) and best (whether no other pair of id_b has more) of ``links``."""
    paths = _paths(path_a, path_b)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        n = np.zeros(len(own.pairs), "i8")
        for batch in batches:
            for links in batch.column("links"):
                found, times = np.unique(np.frombuffer(links.as_py(), "<i4"), return_counts=True)
                n[found] += times
        pair = np.flatnonzero(n)
        id_a, id_b = np.divmod(own.pairs[pair], own.n_b)
        salt = np.full(len(pair), TaskContext.get().partitionId() % SALTS)
        arrays = [pa.array(pair, pa.int32()), pa.array(id_a, pa.int32()), pa.array(id_b, pa.int32()), pa.array(salt, pa.int32()), pa.array(n[pair], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["pair", "id_a", "id_b", "salt", "n"])

    partial = rows.select("links").mapInArrow(lean(count), "pair int, id_a int, id_b int, salt int, n long")
    salted = partial.groupBy("pair", "id_a", "id_b", "salt").agg(F.sum("n").alias("n"))
    total = salted.groupBy("pair", "id_a", "id_b").agg(F.sum("n").alias("n"))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("id_b")))


def with_counts(rows: DataFrame, counts: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``rows`` with n_best and count_sum (long) in place of ``links``. ``counts`` is gathered, one row a pair: the
    vocabularies bound it (see above), whatever the number of rows."""
    spark = rows.sparkSession
    found = counts.select("pair", "n", "best").toArrow()
    size = len(aligner(*_paths(path_a, path_b)).pairs)
    n, best = np.zeros(size, "i8"), np.zeros(size, bool)
    at = found.column("pair").to_numpy()
    n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast((n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            some = [np.frombuffer(x.as_py(), "<i4") for x in batch.column("links")]
            n_best, count_sum = [int(np.count_nonzero(best[x])) for x in some], [int(n[x].sum()) for x in some]
            yield extended(batch.drop_columns(["links"]), n_best=pa.array(n_best, pa.int64()), count_sum=pa.array(count_sum, pa.int64()))

    return rows.mapInArrow(lean(run), with_fields(rows.drop("links").schema, ("n_best", "long"), ("count_sum", "long")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(aligned(table(spark, sf_dir, "documents").select("doc_id", "text")), "aligned")
    done = with_counts(rows, pair_counts(rows))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
