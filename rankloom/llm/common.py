"""Helpers that the operators of this subpackage share; ``dropped`` and ``scope`` are those of the scratch tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..scratch import dropped, scope
from ..shipping import ship

__all__ = ["boxed", "dropped", "expanded", "extended", "keeps", "lean", "prepared", "release", "runs", "scope", "slices", "squeezed", "table", "with_fields", "written"]

#: Texts are handed to numpy in slices of at most so many bytes (or one text), whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch where the session leaves Spark's default: ten thousand whole documents are too many to hold
#: in both the JVM and a Python worker.
BATCH_ROWS = 1000

#: Bytes of an Arrow batch where the session leaves Spark's default (64 MB).
BATCH_BYTES = 8 << 20

def prepared(spark: SparkSession) -> None:
    """Makes a session fit for the operators: the package on executors, batches of a bounded number of documents.

    A session that leaves the size of Arrow batches at Spark's defaults (10,000 rows, 64 MB) has it set to BATCH_ROWS and
    BATCH_BYTES from then on; other numbers are left alone.
    """
    ship(spark)
    for key, default, own in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    prepared(df.sparkSession)
    return scratch.written(df, label)


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and whole rows in ``__row``: what an operator adds can't clash with a column of the rows."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: What modules keep from task to task in a worker, and how to give it up. A worker lives on and serves other operators.
_caches: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    """Says how to empty the caches that functions of ``module`` fill in a worker."""
    _caches[module] = forget


def _forget_others(module: str) -> None:
    for other, forget in _caches.items():
        if other != module:
            forget()


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow; the worker first empties the caches of other modules, and gives freed memory back in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_others(f.__module__)
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are written; it does so when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def squeezed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The text column as compressed bytes (binary; null texts stay null), to be moved by an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                own = batch.slice(low, 1024)
                yield extended(own, **{text: pa.array([pack(x.as_py().encode()) if x.is_valid else None for x in own.column(text)], pa.binary())})

    return rows.mapInArrow(lean(run), with_fields(rows.schema, (text, "binary")))


def expanded(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches with the texts that ``squeezed`` packed."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            own = batch.slice(low, rows)
            yield extended(own, **{text: pa.array([unpack(x.as_py()) if x.is_valid else None for x in own.column(text)], pa.binary()).cast(pa.string())})


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and keys[low] != current:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            current = keys[low]
    if held:
        yield pa.Table.from_batches(held)


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold at most ``max_bytes`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > max_bytes:
            yield at, i
            at, held = i, 0
        held += int(n)
    if len(sizes) > at:
        yield at, len(sizes)


def with_fields(schema, *fields: tuple[str, str]) -> str:
    """DDL of ``schema`` with more fields after it; a field of the same name is replaced in its place."""
    new = dict(fields)
    old = [f"`{f.name}` {new.pop(f.name, f.dataType.simpleString())}" for f in schema.fields]
    return ", ".join(old + [f"`{n}` {t}" for n, t in new.items()])


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns put after it; those of the same name are replaced in their place."""
    pairs = [(n, columns.pop(n, batch.column(i))) for i, n in enumerate(batch.schema.names)] + list(columns.items())
    return pa.RecordBatch.from_arrays([a for _, a in pairs], names=[n for n, _ in pairs])
