"""Compression classifier: zstandard dictionaries of good and of bad text score whole documents.

Two dictionaries are built from labelled text. Every block of a text is compressed with each; the difference of the
compressed sizes, divided by the text's size, is turned into a probability by a logistic curve fitted on labelled
documents that the dictionaries haven't seen. Labels are the only input besides texts, and only at fitting.

Bounds: at most SAMPLE labelled documents a class are used for fitting, chosen by a hash of the document's id, and of
each at most SAMPLE_BLOCKS blocks, chosen by a hash too; scoring reads every block of every text.

Defined results: a null or empty text has difference 0 and so the score of the curve's middle term; without labelled
rows of both classes every score is 0.5; repeated rows are scored each; repeated label rows, conflicting ones too, count
each; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, extended, lean, prepared, table, with_fields

BLOCK = 2048
SAMPLE = 1500
SAMPLE_BLOCKS = 8
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.7


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self) -> Scorer:
        return Scorer(self)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if own is not None:
        own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.good, self.bad = model, _compressor(model.good), _compressor(model.bad)

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves over the bad one, as a share of the text's bytes."""
        data = (text or "").encode()
        if not data:
            return 0.0
        good, bad = self.good.compress, self.bad.compress
        return sum(len(bad(b)) - len(good(b)) for b in blocks(data)) / len(data)

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.difference(text) + self.model.intercept
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _curve(pairs: list[tuple[float, int]], shares: tuple[float, float]) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (difference, label); the classes weigh as their shares."""
    n = {y: max(1, sum(1 for _, v in pairs if v == y)) for y in (0, 1)}
    spread = math.sqrt(sum(x * x for x, _ in pairs) / len(pairs)) or 1.0
    a = b = 0.0
    for _ in range(50):  # Newton steps with a little shrinkage
        g0, g1, h00, h01, h11 = 0.0, 1e-3 * a, 1e-9, 0.0, 1e-3
        for x, y in pairs:
            u = x / spread
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * u + b))))
            w = shares[y] / n[y]
            g1, g0 = g1 + w * (p - y) * u, g0 + w * (p - y)
            q = w * p * (1 - p)
            h11, h01, h00 = h11 + q * u * u, h01 + q * u, h00 + q
        det = h00 * h11 - h01 * h01
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return a / spread, b


def fit(samples: list[tuple[str, int]], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """From (text, label): half of them, by a hash of the text, make the dictionaries, the others fit the curve.

    shares: of labels 0 and 1 among all labelled documents, to which the scores are calibrated.
    """
    held: dict[int, list[bytes]] = {0: [], 1: []}
    rest = []
    for text, label in samples:
        data = text.encode()
        if zlib.crc32(b"half" + data) % 2:
            own = sorted(blocks(data), key=lambda b: zlib.crc32(b))
            held[label] += own[:SAMPLE_BLOCKS]
        else:
            rest.append((text, label))
    if not held[0] or not held[1] or {y for _, y in rest} != {0, 1}:
        return Model(b"", b"", 0.0, 0.0)
    draft = Model(_dictionary(sorted(held[1])), _dictionary(sorted(held[0])), 1.0, 0.0)
    differ = draft.scorer().difference
    slope, intercept = _curve([(differ(t), y) for t, y in sorted(rest)], shares)
    return Model(draft.good, draft.bad, slope, intercept)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled documents that aren't held out: at most ``sample`` a class, gathered by the driver."""
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values()) or 1
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("quality = 1").orderBy(*order).limit(sample).unionByName(usable.where("quality = 0").orderBy(*order).limit(sample))
    # At most 2 * sample ids are broadcast. Of a text, only as many blocks as the fit can use are gathered.
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    starts = f"transform(sequence(0, greatest(length(text) - 1, 0) div {BLOCK}), i -> i * {BLOCK} + 1)"
    some = f"slice(array_sort({starts}, (a, b) -> cast(sign(xxhash64(doc_id, a) - 0D - xxhash64(doc_id, b)) as int)), 1, {SAMPLE_BLOCKS})"
    text = F.expr(f"array_join(transform(array_sort({some}), p -> substring(text, p, {BLOCK})), '')")
    rows = found.select("doc_id", text.alias("text"), "quality").collect()
    return fit([(r.text, r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.quality, r.text))], (n.get(0, 0) / total, n.get(1, 0) / total))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``predicted``; columns of these names are replaced."""
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer().score
        for batch in batches:
            found = [score(x.as_py()) for x in batch.column(text)]
            yield extended(batch, score=pa.array(found, pa.float64()), predicted=pa.array([int(x >= THRESHOLD) for x in found], pa.int32()))

    return docs.mapInArrow(lean(run), with_fields(docs.schema, ("score", "double"), ("predicted", "int")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    done = scored(docs, trained(docs, labels))
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents predicted to be good; all of them where too few labelled ones are there to learn from."""
    model = trained(docs, table(spark, sf_dir, "labels"))
    if not model.good:
        return docs
    return scored(boxed(docs, "text"), model).where("predicted = 1").select("__row.*")
