"""Language of a text by a small convolutional network over its bytes.

Filters of several widths run over the bytes of fixed-length windows (ASCII capitals in lower case), the largest response of
each filter in a window goes through a rectifier and a softmax layer. A filter over one-hot bytes is a sum of table rows, one
for each of its places, which is how windows are evaluated, many at once. A document is judged by the mean of its windows'
log-probabilities, weighted by their bytes; every byte of every text lies in a window.

The network is trained in numpy by stochastic gradients (Adam) on the driver, on a bounded sample: of each of the at most
LANGUAGES most frequent languages, at most SAMPLE documents with a letter, chosen by a hash of the id, and of each at most
SAMPLE_WINDOWS windows, spread evenly over the text. Held-out documents and those without id or language teach nothing.
All steps depend on the sample alone, so the same table gives the same network.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all texts where no language could be
learned; the score is the probability of the language returned; ties go to the language that sorts first; with a single
learned language it is always returned; repeated rows are judged each, a repeated id teaches once; an empty table stays
empty; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, lean, prepared, slices, table, with_fields

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
LANGUAGES, SAMPLE, SAMPLE_WINDOWS = 64, 400, 4
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
#: Windows that are evaluated at once: few, so that what is computed on the way stays near the processor.
AT_ONCE = 32

#: Bytes as the network reads them: 0 is the space behind the end of a text.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], "u1")


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in rows of WINDOW, the last one filled up with zeros, and the number of bytes of each."""
    n = -(-len(data) // WINDOW)
    own = np.zeros(n * WINDOW, "u1")
    own[: len(data)] = _LOWER[np.frombuffer(data, "u1")]
    size = np.full(n, WINDOW)
    if n:
        size[-1] = len(data) - (n - 1) * WINDOW
    return own.reshape(n, WINDOW), size


@dataclass(frozen=True)
class Network:
    """tables: for each width, (width, 256, FILTERS); one bias a filter; a layer from all filters to the languages."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    layer: np.ndarray
    bias: np.ndarray

    def features(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window (before the rectifier), and where it is."""
        best, places = [], []
        for tables, bias in zip(self.tables, self.biases, strict=True):
            width = len(tables)
            last = rows.shape[1] - width + 1
            found = tables[0][rows[:, :last]]
            for k in range(1, width):
                found += tables[k][rows[:, k : k + last]]
            at = found.argmax(axis=1)
            best.append(np.take_along_axis(found, at[:, None, :], 1)[:, 0, :] + bias)
            places.append(at)
        return np.concatenate(best, axis=1), places

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for at in range(0, len(rows), AT_ONCE):
            best = [self._largest(tables, rows[at : at + AT_ONCE]) + bias for tables, bias in zip(self.tables, self.biases, strict=True)]
            # Summed for each window alone: a product of matrices may differ in its last digits with their sizes.
            active = np.maximum(np.concatenate(best, axis=1), 0).astype("f8")
            out.append(_log_softmax((active[:, :, None] * self.layer).sum(axis=1) + self.bias))
        return np.concatenate(out)

    @staticmethod
    def _largest(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
        last = rows.shape[1] - len(tables) + 1
        found = tables[0].take(rows[:, :last], axis=0, mode="clip")  # bytes are never out of range
        for k in range(1, len(tables)):
            found += tables[k].take(rows[:, k : k + last], axis=0, mode="clip")
        return found.max(axis=1)

    def judge(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and its probability of each text that isn't empty."""
        cut = [windows(t) for t in texts]
        size = np.concatenate([s for _, s in cut]).astype("f8")
        weighed = self.log_probabilities(np.concatenate([r for r, _ in cut])) * size[:, None]
        starts = np.cumsum([0] + [len(s) for _, s in cut[:-1]])
        mean = np.add.reduceat(weighed, starts, axis=0) / np.add.reduceat(size, starts)[:, None]
        p = np.exp(_log_softmax(mean))
        at = p.argmax(axis=1)
        return [(self.languages[i], float(min(max(v, 0.0), 1.0))) for i, v in zip(at.tolist(), p[np.arange(len(at)), at].tolist(), strict=True)]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS) -> Network | None:
    """From (text, language) pairs; every language weighs the same."""
    samples = sorted((t, y) for t, y in samples if t)
    languages = tuple(sorted({y for _, y in samples}, key=str.encode))
    if not languages:
        return None
    cut = [windows(t)[0] for t, _ in samples]
    rows = np.concatenate(cut)
    label = np.repeat([languages.index(y) for _, y in samples], [len(c) for c in cut])
    share = np.bincount(label, minlength=len(languages))
    weight = (1.0 / share)[label] * len(label) / len(languages)
    random = np.random.default_rng(7)
    wide = FILTERS * len(WIDTHS)
    values = [(random.standard_normal((w, 256, FILTERS)) * 0.3 / np.sqrt(w)).astype("f4") for w in WIDTHS]
    values += [np.zeros(FILTERS, "f4") for _ in WIDTHS]
    values += [(random.standard_normal((wide, len(languages))) / np.sqrt(wide)).astype("f4"), np.zeros(len(languages), "f4")]
    n = len(WIDTHS)
    net = lambda: Network(languages, tuple(values[:n]), tuple(values[n : 2 * n]), values[-2], values[-1])
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            for i, g in enumerate(_gradients(net(), rows[some], label[some], weight[some])):
                if i == 0:
                    step += 1
                g = g + DECAY * values[i]
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                values[i] = (values[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return net()


def _gradients(net: Network, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted cross-entropy; only the place of a filter's largest response passes any on."""
    best, places = net.features(rows)
    active = np.maximum(best, 0)
    out = np.exp(_log_softmax(active @ net.layer + net.bias))
    out[np.arange(len(label)), label] -= 1
    out *= (weight / len(label))[:, None]
    back = (out @ net.layer.T) * (best > 0)
    tables, biases = [], []
    for i, (values, at) in enumerate(zip(net.tables, places, strict=True)):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        g = np.zeros(values.shape)
        every = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(len(values)):
            np.add.at(g[k], (np.take_along_axis(rows, at + k, axis=1), every), own)
        tables.append(g)
        biases.append(own.sum(axis=0))
    return [*tables, *biases, active.T @ out, out.sum(axis=0)]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Network | None:
    """The network of a table's documents that aren't held out; None where there is nothing to learn from."""
    named = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    usable = named.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & _has_letter("text"))
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("ids"))
    frequent = {r.lang: r.ids for r in counted.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not frequent:
        return None
    # Ids first: at most LANGUAGES * sample of them are broadcast, and of their texts only some windows are gathered. Of each
    # language some four times the sample pass by their hash, so that few rows are ordered, however many there are.
    share = F.lit(0)
    for name, n in frequent.items():
        share = F.when(F.col("lang") == name, F.lit(min(1 << 30, (1 << 30) * 4 * sample // max(n, 1)))).otherwise(share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    some = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share).select("id", "lang").distinct()
    ids = some.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).drop("at")
    found = usable.join(F.broadcast(ids), ["id", "lang"])
    last = f"greatest(length(text) - {WINDOW // 2}, 0)"
    some = f"transform(sequence(0, {SAMPLE_WINDOWS - 1}), i -> substring(text, cast({last} * i div {max(SAMPLE_WINDOWS - 1, 1)} as int) + 1, {WINDOW // 2}))"
    rows = found.select("id", "lang", F.expr(f"array_join(array_distinct({some}), '')").alias("text")).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    return train([(r.text.encode(), r.lang) for r in rows])


def _has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identified(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    prepared(docs.sparkSession)
    marked = docs.withColumn("__judged", _has_letter(f"`{text}`") if network is not None else F.lit(False))
    fields = [("lang_pred", "string"), ("score", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(text), 1 << 18):
                some = batch.slice(low, high - low)
                judged = np.flatnonzero(some.column("__judged").to_numpy(zero_copy_only=False))
                found: list[tuple[str, float]] = [("und", 0.0)] * some.num_rows
                if len(judged):
                    texts = pc.take(some.column(text), pa.array(judged)).cast(pa.binary()).to_pylist()
                    for i, own in zip(judged.tolist(), network.judge(texts), strict=True):
                        found[i] = own
                yield extended(some.drop_columns(["__judged"]), lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([x for _, x in found], pa.float64()))

    return marked.mapInArrow(lean(run), with_fields(docs.schema, *fields))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = identified(docs.select("doc_id", "text"), trained(docs))
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
