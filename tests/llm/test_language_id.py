"""The byte network: held-out accuracy, plain evaluation, gradients, and odd tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import language_id
from rankloom.llm.registry import queries

FOLDER = "/root/testdata/sf0.01"
WORDS = {"aa": ["kala", "mina", "tolo", "para"], "bb": ["strugg", "wrench", "fjord", "sphinx"], "cc": ["éàç", "ñandú", "über", "söze"]}


def text_of(lang, i, n=12):
    return " ".join(WORDS[lang][(i * 7 + j * j) % 4] for j in range(n))


def samples(n=30):
    return [(text_of(lang, i).encode(), lang) for lang in WORDS for i in range(n)]


@pytest.fixture(scope="module")
def network():
    return language_id.train(samples(), epochs=6)


def plainly(net, text):
    """One filter, one place and one window after the other."""
    total, size = np.zeros(len(net.languages)), 0
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    for at in range(0, len(data), language_id.WINDOW):
        own = data[at : at + language_id.WINDOW]
        row = own + bytes(language_id.WINDOW - len(own))
        best = []
        for tables, bias in zip(net.tables, net.biases, strict=True):
            for f in range(language_id.FILTERS):
                w = len(tables)
                best.append(max(0.0, max(sum(float(tables[k][row[i + k]][f]) for k in range(w)) for i in range(len(row) - w + 1)) + float(bias[f])))
        z = np.array(best) @ net.layer + net.bias
        total += len(own) * (z - z.max() - math.log(sum(math.exp(v - z.max()) for v in z)))
        size += len(own)
    p = np.exp(total / size - (total / size).max())
    p /= p.sum()
    return net.languages[int(p.argmax())], float(p.max())


def test_judges_as_plain_evaluation_does(network):
    texts = [text_of("aa", 1).encode(), text_of("cc", 2, 90).encode(), b"x", (text_of("bb", 3, 60) + " KALA MINA ").encode()]
    for text, (lang, score) in zip(texts, network.judge(texts), strict=True):
        want = plainly(network, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4
    assert [x for x, _ in network.judge(texts[:2])] == ["aa", "cc"]


def test_gradients_are_those_of_the_loss():
    net = language_id.train(samples(4), epochs=1)
    rows = np.concatenate([language_id.windows(t)[0] for t, _ in samples(2)])
    label = np.array([net.languages.index(y) for _, y in samples(2)])
    weight = np.ones(len(label))

    def loss(n):
        best, _ = n.features(rows)
        return -np.mean(language_id._log_softmax(np.maximum(best, 0).astype("f8") @ n.layer + n.bias)[np.arange(len(label)), label])

    grads = language_id._gradients(net, rows, label, weight)
    flat = [*net.tables, *net.biases, net.layer, net.bias]
    for k in (0, 2, 3, 6, 7):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        step = 1e-6
        values = []
        for sign in (1, -1):
            own = [v.astype("f8") for v in flat]
            own[k][at] += sign * step
            values.append(loss(language_id.Network(net.languages, tuple(own[:3]), tuple(own[3:6]), own[6], own[7])))
        assert abs((values[0] - values[1]) / (2 * step) - grads[k][at]) < 0.02 * max(abs(grads[k][at]), 0.01)


def test_windows_hold_every_byte():
    for n in (0, 1, 255, 256, 257, 1000):
        rows, size = language_id.windows(bytes(range(97, 123)) * 40 if n == 1000 else b"a" * n)
        assert size.sum() == (1040 if n == 1000 else n) and rows.shape == (len(size), language_id.WINDOW)


def test_odd_texts_and_clashing_columns(spark, network):
    texts = [None, "", "123 !?", "\n", text_of("bb", 1), text_of("aa", 5, 60_000), "é", text_of("bb", 1)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, lang_pred int")
    got = language_id.identified(docs, network).orderBy("doc_id").collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "score", "lang_pred"}
    assert [(r.lang_pred, r.score) for r in got[:4]] == [("und", 0.0)] * 4
    assert [r.lang_pred for r in got[4:6]] == ["bb", "aa"] and all(0 < r.score <= 1 for r in got[4:])
    assert (got[4].lang_pred, got[4].score) == (got[7].lang_pred, got[7].score)
    assert language_id.identified(docs.limit(0), network).collect() == []
    assert {r.lang_pred for r in language_id.identified(docs, None).collect()} == {"und"}


def test_learns_from_usable_rows_alone(spark):
    rows = [(i, text_of(lang, i), lang) for k, lang in enumerate(WORDS) for i in range(k * 100, k * 100 + 40)]
    rows = [(i, t, "held" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    rows += [(None, "some words", "no id"), (1001, None, "no text"), (1002, "12 34", "no letters"), (1003, "words here", None)] + [(1, text_of("aa", 1), "aa")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.trained(docs, sample=20)
    assert net.languages == ("aa", "bb", "cc")
    assert language_id.trained(docs.limit(0)) is None
    one = language_id.trained(docs.where("lang = 'aa'"))
    assert one.judge([b"anything"]) == [("aa", 1.0)]


def test_op13_held_out_accuracy(spark):
    got = queries()["op13_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    assert got.count() == docs.count() and set(got.columns) == {"doc_id", "held_out", "lang_pred", "score"}
    both = got.join(docs, "doc_id").where("held_out and text rlike '[a-zA-Z]'")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert both.count() > 150 and right >= 0.97
    flags = {r.doc_id: r.held_out for r in got.collect()}
    assert all(v == (zlib.crc32(str(i).encode()) % 4 == 2) for i, v in flags.items())
