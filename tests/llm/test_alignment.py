"""Token alignment against the libraries and a brute-force count of links."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import alignment
from rankloom.llm.registry import queries

TEXTS = [
    None, "", " ", "a", "a b", "  two  spaces ", "Hello, world! It's 'quoted' don't.", "line one\nline two\n\n  indented\ttab", "ß é ü 漢字 日本 🙂🙃 naïve", "under▁score mark", "▁", "x▁ y",
    "<s> </s> <unk> <0x41> <|endoftext|> end<|endoftext|>", "\x00\x01 \x1c \x85   z\xa0y", "w" * 3000, "long-" * 400 + " tail", "a  b   c    d     e", "\n", "tab\t", "é é ﬁ Å",
    "the cat sat on the mat " * 300, "12345 678.90 1,000,000", "a b", "CamelCaseWord snake_case_word", " \n a", "a\n b \n c", "x 　 y",
]


def vocabularies():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    byte_of = alignment.byte_alphabet()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    data_a = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    data_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, data_a, b, data_b


def expected(texts):
    """Rows by whole texts through the libraries, and one pass over the bytes."""
    a, data_a, b, data_b = vocabularies()
    found, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        wanted = (" " + text).encode() if text else b""
        if not text or b"".join(data_a[i] for i in ids_a) != wanted or b"".join(data_b[i] for i in ids_b) != wanted:
            found.append(([], [], [], ""))
            continue
        ends = []
        for ids, data in ((ids_a, data_a), (ids_b, data_b)):
            at, own = 0, []
            for i in ids:
                at += len(data[i])
                own.append((at, i))
            ends.append(own)
        with_end = dict(ends[1])
        links = [(x, with_end[p]) for p, x in ends[0] if p in with_end]
        counts.update(links)
        shown, i, j = [], 0, 0
        for cut in sorted({p for p, _ in ends[0]} & with_end.keys()):
            low_i, low_j = i, j
            while i < len(ends[0]) and ends[0][i][0] <= cut:
                i += 1
            while j < len(ends[1]) and ends[1][j][0] <= cut:
                j += 1
            shown.append(",".join(str(x) for _, x in ends[0][low_i:i]) + "|" + ",".join(str(x) for _, x in ends[1][low_j:j]))
        found.append((ids_a, ids_b, links, ";".join(shown)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for ids_a, ids_b, links, shown in found:
        digest = hashlib.sha256(shown.encode()).hexdigest() if ids_a else ""
        rows.append((len(ids_a), len(ids_b), shown.count(";") + 1 if ids_a else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got_rows(rows):
    done = alignment.with_counts(rows, alignment.pair_counts(rows))
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in done.collect()}


def test_rows_equal_the_libraries(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = alignment.aligned(docs).cache()
    got, want = got_rows(rows), expected(TEXTS)
    for i, row in enumerate(want):
        assert got[i] == row, (i, TEXTS[i])
    assert got[TEXTS.index("▁")] == (0, 0, 0, 0, 0, 0, "") and got[2][0] > 0
    rows.unpersist()


def test_small_memory_and_parts_change_nothing(monkeypatch):
    own = alignment.Aligner(*alignment._paths(None, None))
    texts = [*TEXTS, *(f"word{i} other{i % 7}, and the rest" for i in range(200))]
    wanted = own.aligned(texts)
    monkeypatch.setattr(alignment, "MEMORY_UNITS", 5)
    monkeypatch.setattr(alignment, "PART_BYTES", 7)
    monkeypatch.setattr(alignment, "PART_UNITS", 3)
    assert [x for t in texts for x in own.aligned([t])] == wanted
    own.splits = False  # whole texts
    assert own.aligned(texts) == wanted
    own.a.quick = None  # the tokenizer itself
    assert own.aligned(texts) == wanted


def test_every_pair_that_ends_together_is_numbered():
    own = alignment.aligner(*alignment._paths(None, None))
    assert len(own.pairs) < own.size_a.sum() * 2 + own.size_b.sum() and (own.pairs[1:] > own.pairs[:-1]).all()


def test_long_text_null_ids_repeats_and_clashes(spark):
    long = "some words, repeated and 'quoted' " * 20_000
    docs = spark.createDataFrame([(None, long, 1), (7, "a b", 2), (7, "a b", 3)], "doc_id long, text string, n_a int")
    rows = alignment.aligned(docs, keep=("doc_id", "n_a")).collect()
    assert {f for f in rows[0].asDict()} == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"}
    assert [(r.n_a, r.n_b) for r in rows if r.doc_id == 7] == [(2, 2)] * 2
    (row,) = [r for r in rows if r.doc_id is None]
    (want,) = expected([long])
    assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups_sha256) == (*want[:4], want[6])


def test_empty_table(spark):
    rows = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert alignment.with_counts(rows, alignment.pair_counts(rows)).collect() == []


def test_op11_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries()["op11_alignment"](spark, folder).collect()}
    assert got == dict(zip((r.doc_id for r in source), expected([r.text for r in source]), strict=True))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_counts_are_summed_over_tasks(spark, n):
    docs = spark.createDataFrame([(i, "the same words here") for i in range(n)], "doc_id long, text string").repartition(4)
    counts = alignment.pair_counts(alignment.aligned(docs))
    assert {r.n for r in counts.collect()} == ({n} if n else set())
    assert counts.where(~F.col("best")).count() == 0
