"""Near duplicates, suffix arrays, repeated passages and the pipeline against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from rankloom.llm import minhash, quality_classifier, quality_rules, shingles, suffix_array, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_set(text, n):
    words = [w.translate(LOWER) for w in WORD.findall((text or "").encode())]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def expected_components(rows, n, similarity=80):
    sets = [word_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return {rows[i][0]: min(least[root(i)]) for i in range(len(rows))}, {rows[i][0]: len(sets[i]) for i in range(len(rows))}


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return " ".join(words)


def corpus(rng, n_groups=25, most=12):
    rows = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.randint(1, most)):
            rows.append(varied(rng, base, rng.choice([0, 0, 1, 2, 5])))
    rows += ["", None, " \n", "one", "One", "two words", "TWO  words"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small,block", [(4096, 512), (4096, 2), (4, 2)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "LEVELS", 2 if small == 4 else 6)
    rows = corpus(random.Random(11), n_groups=12 if small == 4 else 25)
    expected, sizes = expected_components(rows, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (5, None), (6, None), (7, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True), ("5", "5", True), ("6", "6", True), ("7", "7", True)]
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    clash = spark.createDataFrame([(1, "x y", 3, "q")], "doc_id long, text string, n long, family string")
    assert minhash.stage_near_duplicates(spark, clash, "").columns == clash.columns


def test_stage_judges_rows_without_id_one_by_one(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    text = {"named": " ".join(base), "near named": " ".join(base[:-1] + ["x"]), "alone": "nobody else has these words here", "pair": " ".join(other), "near pair": " ".join(other[:-1] + ["y"])}
    rows = [(-7, text["named"]), (2, text["named"]), (3, "some other words of a row"), *((None, text[k]) for k in ("named", "near named", "alone", "pair", "pair", "near pair")), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, __row string").repartition(3)
    got = minhash.stage_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert {x for x in left if x[0] is not None} == {(-7, text["named"]), (3, "some other words of a row")}
    assert [t for d, t in left if d is None and t in (text["pair"], text["near pair"])] in ([text["pair"]], [text["near pair"]])
    assert sorted(str(t) for d, t in left if d is None and t not in (text["pair"], text["near pair"])) == ["None", "None", text["alone"]]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70), (8, 8)] + [(200 + i, 300 + i // 3) for i in range(40)] + [(300 + i, 300 + i // 4) for i in range(14)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(chain, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 70: 50, 100: 50, **{i: 200 for i in [*range(201, 240), *range(300, 314)]}}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, letters):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


def test_long_words_of_two_letters_differ(spark):
    """These collide in any polynomial modulo a power of two."""
    rows = [(i, f"{thue_morse(2048, letters)} and three more") for i, letters in ((1, "ab"), (2, "ba"), (3, "ab"), (4, "cd"))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_links_are_confirmed_on_texts(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i"), (2, "A b c d  e f g h i j"), (3, "a b c d e f x y z"), (4, "one two"), (4, "a b c d e f g h i j"), (5, None), (6, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 6), (2, 5)], "a long, b long")
    assert {(r.a, r.b) for r in minhash.unconfirmed(links, docs, 4, 80).collect()} == {(1, 3), (4, 6)}
    salts, plain = [], minhash.links_of

    def weak(nodes, docs, words, similarity, salt=0):  # as if two shingles had one hash
        salts.append(salt)
        return plain(nodes, docs, words, similarity, salt).unionByName(links.where("b = 3" if salt < 2 else "false"))

    monkeypatch.setattr(minhash, "links_of", weak)
    got = minhash.near_duplicates(docs.where("text is not null"), words=4).collect()
    assert salts == [0, 1, 2] and {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1, 6: 6}


def test_near_duplicates_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1000)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(i, varied(rng, base, 20 * i)) for i in range(5)] + [(9, " ".join(base[::-1])), (10, "x" * 900_000), (11, "x" * 900_000 + " y")]
    expected, sizes = expected_components(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {d: (expected[d], sizes[d]) for d in expected}


FRESH = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, sys.argv[1])  # the workers, which begin elsewhere, don't see this
from rankloom.llm import ann, bpe, minhash, packing, quality_classifier, suffix_dedup
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
assert sorted(r.doc_id for r in minhash.stage_near_duplicates(spark, docs, "").collect()) == [1, 3]
assert suffix_dedup.stage_passages(spark, docs, "").count() == 3
model = quality_classifier.Model(b"", b"", 0.0, 0.0)
assert quality_classifier.scored(docs, model).count() == 3
vectors = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
assert ann.nearest(vectors, vectors).count() == 2
assert packing.packed(docs).select("doc_id").distinct().count() == 3 and bpe.decoded(bpe.encoded(docs)).count() == 3
print("fine")
"""


def test_fresh_session_away_from_the_repository(tmp_path):
    """Executors that can't import the package get it before any function of it runs there."""
    (tmp_path / "shared").mkdir()
    root = Path(minhash.__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FRESH, str(root), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_shingles_of_chunks_are_those_of_the_whole(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 3, 5, 400]))) for _ in range(40)] + ["x" * 700, None]
    whole = shingles.shingle_sets(pa.array(texts), 4)
    monkeypatch.setattr(shingles, "CHUNK", 97)
    parts = shingles.shingle_sets(pa.array(texts), 4)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert [len(s) for s in whole] == [len(word_set(t, 4)) for t in texts]


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    got = minhash.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for _ in range(600):
        text = rng.integers(0, rng.choice([1, 2, 3, 5, 250]), rng.integers(1, 70)).astype(np.uint8)
        whole = text.tobytes()
        order = suffix_array.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: whole[i:])
        common = suffix_array.common_prefixes(text, order)
        assert common[order[0]] == 0
        for a, b in zip(order[:-1], order[1:], strict=True):
            assert common[b] == len(os.path.commonprefix([whole[a:], whole[b:]]))
    assert suffix_array.suffix_array(np.zeros(0, np.uint8)).tolist() == []


@pytest.mark.parametrize("shorter", [0.75, 100, 0])
def test_suffix_array_of_repetitive_texts(monkeypatch, shorter):
    """By recursion where names shorten the text (0.75), always (100) and never (0)."""
    monkeypatch.setattr(suffix_array, "SHORTER", shorter)
    rng = np.random.default_rng(8)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() + b" " for _ in range(900)]
    prose = b"".join(words[i] for i in rng.integers(0, 900, 3000))
    texts = [prose + b"\0" + prose[500:9000] + b"\0" + prose[700:], b"ab" * 400, b"a" * 5000 + b"b" + b"a" * 4000, b"abcab" * 300 + b"abd", bytes(range(256)) * 8, b"".join(prose[:3000] + b"\0" for _ in range(30)), b"ba" * 300 + b"\0" + b"ab" * 300]
    for whole in texts:
        if shorter == 100 and len(set(whole)) < 4:
            continue  # there, recursion alone is as deep as the text is long
        order = suffix_array.suffix_array(np.frombuffer(whole, np.uint8))
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        common = suffix_array.common_prefixes(np.frombuffer(whole, np.uint8), order)
        some = range(0, len(whole) - 1, 7)
        assert [int(common[order[i + 1]]) for i in some] == [len(os.path.commonprefix([whole[order[i] :], whole[order[i + 1] :]])) for i in some]


def expected_cuts(rows, length=50):
    owner, out = {}, []
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in ordered:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            owner.setdefault(data[i : i + length], doc)
    for doc, text in rows:
        data, spans = (text or "").encode(), []
        for i in range(len(data) - length + 1):
            own = owner[data[i : i + length]]
            if own is not None and (doc is None or own < doc):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        left, at = b"", 0
        for a, b in spans:
            left, at = left + data[at:a], b
        left += data[at:]
        out.append((doc, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [make(n) for n in (50, 51, 80, 200, 49)]
    rows = []
    for i in range(120):
        parts = [make(rng.choice([0, 3, 60, 200]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            parts += [p[rng.choice([0, 0, 5]) :], make(rng.choice([0, 1, 40]))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 300), (201, "ab" * 100), (202, "a" * 500), (203, "a" * 60), (204, None), (205, ""), (None, shared[3]), (7, rows[7][1])]
    clash = "id string, row string, copy string, values string, carried string, left string, digest string, part string"
    docs = spark.createDataFrame([(d, t, *"abcdefgh") for d, t in rows], f"doc_id long, text string, {clash}").repartition(6)
    done = suffix_dedup.deduplicated(docs)
    assert [c for c in done.columns if c in docs.columns] == [c for c in docs.columns if c != "left"] + ["left"]
    got = done.collect()
    assert all((r.id, r.row, r.copy, r["values"], r.carried, r.digest, r.part) == tuple("abcdegh") for r in got)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.left)).hexdigest()) for r in got), key=str) == expected_cuts(rows)


def test_op10_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_dedup(spark, folder).collect()), key=str)
    assert got == expected_cuts(rows)


def test_pipeline_of_odd_tables(spark, monkeypatch):
    """Empty tables, null ids and repeated rows through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 500 and 3000").limit(12).collect()]
    odd = [tuple(r) for r in good] + [tuple(good[0])] + [(None, *tuple(good[1])[1:]), (None, None, None, None, None), (900, "", "en", "s", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
            assert docs.columns == [f.split(" ")[0] for f in schema.split(", ")]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= (4 if rows else 0)


def test_only_first_copies_send_anchors():
    rows = [(5, "x"), (3, "x"), (3, "x"), (4, "x"), (1, "y"), (2, "y"), (1, "x")]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in part]) for part in (rows[:4], rows[4:])]
    got = [(r["id"], r["text"]) for b in suffix_dedup._first_copies(iter(batches)) for r in b.to_pylist()]
    assert got == [(5, "x"), (3, "x"), (1, "y"), (1, "x")]


def test_op10_sends_rows_by_partition_and_hot_passages_by_second_anchors():
    """Packed rows don't multiply with shards or slices, and marks of hot anchors change no result."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    common = " ".join(rng.choices(words, k=40))
    texts = [" ".join(rng.choices(words, k=700)) + common + " ".join(rng.choices(words, k=700)) for _ in range(40)]
    rows = [{"id": i, "row": i, "text": t} for i, t in enumerate(texts)]
    sent = [b for b in suffix_dedup._anchors(7)(iter([pa.RecordBatch.from_pylist(rows)]))]
    assert sum(b.num_rows for b in sent) <= 7
    found = []
    for mark in (0, 1 << 63):
        known = [np.unique(suffix_dedup.anchored(d := np.frombuffer(t.encode(), np.uint8), np.array([0, len(d)]))[3]) | np.uint64(mark) for t in texts]
        batch = pa.RecordBatch.from_pylist([r | {"text": zstandard.compress(r["text"].encode()), "values": k.tobytes()} for r, k in zip(rows, known, strict=True)])
        packed = list(suffix_dedup._segments(3000, 5)(iter([batch])))
        assert sum(b.num_rows for b in packed) <= 5
        sizes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), "<i4") for b in packed for x in b.column("sizes")]
        assert not mark or sum(map(len, sizes)) < sum(len(t) - 49 for t in texts) / 3
        cuts = list(suffix_dedup._by_document(suffix_dedup._removals(1)(iter(packed))))
        spans = {r["id"]: np.frombuffer(r["values"], "<u8") for b in cuts for r in b.to_pylist()}
        found.append({i: {p for v in values.tolist() for p in range(v >> 32, (v >> 32) + (v & 0xFFFFFFFF))} for i, values in spans.items()})
    assert found[0] == found[1] and set(found[0]) == set(range(1, 40)) and all(len(v) >= len(common) for v in found[0].values())


def test_passages_of_nothing(spark):
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against brute force or its operator's contract, on what the one before kept."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "near_duplicates":
            component, _ = expected_components(sorted(before.items()), 5)
            assert set(after) == {d for d in before if component[d] == d}
        if name == "repeated_passages":
            cuts = {d: (n, spans) for d, n, _, spans, _ in expected_cuts(sorted(before.items()))}
            assert all((after[d] == before[d]) == (cuts[d][1] == 0) for d in after)
        elif name != "repeated_passages":
            assert all(after[d] == before[d] for d in after)
        before = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in after) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_stages_keep_clashing_columns(spark, monkeypatch):
    text = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 5)} words{chr(97 + i % 26)}{chr(97 + i // 5)} of the text{chr(97 + i % 26)}{chr(97 + i // 5)} and more{'.' * (i % 3 == 0)}" for i in range(60)) + ".\nsecond line\nthird line"
    extra = "score string, votes string, n_words string, left string, row string, id string, __p string"
    docs = spark.createDataFrame([(i, f"{text} {i}", "en", "s", 1, *"abcdefg") for i in range(3)] + [(None, None, None, None, None, *"abcdefg")], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_classifier, "table", lambda *_: labels)
    monkeypatch.setattr(quality_classifier, "THRESHOLD", 0.5)
    for stage in (quality_classifier.stage_quality, quality_rules.stage_rules, minhash.stage_near_duplicates, suffix_dedup.stage_passages):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all((r.score, r.votes, r.left, r.row, r.id) == ("a", "b", "d", "e", "f") for r in rows)
