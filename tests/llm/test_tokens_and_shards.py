"""BPE, packing, sharding and nearest neighbours against brute force and the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from rankloom.llm import ann, bpe, packing, sharding

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf=16, window=8)


PIECES = st.lists(st.sampled_from(["abc", "the ", " ", "\n", "'", "'s", "'re", "é", "中文", "1", "12 ", "  ", "!", "xyzzy", "a", " ", "ing"]), max_size=80).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_tree_encoding_is_the_library_s(text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    small = _small()
    ids = small.encode(text)
    assert ids == codec.library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


_cached = []


def _small():
    if not _cached:
        _cached.append(bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf=16, window=8))
    return _cached[0]


def test_one_long_word(small_leaves):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    assert small_leaves.encode(text) == small_leaves.library.encode_ordinary(text)


def test_merges_give_every_token(small_leaves):
    """The lemma behind joining by neighbours needs a vocabulary in which every token is what its merges give."""
    ranks = {t: i for i, t in small_leaves.token.items()}
    for token in random.Random(1).sample(sorted(ranks), 3000):
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert rank < 1 << 30
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id long, text string")
    got = bpe.decoded(bpe.encoded(docs)).collect()
    assert len(got) == 4
    for r in got:
        assert bytes(r.decoded) == (r.text or "").encode()


def test_word_tokenizer_is_the_library_s():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    own, rng = packing.WordTokenizer(WORDS), random.Random(3)
    texts = ["", "It's DON'T the<|endoftext|>x", "Σίσυφος ΣΑΣ", "İstanbul straße ª µ", "é x́", "\x1c a\x1db", "one,two.", "word!?.;", "x" * 200, "a <|endoftext|> b", "<|startoftext|>", "A<|ENDOFTEXT|>b"]
    texts += ["".join(rng.choice("abÉß'.,! \n\x85 Σ1中é<|>") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size,most_open,merge", [(2048, 64, 32), (16, 3, 2)])
def test_packing_places_every_id_once(spark, size, most_open, merge):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bee", "sea", "delta"]) for _ in range(rng.choice([0, 1, 3, 20, 300]))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(300, None)], "doc_id long, text string").repartition(5)
    pieces = packing.packed(docs, size=size, most_open=most_open, merge=merge).collect()
    encode, by_doc, by_sequence = packing.tokenizer(WORDS), defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == 301
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        whole = encode(texts[doc] if doc < 300 else "") + np.array([1], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in own) == whole
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(whole) // 4}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= size and (total == size or total & (total - 1) == 0)


def test_packing_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part_rows", [250_000, 2])
def test_shards_are_near_equal_and_gapless(spark, part_rows):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(None, "null id"), (7, None), (7, None)]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, base int, shard int")
    slotted = sharding.hashed(docs, "doc_id", "text", 512).drop("text").cache()
    slot_map = sharding.SlotMap.balanced(512, 8, sharding.slot_bytes_of(slotted))
    got = sharding.sharded(slotted, slot_map, ["doc_id", "text_crc32", "size"], part_rows).collect()
    assert len(got) == len(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert slot_map.shard_of[r.virtual_slot] == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.02 * min(size.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.sharded(slotted.where("false"), slot_map, ["doc_id"]).count() == 0


def test_op6_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = sharding.op6_sharding(spark, folder).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode()))
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 40
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Largest first to the emptiest is at most 4/3 of the best, and no shard can hold less than the largest document.
    best = max(sum(held.values()) / 40, max(r["size"] for r in got))
    assert max(held.values()) <= 4 / 3 * best + 1
    again = sharding.op6_sharding(spark, folder).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_slot_map_edits_move_little(spark, tmp_path):
    rng = random.Random(4)
    slot_bytes = {s: rng.randint(1, 1000) for s in range(1000)}
    first = sharding.SlotMap.balanced(1024, 10, slot_bytes)
    grown = first.grown(slot_bytes)
    assert all(new in (old, 10) for old, new in zip(first.shard_of, grown.shard_of, strict=True))
    held, _ = grown._loads(slot_bytes, 11)
    assert held[10] > 0.8 * sum(held) / 11
    heavier = slot_bytes | {s: 40 * b for s, b in slot_bytes.items() if first.shard_of[s] == 3}
    assert first.rebalanced(heavier, 0.001).uneven(heavier) < 0.01 < first.uneven(heavier)
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    with pytest.raises(FileExistsError):  # a version is written once
        grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.stored(spark, str(tmp_path / "none")) is None


def test_equal_rows_are_numbered_in_several_parts(spark, tmp_path):
    docs = spark.createDataFrame([(5, "the same row")] * 900 + [(i, f"{i}") for i in range(300)], "doc_id long, text string").repartition(6)
    sharding.hashed(docs, "doc_id", "text", 16).drop("text").write.parquet(str(tmp_path / "slotted"))
    slotted = spark.read.parquet(str(tmp_path / "slotted"))
    slot_map = sharding.SlotMap.balanced(16, 3, sharding.slot_bytes_of(slotted))
    heavy = slotted.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "__lane", F.lit(8)), F.lit(8))).where("doc_id = 5 and size = 28").groupBy("__part").count()
    assert heavy.count() > 1 and heavy.agg(F.max("count")).first()[0] < 900
    slots = defaultdict(list)
    for r in sharding.sharded(slotted, slot_map, ["doc_id", "text_crc32", "size"], 10).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 1200 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_finds_the_map_of_an_earlier_run(spark, tmp_path):
    folder = str(tmp_path / "maps")
    first = sharding.op6_sharding(spark, "/root/testdata/sf0.001", 7, folder)
    assert {r.map_version for r in first.collect()} == {1} and sharding.SlotMap.stored(spark, folder).n_shards == 7
    assert {r.shard for r in sharding.op6_sharding(spark, "/root/testdata/sf0.001", 8, folder).collect()} == set(range(8))
    assert sharding.SlotMap.load(spark, folder, 1).n_shards == 7


def test_stored_map_is_edited_when_bytes_change(spark, tmp_path):
    rng, folder = random.Random(9), str(tmp_path / "maps")
    slot_bytes = {s: rng.randint(1, 1000) for s in range(1000)}
    first = sharding.current_map(spark, folder, 10, slot_bytes, 1024)
    assert first.version == 1 and sharding.current_map(spark, folder, 10, slot_bytes, 1024) == first
    more = {s: b + rng.randint(0, 100) for s, b in slot_bytes.items()}
    second = sharding.current_map(spark, folder, 10, more, 1024)
    assert second.version == 2 and second.uneven(more) <= sharding.TOLERANCE < first.uneven(more)
    assert sum(a != b for a, b in zip(first.shard_of, second.shard_of, strict=True)) < 100
    third = sharding.current_map(spark, folder, 11, more, 1024)
    assert third.n_shards == 11 and third.version >= 3 and sharding.SlotMap.load(spark, folder, 1) == first
    with pytest.raises(ValueError):
        sharding.current_map(spark, folder, 5, more, 1024)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    vectors[100:600] = vectors[100]  # many copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0, 2.0]), (5500, [])]
    base = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = defaultdict(list)
    for r in ann.nearest(base, base.where("id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))  # 5400 has no other vector of its length
    hits = 0
    for q, near in got.items():
        apart = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), apart)) if i != q][:10]
        assert len(near) == 10 and near == sorted(near, key=lambda x: (x[1], x[0]))
        assert all(s == pytest.approx(apart[v], abs=1e-12) for v, s in near)
        hits += len({v for v, _ in near} & set(order))
    assert hits >= 0.97 * 300
    assert [v for v, _ in got[100]] == list(range(101, 111))


def test_clustered_vectors_are_seldom_verified(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 24))
    vectors = centres[rng.integers(0, 200, 40_000)] + 0.25 * rng.standard_normal((40_000, 24))
    base = spark.createDataFrame(pa.table({"id": np.arange(40_000), "v": pa.array(list(vectors))})).repartition(4)
    got = ann.nearest(base, base.where("id % 400 = 0")).toPandas()
    by, hits = got.groupby("query_id").vec_id.apply(set), 0
    for q in range(0, 40_000, 400):
        apart = ((vectors - vectors[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        hits += len(by[q] & set(np.argpartition(apart, 10)[:10].tolist()))
    assert hits >= 0.97 * 1000
    assert got.groupby("query_id").verified.first().mean() < 0.02 * 40_000


@pytest.mark.parametrize("rows,chunk,cell", [(16_384, 2048, 16_384), (64, 3, 50)])
def test_repeated_queries_copies_and_small_blocks(spark, monkeypatch, rows, chunk, cell):
    for name, value in (("BLOCK_ROWS", rows), ("CHUNK", chunk), ("CELL_ROWS", cell), ("MISS", 0.002)):
        monkeypatch.setattr(ann, name, value)
    ann.threshold.cache_clear()
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((600, 4)).round(1)
    vectors[200:420] = vectors[200]  # a third are copies, queries among them
    held = [(i, v.tolist()) for i, v in enumerate(vectors)]
    held += [(0, vectors[0].tolist()), (0, vectors[1].tolist()), (7, vectors[7].tolist()), (100, vectors[100].tolist())]
    base = ann.usable(spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding")
    got = defaultdict(list)
    for r in ann.nearest(base, base.where("id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, v in {(q, tuple(v)) for q, v in held if q % 100 == 0}:
        expected = sorted((float(np.sqrt(((np.array(u) - v) ** 2).sum())), i) for i, u in held if i != q)[:10]
        mine = [x for x in got[q] if True]
        if q == 0:  # two queries of one id, each once
            assert sorted(x[0] for x in mine) == sorted(2 * list(range(1, 11)))
        else:
            assert [x[0] for x in mine] == list(range(1, 11))
            hits, total = hits + len({(i, round(s, 9)) for _, i, s in mine} & {(i, round(d, 9)) for d, i in expected}), total + len({i for _, i in expected})
    assert hits >= 0.97 * total
    assert [x[1] for x in got[300]] == list(range(200, 210)) and [x[1] for x in got[200]] == list(range(201, 211))
    ann.threshold.cache_clear()


def test_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    base = ann.usable(rows, "vec_id", "embedding")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(base, base.where("id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(base.where("false"), base.where("false")).count() == 0


FOLDER = "/root/testdata/sf0.001"


def _texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_op2_is_the_library_s(spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library, texts = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), _texts(spark)
    got = bpe.op2_bpe(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    joined = sum(len(t.encode()) > bpe.LEAF for t in texts.values())
    assert joined > 10  # documents that the tree joins


def test_bpe_of_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, ids int, decoded string")
    row = bpe.decoded(bpe.encoded(docs)).first()
    assert bytes(row.decoded) == b"a b" and len(row.ids) == 8
    assert bpe.decoded(bpe.encoded(docs.where("false"))).count() == 0


def test_op9_places_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(WORDS), _texts(spark)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.op9_packing(spark, FOLDER).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc, own in by_doc.items():
        ids, at = library.encode(texts[doc], add_special_tokens=False).ids + [1], 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_packing_keeps_and_replaces_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 9, 8, 7)], "doc_id long, text string, tag string, start int, ids int, __group int")
    got = packing.packed(docs, keep=("doc_id", "tag", "start", "ids", "__group")).collect()
    assert got[0].tag == "x" and sum(r.length for r in got) == 4 and sorted(r.start for r in got) == [0] if len(got) == 1 else True
    assert set(got[0].asDict()) == {"doc_id", "tag", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}


def test_sql_of_the_operators(spark):
    """Queries that SQL expresses, on the smoke tables."""
    import duckdb

    from rankloom.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    names = registry.oracle_sql()
    assert {n.split("_")[0] for n in names} == {"op1", "op3", "op4", "op8", "op10", "op12"}
    for name, sql in names.items():
        answer = con.execute(sql)
        columns = [c[0] for c in answer.description]
        expected = sorted(map(str, answer.fetchall()))
        got = registry.queries()[name](spark, FOLDER).select(*columns).collect()
        assert sorted(str(tuple(r)) for r in got) == expected, name
