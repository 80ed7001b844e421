"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.
TREES independent trees branch the nodes by selected minwise tokens: the path from a root is the row of tokens chosen
so far, and nodes that share a path meet. Below the first level only those branches are followed that are too large
to compare exhaustively and hold documents not yet joined to each other. A tree keeps two documents of similarity 0.8
together on its first level with probability 0.8, so TREES independent trees miss 0.2 ** TREES of the pairs there; a
large branch is split with two chosen tokens at once, which keeps 0.96 a level. What is still large after LEVELS levels
is compared block against block, so nothing is dropped.

Documents whose words are the same (but for white space and A-Z) are one node of the join, known by its smallest id.

The join runs twice. First on minwise signatures alone, which gathers documents whose signatures may belong to similar
sets into families. Then the members of a family are compared on their full sets, by counting shingles in common: all
with all, block against block, so that a task holds two blocks, which are bounded by rows and by shingles.
Families of more than SMALL members are branched again, by batches of trees, and only branches whose members exact
links don't join yet are compared.

Neither run makes all pairs: a branch links its members to its smallest one, or returns just the links that join its
members. Links, families and sets stay in tables; the driver only learns whether a table is empty. Hot branches and hot
groups of copies are counted with partial aggregation, and joined with the counts by joins that may be split.

Sets are compared by 64-bit hashes of their shingles. In the end every link is confirmed on the two texts' shingles
themselves; should one not hold, which takes two shingles of one hash, the join runs again with other hashes.

Defined results: texts without words (and null texts) have an empty set, link with nothing and are their own component;
rows of one id are one document, with the links of all its texts; a row without an id belongs to the component of its
text's copies, if any has an id, and else stays; equal ids of equal texts all stay or all go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, dropped, expanded, keeps, lean, prepared, runs, scope, slices, squeezed, table, written
from .shingles import exact_shingles, normalised, polynomials, shingle_sets, signatures

TREES = 16
COORDINATES = 64
#: Of two sets of similarity 0.8, fewer than so many of the 64 minwise hashes agree once in ten million pairs.
AGREE = 33
#: Members of a branch that are compared exhaustively, and of a block when full sets are compared.
SMALL, BLOCK = 4096, 512
#: Shingles of a block when full sets are compared.
BLOCK_SHINGLES = 1 << 18
#: Edges whose components one task finds (its memory is some 50 bytes an edge); more are contracted by stars.
FEW_EDGES = 1_000_000
LEVELS = 6
SEED = 90_125
WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80


keeps(__name__, polynomials.cache_clear)


def sketched(docs: DataFrame, words: int, salt: int = 0) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of whole texts; set_key, null for empty sets, is a digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column("text")):
                texts = batch.column("text").slice(low, high - low)
                sets = shingle_sets(texts, words, salt)
                sig = signatures(sets, COORDINATES, SEED).view(np.int32)
                keys = [hashlib.blake2b(normalised(t.as_py()), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets, strict=True)]
                at = np.arange(0, (len(sets) + 1) * COORDINATES, COORDINATES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(at, pa.array(sig.ravel()))],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, sig array<int>")


def _sets(docs: DataFrame, ids: DataFrame, words: int, salt: int) -> DataFrame:
    """(id, family, set) of the documents in ``ids``; texts are moved compressed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in expanded(batches, rows=256):
            texts = own.column("text")
            found = [s.tobytes() for a, b in slices(texts) for s in shingle_sets(texts.slice(a, b - a), words, salt)]
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("family"), pa.array(found, pa.binary())], names=["id", "family", "set"])

    packed = squeezed(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null"))
    # Not by broadcast, which would put two functions of Python into one task.
    return packed.join(ids.select("id", "family").hint("merge"), "id").mapInArrow(lean(sets), "id long, family long, set binary")


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that sizes and signatures allow."""
    one = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    agree = F.expr("aggregate(zip_with(sig_a, sig_b, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    return both.where((100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (agree >= AGREE)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every other id that has a link; a written table.

    Up to FEW_EDGES edges meet in one task. More are contracted by large and small stars in turn until nothing changes,
    every round of which is written to the shared folder; the result is the same.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        found = written(edges.coalesce(1).mapInArrow(lean(_united), "id long, component long"), "components")
        dropped(edges)
        return found
    state = None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("v")), "least")
        moved = large.join(small.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(moved.unionByName(small).distinct(), "edges")
        dropped(before, least, large, small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            found = written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "components")
            dropped(edges)
            return found
        state = now


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task: every vertex takes the least label around it, then its label's label."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not held:
        return
    left, right = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = at[: len(left)], at[len(left) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right):  # also what the vertex's label stands for
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["id", "component"])


class _Forest:
    """Components of the rows of a group; ``labels`` start as the components known before."""

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links row ``i`` with one row of each other component among ``others``."""
        labels, first = np.unique(self.labels[others], return_index=True)
        for label, k in zip(labels, first, strict=True):
            if label != self.labels[i]:
                self.links.append((i, int(others[k])))
                self.labels[self.labels == label] = self.labels[i]


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def _linked_signatures(rows: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) that join the members of each group as far as sizes and signatures allow. rows: (key, id, comp, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in runs(batches, "key"):
            ids, comp, size = (group.column(c).to_numpy() for c in ("id", "comp", "n"))
            sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
            forest = _Forest(comp)
            for i in range(len(ids) - 1):
                other = i + 1 + np.flatnonzero((forest.labels[i + 1 :] != forest.labels[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i])))
                if len(other):
                    forest.join(i, other[(sig[other] == sig[i]).sum(axis=1) >= AGREE])
            left += [int(ids[i]) for i, _ in forest.links]
            right += [int(ids[j]) for _, j in forest.links]
            if len(left) > 50_000:
                yield _links(left, right)
                left, right = [], []
        yield _links(left, right)

    return _grouped(rows.select("key", "id", "comp", "n", "sig")).mapInArrow(lean(run), "a long, b long")


def _links(left: list[int], right: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, exactly."""
    n = len(sets)
    if n == 2:
        both = len(sets[0]) + len(sets[1]) - len(np.unique(np.concatenate(sets)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(token)) > 1
    column_of = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], column_of[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts, width = np.zeros((n, n)), 8192
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        counts += part @ part.T
    out = np.rint(counts).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _linked_sets(rows: DataFrame, similarity: int, label: str) -> DataFrame:
    """Links (a, b) that join the members of each group exactly; ``label``: components known before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "key"):
            if group.num_rows < 2:
                continue
            ids = group.column("id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
            counts, size = common_counts(sets), np.array([len(s) for s in sets])
            similar = 100 * counts >= similarity * (size[:, None] + size[None, :] - counts)
            forest = _Forest(group.column(label).to_numpy())
            for i in range(len(ids) - 1):
                other = i + 1 + np.flatnonzero(similar[i, i + 1 :])
                if len(other):
                    forest.join(i, other)
            yield _links([int(ids[i]) for i, _ in forest.links], [int(ids[j]) for _, j in forest.links])

    return _grouped(rows.select("key", "id", "set", *({label} - {"id"}))).mapInArrow(lean(run), "a long, b long")


def _counted(entries: DataFrame, label: str) -> DataFrame:
    """Branches of (key, id, comp) whose members aren't all linked: (key, size, pivot)."""
    stats = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return written(stats.where("low <> high").select("key", "size", "pivot"), label)


def _met(branches: DataFrame, block: int, total: str = "0") -> DataFrame:
    """Rows of branches (key, id, size, ...) once for each pair of blocks that their block is in; a small branch is one.

    total: SQL for the shingles of all members.
    """
    blocks = f"if(size <= 2 * {block} and {total} <= 2 * {BLOCK_SHINGLES}, 1, cast(ceil(greatest(size / {block}D, {total} / {BLOCK_SHINGLES}D)) as int))"
    meet = f"transform(sequence(0, {blocks} - 1), o -> xxhash64(key, least(o, pmod(hash(id), {blocks})), greatest(o, pmod(hash(id), {blocks}))))"
    return branches.withColumn("key", F.explode(F.expr(meet)))


def _branched(entries: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Small branches (key, id, comp) below the given ones, as far down as needed; what stays large meets by blocks."""
    found = None
    for level in range(LEVELS + 1):
        open_ = entries.join(_counted(entries, "branches").select("key", "size"), "key")
        if level:
            open_ = written(open_, "open")
        small, large = open_.where(F.col("size") <= most).drop("size"), open_.where(F.col("size") > most)
        if level == LEVELS:
            small = small.unionByName(_met(large, most).drop("size"))
        found = small if found is None else found.unionByName(small)
        if level == LEVELS or large.isEmpty():
            return found
        child = f"explode(array({', '.join(f'xxhash64(key, {j}, sig[pmod(xxhash64(key, {j}), {COORDINATES})])' for j in (0, 1))}))"
        entries = written(large.join(nodes.select("id", "sig"), "id").select(F.expr(child).alias("key"), "id", "comp"), "entries")
    return found


def _roots(trees: range, *prefix: str):
    return F.explode(F.expr(f"transform(sequence({trees.start}, {trees.stop - 1}), t -> xxhash64({''.join(p + ', ' for p in prefix)}t, sig[t]))"))


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def families(nodes: DataFrame, similarity: int) -> DataFrame:
    """(id, family) of nodes (id, n, sig) whose signatures may belong to sets similar to another's."""
    with scope() as keep:
        roots = nodes.select(F.col("id"), F.col("id").alias("comp"), _roots(range(TREES)).alias("key"))
        members = written(roots.join(_counted(roots, "branches"), "key").select("key", "id", "pivot"), "members")
        stars = written(_alike(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), nodes, similarity), "stars")
        entries = written(_with_components(members.select("key", "id"), components(stars)), "entries")
        small = _branched(entries, nodes, SMALL).join(nodes, "id")
        more = written(_linked_signatures(small, similarity).distinct(), "more")
        return keep(written(components(stars.unionByName(more)).withColumnRenamed("component", "family"), "families"))


def _sized(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, id, ...) with the members and shingles of their group."""
    sizes = rows.select("key", "id").join(nodes.select("id", "n"), "id").groupBy("key").agg(F.countDistinct("id").alias("size"), F.sum("n").alias("total"))
    return rows.join(written(sizes, "sizes"), "key")


def links_of(nodes: DataFrame, docs: DataFrame, words: int, similarity: int, salt: int = 0) -> DataFrame:
    """Exact links (a, b), but for shingles of one hash, that join whatever nodes (id, n, sig) similar links join."""
    with scope() as keep:
        own = families(nodes, similarity)
        own = own.unionByName(own.select(F.col("family").alias("id"), "family").distinct())
        sets = written(_sets(docs, own, words, salt), "sets")
        compared = lambda rows, label: _linked_sets(_met(rows, BLOCK, "total"), similarity, label)
        sized = _sized(own.withColumnRenamed("family", "key"), nodes)
        small = sets.withColumnRenamed("family", "key").join(sized.where(F.col("size") <= SMALL).select("key", "size", "total").distinct(), "key")
        links = written(compared(small, "id").distinct(), "links")
        large = sized.where(F.col("size") > SMALL)
        if large.isEmpty():
            return keep(links)
        large = written(large.select("id", F.col("key").alias("family")).join(nodes.select("id", "sig"), "id"), "large")
        for trees in (range(1), range(1, 4), range(4, TREES)):
            entries = _with_components(large.select("id", _roots(trees, "family").alias("key")), components(links))
            branches = _sized(written(_branched(written(entries, "entries"), nodes, SMALL), "branches"), nodes)
            links = written(links.unionByName(compared(branches.join(sets.select("id", "set"), "id"), "comp")).distinct(), "links")
        return keep(links)


def unconfirmed(links: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The links (a, b) that don't hold between any texts of the two ids, by their shingles themselves."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, own = zstandard.ZstdDecompressor().decompress, None, set()
        shingles = lambda packed: exact_shingles(normalised(unpack(packed).decode()), words)
        for batch in batches:
            holds = []
            for one, two in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                one, two = one.as_py(), two.as_py()
                if one != last:
                    last, own = one, shingles(one)
                other = shingles(two)
                both = len(own & other)
                holds.append(both > 0 and 100 * both >= similarity * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(holds, pa.bool_())], names=["a", "b", "holds"])

    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    texts = written(squeezed(named.join(ids, "id", "left_semi")), "linked")
    both = links.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.mapInArrow(lean(judged), "a long, b long, holds boolean").groupBy("a", "b").agg(F.max("holds").alias("holds")).where("not holds").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, salt: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of (doc_id, text)."""
    prepared(docs.sparkSession)
    with scope() as keep:
        sketches = keep(written(sketched(docs, words, salt), "sketches"))
        known = sketches.where("set_key is not null")
        first = keep(written(known.groupBy("set_key").agg(F.min("doc_id").alias("id")), "first"))
        nodes = written(known.join(first.where("id is not null").select(F.col("id"), F.col("set_key").alias("__key")), (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("__key"))).select("id", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["id", "sig"]), "nodes")
        same_id = known.where("doc_id is not null").join(first, "set_key").where("doc_id <> id").select(F.col("doc_id").alias("b"), F.col("id").alias("a"))
        # A document of several texts links the nodes of all of them; for ids of one text, which most are, this is a copy's link.
        twice = same_id.join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
        links = links_of(nodes, docs, words, similarity, salt)
        again = not unconfirmed(links, docs, words, similarity).isEmpty()
        if not again:
            comps = keep(components(links.select("a", "b").unionByName(twice)))
    if again:
        dropped(sketches, first)
        return near_duplicates(docs, words, similarity, salt + 1)
    done = sketches.join(first, "set_key", "left").withColumn("id", F.coalesce("id", "doc_id")).join(comps, "id", "left")
    component = F.coalesce("component", "id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows without an id are each a
    document of their own, which gets a number above all ids, so that they stay only where no row with an id does."""
    prepared(spark)
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if nameless.isEmpty():
        return _first_ones(docs, near_duplicates(docs.select("doc_id", "text")))
    above = (named.agg(F.max("doc_id").cast("long")).first()[0] or 0) + 1
    numbered = written(boxed(nameless).select((F.lit(above) + F.monotonically_increasing_id()).alias("doc_id"), "__row"), "numbered")
    judged = written(near_duplicates(named.select("doc_id", "text").unionByName(numbered.select("doc_id", F.col("__row.text").alias("text")))).where(~F.col("kept")), "judged")
    return _first_ones(named, judged).unionByName(_first_ones(numbered, judged).select("__row.*"))


def _first_ones(docs: DataFrame, judged: DataFrame) -> DataFrame:
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.doc_id), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
