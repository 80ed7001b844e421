"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

Terms are runs of letters of ASCII (A-Z lower-cased) and of all characters from U+0080 on. Each language keeps the terms of
at least MIN_DOCS of its documents, V of them. A group (lang, source) gives a kept term with c occurrences of its N the
smoothed share p = 1 + floor(10^9 (c + 2) / (N + 2V)); f(p, q) = floor((p - q)^2 / (p + q)) is symmetric. All is exact
whole-number arithmetic.

* ``pairs``: sums of f over all kept terms for each two groups of a language. Terms that neither group holds are most of
  them, so the sum starts from V f(p0, q0), with p0 the share of a term that a group lacks. Terms that one group holds are
  added by its count buckets (terms of equal count have equal p), terms that both hold are corrected from the postings:
  a task walks over the postings of its terms and adds up a vector over pairs of groups, so that pairs of a term are
  never rows.
* ``terms``: the K terms of each group that lie highest above the language as a whole. f falls as the language's share
  q rises towards p, so a bucket of equal counts is bounded by f at the smallest q in it, and its term with this q
  attains the bound. Buckets are taken best bound first; the K-th of these bounds is a value that K terms reach, so what
  is strictly below can't be among the best K and isn't evaluated. All terms of the others are.

Texts are counted in tasks (whole texts, a bounded number of words held), then summed by group and term. Memory follows from
the number of words held (HELD), of a term's groups, and of pairs (PAIRS) in a task's vector.

Defined results: null texts, languages and sources count as empty strings; a group without terms has rank rows with the
values that its p0 give; a language without kept terms has pairs of value 0 and no terms; repeated rows count each; an empty
table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, prepared, scope, table, written

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Words that a task holds before it hands their counts on (long ones count once every 128 bytes); pairs of groups in a
#: task's vector.
HELD, PAIRS = 500_000, 200_000
#: Pairs of one step over postings.
STEP = 1 << 20

#: Bytes of UTF-8 that belong to terms are kept (ASCII letters in lower case), all others are spaces.
_TERMS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_TERMS).split()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); a row with an empty term for every group.

    Tasks sum up before rows are shuffled, and all rows of a language's term go to one partition (at most a row for each
    task and source), so that what is asked of the term as a whole needs no other exchange.
    """
    prepared(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), (n, found) in held.items():
                names = [own_lang, own_source]
                n[b""], found[b""] = 0, 0
                columns = [pa.array([x] * len(n), pa.string()) for x in names]
                columns += [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([found[w] for w in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for own_lang, own_source, value in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                own = words(value.as_py())
                n, found = held.setdefault((own_lang, own_source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                found.update(set(own))
                size += len(n) - before + sum(len(x) >> 7 for x in set(own) if len(x) > 127)  # long terms weigh by their bytes
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = named.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 terms)), by a division of whole numbers, for counts of any size."""
    return F.expr(f"1L + (cast({count} + 2 as decimal(20,0)) * cast({UNIT} as decimal(10,0))) div cast({total} + 2 * {terms} as decimal(20,0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Parts ``pair`` and ``term`` of all groups: lang, source, part, item, value, rank."""
    with scope() as keep:
        whole = Window.partitionBy("lang", "term")
        counts = counted(docs, text, lang, source).withColumn("lang_n", F.sum("n").over(whole)).withColumn("d", F.sum("docs").over(whole))
        kept = keep(written(counts.where((F.col("term") == "") | (F.col("d") >= min_docs)).drop("d", "docs"), "postings"))
        found = kept.where("term != ''")
        groups = keep(written(_groups(kept), "groups"))
        postings = found.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("lang_n", "lang_total", "terms"))
        buckets = keep(written(postings.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).alias("k"), F.min("q").alias("q")), "buckets"))
        both = keep(written(_both(postings.select("lang", "term", "source", "p", "p0")), "both"))
    return _pairs(groups, buckets, both).unionByName(_terms(postings, buckets, top))


def _groups(kept: DataFrame) -> DataFrame:
    """Every group with its occurrences of kept terms (total), those of the language, its number of kept terms, and p0."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Every group has a row without a term, so none is missing here. A term counts once in its language.
    terms = kept.where("term != ''").groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    named = groups.join(whole, "lang", "left").select("lang", "source", "total", zero("terms"), zero("lang_total"))
    return named.withColumn("p0", F.when(F.col("terms") > 0, F.expr(f"1L + (cast(2 as decimal(20,0)) * cast({UNIT} as decimal(10,0))) div cast(greatest(total + 2 * terms, 1L) as decimal(20,0))")))


def _both(postings: DataFrame) -> DataFrame:
    """lang, source, other (source < other), value: over terms that both hold, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        sums: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if sums:
                low, high = np.divmod(np.fromiter(sums, "i8", len(sums)), 1 << 31)
                rows = [(*names[i], names[j][1], v) if names[i][1] < names[j][1] else (*names[j], names[i][1], v) for i, j, v in zip(low.tolist(), high.tolist(), sums.values(), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], names=["lang", "source", "other", "value"])
            sums.clear()
            number.clear()
            names.clear()

        def add(group: np.ndarray, p: np.ndarray, p0: np.ndarray, term: np.ndarray) -> None:
            """Pairs of a row with all later rows of its term, at most some STEP at once."""
            size = np.bincount(term)
            rest = np.repeat(np.cumsum(size), size) - np.arange(len(term)) - 1  # later rows of the same term
            at = 0
            done = np.concatenate([[0], np.cumsum(rest)])
            while at < len(rest):
                high = max(int(np.searchsorted(done, done[at] + STEP, "right")) - 1, at + 1)
                i = np.repeat(np.arange(at, high), rest[at:high])
                j = i + 1 + np.arange(len(i)) - np.repeat(done[at:high] - done[at], rest[at:high])
                value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                a, b = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                pair, where = np.unique(a * (1 << 31) + b, return_inverse=True)
                total = np.zeros(len(pair), "i8")
                np.add.at(total, where, value)
                for x, v in zip(pair.tolist(), total.tolist(), strict=True):
                    sums[x] = sums.get(x, 0) + v
                at = high

        held: pa.Table | None = None

        def whole(rows: pa.Table) -> None:
            groups = list(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True))
            for x in groups:
                if x not in number:
                    number[x] = len(names)
                    names.append(x)
            keys = list(zip((x for x, _ in groups), rows.column("term").to_pylist(), strict=True))
            new = np.array([True] + [a != b for a, b in zip(keys[1:], keys[:-1], strict=True)])
            add(np.array([number[x] for x in groups], "i8"), rows.column("p").to_numpy(), rows.column("p0").to_numpy(), np.cumsum(new) - 1)

        for batch in batches:  # rows of a term stand together; the last term may go on in the next batch
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            n = rows.num_rows
            last = (rows.column("lang")[n - 1].as_py(), rows.column("term")[n - 1].as_py())
            cut = n
            while cut and (rows.column("lang")[cut - 1].as_py(), rows.column("term")[cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                whole(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks()
            if len(sums) > PAIRS:
                yield from flush()
        if held is not None and held.num_rows:
            whole(held)
        yield from flush()

    sorted_rows = postings.repartition("lang", "term").sortWithinPartitions("lang", "term")
    rows = sorted_rows.mapInArrow(lean(run), "lang string, source string, other string, value long")
    return rows.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def _pairs(groups: DataFrame, buckets: DataFrame, both: DataFrame) -> DataFrame:
    one = groups.select("lang", "source", F.col("p0").alias("a0"), "terms")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("b0"))
    every = one.join(other, "lang").where("source != other")
    base = every.select("lang", "source", "other", F.expr(f"if(terms > 0, terms * ({_f('a0', 'b0')}), 0L)").alias("value"))
    # Over terms that the first holds; the same sum with the groups changed over is that of the second's terms.
    held = buckets.select("lang", "source", "p", "k")
    single = every.join(held, ["lang", "source"]).groupBy("lang", "source", "other").agg(F.sum(F.expr(f"k * (({_f('p', 'b0')}) - ({_f('a0', 'b0')}))")).alias("value"))
    turned = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    parts = base.unionByName(single).unionByName(turned(single)).unionByName(both).unionByName(turned(both))
    total = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    return total.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank"))


def _terms(postings: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    bound = buckets.where("p > q").select("lang", "source", "n", F.expr(_f("p", "q")).alias("bound"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), F.desc("n"))
    kth = bound.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= top).groupBy("lang", "source").agg(F.min("bound").alias("kth"), F.count(F.lit(1)).alias("seen"))
    opened = bound.join(kth, ["lang", "source"]).where(F.expr(f"seen < {int(top)} or bound >= kth")).select("lang", "source", "n")
    value = postings.join(opened, ["lang", "source", "n"], "left_semi").where("p > q").select("lang", "source", "term", F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: From the definitions: every kept term of every group, and of every pair of groups.
OP12_SQL = rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as lang_n from w group by all having count(distinct i) >= {MIN_DOCS}),
whole as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from kept group by all),
c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
s as (select lang, source, term, coalesce(n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) as p,
    1 + ({UNIT}::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
    from totals join whole using (lang) join kept using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::hugeint as value
    from s a join s b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source != b.source left join f on f.lang = a.lang and f.source = a.source and f.other = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from s where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP}
"""
