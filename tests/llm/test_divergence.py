"""Source divergence against its definition, in plain Python and in SQL."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import divergence
from rankloom.llm.registry import oracle_sql, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNIT = 10**9


def expected(rows, min_docs=10, top=10):
    docs = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in docs}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, lg, s in docs if lg == lang]
        seen = Counter(w for ws, _ in own for w in set(ws))
        kept = [w for w, n in seen.items() if n >= min_docs]
        counts = {s: Counter() for _, s in own}
        for ws, s in own:
            counts[s].update(w for w in ws if seen[w] >= min_docs)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + UNIT * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {w: share(c, w) for w in kept} for s, c in counts.items()}
        q = {w: share(whole, w) for w in kept}
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in counts if t != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            out += [(lang, s, "pair", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def rows_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in divergence.audited(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def mixed(n):
    """Documents of some sources whose words differ by rule, with ties, odd characters, nulls and a hot source."""
    rows = [(None, "en", "null text"), ("", None, None), ("123 !?", "en", "no terms"), ("solo", "xx", "only"), ("É" * 300 + " long", "en", None)]
    for i in range(n):
        words = [f"w{'abcdefghij'[(i * j) % 10]}" for j in range(i % 9)] + ["The", "THE", "the", "naïve", "Ünder", "x_y-z"] * (i % 3) + [f"tie{'abc'[i % 3]}"] * 2
        rows.append((" ".join(words), ("en", "de", None)[i % 7 % 3], f"s{i % 11 % 4}" if i % 3 else "hot"))
    return rows


@pytest.mark.parametrize("n", [0, 9, 150])
def test_equals_the_definition(spark, n):
    rows = mixed(n)
    assert rows_of(spark, rows) == expected(rows)
    assert rows_of(spark, rows, min_docs=1, top=3) == expected(rows, 1, 3)


def test_small_tasks_and_steps_change_nothing(spark, monkeypatch):
    rows = mixed(120)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PAIRS", 1)
    monkeypatch.setattr(divergence, "STEP", 2)
    assert rows_of(spark, rows, min_docs=2) == expected(rows, 2)


def test_shares_of_counts_beyond_long_products(spark):
    row = spark.range(1).select(F.lit(9 * 10**15).alias("n"), F.lit(10**16).alias("total"), F.lit(12345).cast("long").alias("terms"))
    got = row.select(divergence._share("n", "total", "terms").alias("p")).first().p
    assert got == 1 + UNIT * (9 * 10**15 + 2) // (10**16 + 2 * 12345)


def test_buckets_that_cannot_win_are_not_opened(spark):
    """A group whose terms have many different counts: few of them are evaluated."""
    alpha = "abcdefghijklmnopqrstuvwxyz"
    rows = [(" ".join(f"t{alpha[k // 26]}{alpha[k % 26]}" for k in range(60) for _ in range(k + 1 if s == "a" else 7)), "en", s) for s in ("a", "b") for _ in range(10)]
    assert rows_of(spark, rows) == expected(rows)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(mixed(60), "text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in divergence.audited(docs).collect())
    assert got == expected(mixed(60))
    assert divergence.audited(docs.limit(0)).collect() == []


def test_op12_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    want = con.execute(f"select lang, source, part, item, value, rank from ({oracle_sql()['op12_source_divergence']})").fetchall()
    got = [tuple(r) for r in queries()["op12_source_divergence"](spark, folder).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got} == {"pair", "term"}
