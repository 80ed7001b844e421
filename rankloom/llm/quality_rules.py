"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good (+1) or bad (-1) on a document or abstain (0). Votes depend on a few counts of the whole text, so a
document is one of at most 3 ** len(RULES) vote patterns; the patterns are counted over all documents, and
expectation-maximisation on these counts estimates the share of good documents and, for each rule and class, how often
its votes are bad ones. The posterior probability of "good" then replaces the all-must-pass filter: one bad vote may be
outvoted by what the other rules see. The driver only holds the pattern counts, whose number does not grow with the
data; applying the model is a column expression.

The estimates start from, and are held by, Beta priors worth STRENGTH votes: a class of bad documents, of which each rule
sees some, against a class that rules seldom object to. They only matter where few documents speak against them (a few
hundred documents, or hardly any bad ones), and keep the names of the two classes from being exchanged. Rules of a group
look at the same thing, so their evidence is divided by the square root of their number. An abstention is no evidence.
Documents that fail the base rules are decided before any vote, so they take no part in the estimation.

Repeated five-word windows are found inside the row: windows are hashed to 64 bits, hashes and positions are sorted
together (the first bits of the hash, then among their finds the last bits), and neighbours of equal hash mark their
positions; the words covered are summed from the gaps. This is linear in the text but for two sorts, and most texts
stop after a distinct count of the hashes.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; repeated rows count each; columns
named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, prepared, table, written

WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
KEEP_FROM = 0.5

#: Common words of the languages in the corpus, in lower case.
COMMON_WORDS = tuple(
    "the of and to in a is that for on with was "
    "der die das und zu den ist im nicht mit von "
    "de la el en que los las un una por es y "
    "le les des du et est pour dans au sur".split()
)

#: name, group, SQL that holds where the rule votes bad, SQL that holds where it votes good; it abstains elsewhere.
RULES = (
    ("symbols", "marks", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("shouting", "marks", "20 * n_marks > n_words", "100 * n_marks <= n_words"),
    ("plain_words", "words", "10 * n_plain < 7 * n_words", "100 * n_plain >= 95 * n_words"),
    ("common_words", "words", "20 * n_common < n_words", "10 * n_common >= n_words"),
    ("word_length", "words", "word_chars > 12 * n_words or word_chars < 2 * n_words", "2 * word_chars >= 7 * n_words and word_chars <= 9 * n_words"),
    ("capitals", "case", "3 * n_upper > word_chars", "20 * n_upper <= 3 * word_chars"),
    ("repeats", "repetition", "10 * n_repeat_words > n_words", "n_words >= 20 and 100 * n_repeat_words <= 2 * n_words"),
    ("lines", "repetition", "n_lines >= 4 and 2 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    ("variety", "repetition", "4 * n_distinct < n_words", "n_words >= 20 and 2 * n_distinct >= n_words"),
    ("sentences", "sentences", "n_words >= 30 and 100 * n_ends < n_words", "100 * n_ends >= 3 * n_words and 5 * n_ends <= n_words"),
)

#: Share of bad votes among a rule's votes that is expected of bad and of good documents, and the votes this is worth.
BAD_VOTES, STRENGTH = (0.3, 0.02), 10.0
#: Share of good documents that is expected, and the documents this is worth.
GOOD_SHARE, SHARE_STRENGTH = 0.75, 10.0
#: Rounds of the estimation.
EM_ROUNDS = 60

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_common", "n_distinct", "n_plain", "n_ends")

#: A word of letters with at most one mark after it, and a full stop at a word's end, in the whole text.
PLAIN, ENDS = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:]?(?![^\x20\x09-\x0D])", r"\.(?![^\x20\x09-\x0D])"


def _repeat_words() -> tuple[Column, Column]:
    """From __h, the hashes of the windows: positions that may repeat, then the words that repeats cover."""
    return (
        F.expr("case when size(__h) > 1 and size(array_distinct(__h)) < size(__h) then "
               "sort_array(transform(__h, (h, i) -> (shiftleft(h, __bits) | cast(i as bigint)))) end"),
        F.expr("case when __s is not null then filter(__s, (x, i) -> "
               "shiftright(x, __bits) = shiftright(get(__s, i - 1), __bits) or shiftright(x, __bits) = shiftright(get(__s, i + 1), __bits)) end"),
    )


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of COUNTS, all long, taken from the whole text; columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    sorted_hashes, candidates = _repeat_words()
    names = [c for c in docs.columns if c not in COUNTS]
    step = (
        docs.withColumn("__t", whole)
        .withColumn("__w", F.filter(F.split("__t", SPACE), lambda x: x != ""))
        .withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("__h", F.expr(
            f"case when size(__w) > {WINDOW} then transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({', '.join(f'get(__w, i + {k})' for k in range(WINDOW))})) end"))
        # As many low bits as a position needs.
        .withColumn("__bits", F.expr("cast(ceil(log2(size(__h) + 1D)) as int)"))
        .withColumn("__s", sorted_hashes)
        .withColumn("__c", candidates)
        .withColumn("__p", F.expr("case when __c is not null then transform(__c, x -> cast(x & (shiftleft(1L, __bits) - 1) as int)) end"))
        # Once more with the other bits of the hash, so that a chance hit would need both parts equal.
        .withColumn("__s", F.expr("case when __p is not null then sort_array(transform(__p, p -> (shiftleft(shiftrightunsigned(get(__h, p), __bits), __bits) | cast(p as bigint)))) end"))
        .withColumn("__c", candidates)
        .withColumn("__p", F.expr("case when __c is not null then sort_array(transform(__c, x -> cast(x & (shiftleft(1L, __bits) - 1) as int))) end"))
        .withColumn("__covered", F.expr(f"case when __p is not null then aggregate(__p, named_struct('n', 0L, 'to', 0), (a, p) -> named_struct('n', a.n + cast(p + {WINDOW} - greatest(p, a.to) as bigint), 'to', p + {WINDOW}), a -> a.n) end"))
    )
    return step.select(
        *names,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce("__covered", F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("__t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.expr(f"size(filter(__w, x -> x in ({', '.join(map(repr, COMMON_WORDS))})))").cast("long").alias("n_common"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.regexp_count("__t", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.regexp_count("__t", F.lit(ENDS)).cast("long").alias("n_ends"),
    )


def voted(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``votes``: the rules' votes as digits of base 3 (bad 0, abstain 1, good 2)."""
    digits = " + ".join(f"{3 ** i} * case when {bad} then 0 when {good} then 2 else 1 end" for i, (_, _, bad, good) in enumerate(RULES))
    return counts.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("votes", F.expr(f"cast({digits} as int)"))


def _digits(votes: int, n: int) -> list[int]:
    return [votes // 3**i % 3 for i in range(n)]


def group_weights(groups: list[str]) -> list[float]:
    return [1 / math.sqrt(groups.count(g)) for g in groups]


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule its weight and the share of bad ones among its votes on bad and on good
    documents."""

    share: float
    weights: tuple[float, ...]
    on_bad: tuple[float, ...]
    on_good: tuple[float, ...]

    def start(self) -> float:
        return math.log(self.share) - math.log(1 - self.share)

    def evidence(self, i: int) -> tuple[float, float]:
        """What a bad and a good vote of a rule add to the log odds of "good"; an abstention adds nothing."""
        bad, good, weight = self.on_bad[i], self.on_good[i], self.weights[i]
        return weight * (math.log(good) - math.log(bad)), weight * (math.log(1 - good) - math.log(1 - bad))

    def posterior(self, digits: list[int]) -> float:
        z = self.start() + sum(self.evidence(i)[d // 2] for i, d in enumerate(digits) if d != 1)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def estimated(patterns: dict[int, int], groups: list[str] | None = None, rounds: int = EM_ROUNDS) -> Model:
    """Expectation-maximisation on the counts of vote patterns.

    The expectation step takes each pattern's posterior under the current model; the maximisation step sets the shares to
    what documents of either class, counted by their posterior, and the priors together say.
    """
    groups = [g for _, g, _, _ in RULES] if groups is None else groups
    n, weights = len(groups), tuple(group_weights(groups))
    model = Model(GOOD_SHARE, weights, (BAD_VOTES[0],) * n, (BAD_VOTES[1],) * n)
    rows = [(_digits(v, n), c) for v, c in sorted(patterns.items())]
    total = sum(c for _, c in rows)
    for _ in range(rounds):
        bad, cast, good = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)], 0.0
        evidence = [model.evidence(i) for i in range(n)]
        for digits, count in rows:
            z = model.start() + sum(e[d // 2] for e, d in zip(evidence, digits, strict=True) if d != 1)
            p = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))
            parts = count * (1 - p), count * p
            good += parts[1]
            for i, d in enumerate(digits):
                if d != 1:
                    for c in (0, 1):
                        cast[i][c] += parts[c]
                        bad[i][c] += parts[c] * (d == 0)
        on = [tuple((bad[i][c] + STRENGTH * BAD_VOTES[c]) / (cast[i][c] + STRENGTH) for i in range(n)) for c in (0, 1)]
        model = Model((good + SHARE_STRENGTH * GOOD_SHARE) / (total + SHARE_STRENGTH), weights, *on)
    return model


def pattern_counts(votes: DataFrame) -> dict[int, int]:
    """Documents of each vote pattern that pass the base rules: at most 3 ** len(RULES) rows, however many documents."""
    return {r.votes: r.n for r in votes.where(~F.col("base_failed")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}


def judged(votes: DataFrame, model: Model) -> DataFrame:
    """Adds ``posterior`` and ``kept``."""
    odds = F.lit(model.start())
    for i in range(len(model.weights)):
        digit, (bad, good) = F.expr(f"votes div {3 ** i} % 3"), model.evidence(i)
        odds = odds + F.when(digit == 0, F.lit(bad)).when(digit == 2, F.lit(good)).otherwise(F.lit(0.0))
    return votes.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    votes = written(voted(counted(docs)).drop("text"), "votes")
    done = judged(votes, estimated(pattern_counts(votes)))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules' posterior keeps."""
    prepared(spark)
    votes = written(voted(counted(boxed(docs, "text"))).select("__row", "votes", "base_failed"), "votes")
    return judged(votes, estimated(pattern_counts(votes))).where("kept").select("__row.*")


def op1_sql() -> str:
    """Counts, votes and estimation in the oracle's dialect; a round of the estimation is a recursion.

    Written out from the rules' definitions: v0 to v9 are the rules' votes (0 bad, 1 none, 2 good), ``r`` holds the shares
    of bad votes on bad documents (1 to 10), on good ones (11 to 20), and the share of good documents (21).
    """
    groups = (2, 2, 3, 3, 3, 1, 3, 3, 3, 1)
    odds = "ln(r[21]) - ln(1 - r[21])" + "".join(
        f" + CASE v{i} WHEN 0 THEN (ln(r[{i + 11}]) - ln(r[{i + 1}])) / sqrt({g}) WHEN 2 THEN (ln(1 - r[{i + 11}]) - ln(1 - r[{i + 1}])) / sqrt({g}) ELSE 0 END" for i, g in enumerate(groups)
    )
    share = lambda i, p, expected: f"(coalesce(sum(n * {p}) FILTER (v{i} = 0), 0) + 10 * {expected}) / (coalesce(sum(n * {p}) FILTER (v{i} <> 1), 0) + 10)"
    step = ", ".join([share(i, "(1 - p)", 0.3) for i in range(10)] + [share(i, "p", 0.02) for i in range(10)] + ["(sum(n * p) + 7.5) / (sum(n) + 10)"])
    every = ", ".join(f"v{i}" for i in range(10))
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS r(i)),
twice AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN twice USING (doc_id, s), unnest(range(5)) AS x(k) GROUP BY doc_id),
ls AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ls.n - ls.d, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(ls.n, 0) AS n_lines,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
  len(list_filter(ws, lambda x: x IN ({common}))) AS n_common, len(list_distinct(ws)) AS n_distinct,
  len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}+[.,;:]?$'))) AS n_plain, len(list_filter(ws, lambda x: ends_with(x, '.'))) AS n_ends
  FROM w LEFT JOIN ls ON ls.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_symbols > n_words / 20 THEN 0 WHEN n_symbols <= n_words / 100 THEN 2 ELSE 1 END AS v0,
  CASE WHEN n_marks > n_words / 20 THEN 0 WHEN n_marks <= n_words / 100 THEN 2 ELSE 1 END AS v1,
  CASE WHEN n_plain * 10 < n_words * 7 THEN 0 WHEN n_plain * 20 >= n_words * 19 THEN 2 ELSE 1 END AS v2,
  CASE WHEN n_common < n_words / 20 THEN 0 WHEN n_common >= n_words / 10 THEN 2 ELSE 1 END AS v3,
  CASE WHEN word_chars NOT BETWEEN 2 * n_words AND 12 * n_words THEN 0 WHEN word_chars * 2 BETWEEN 7 * n_words AND 18 * n_words THEN 2 ELSE 1 END AS v4,
  CASE WHEN n_upper * 3 > word_chars THEN 0 WHEN n_upper * 20 <= word_chars * 3 THEN 2 ELSE 1 END AS v5,
  CASE WHEN n_repeat_words > n_words / 10 THEN 0 WHEN n_words >= 20 AND n_repeat_words <= n_words / 50 THEN 2 ELSE 1 END AS v6,
  CASE WHEN n_lines >= 4 AND n_dup_lines > n_lines / 2 THEN 0 WHEN n_lines >= 3 AND n_dup_lines = 0 THEN 2 ELSE 1 END AS v7,
  CASE WHEN n_distinct < n_words / 4 THEN 0 WHEN n_words >= 20 AND n_distinct >= n_words / 2 THEN 2 ELSE 1 END AS v8,
  CASE WHEN n_words >= 30 AND n_ends < n_words / 100 THEN 0 WHEN n_ends * 100 >= n_words * 3 AND n_ends * 5 <= n_words THEN 2 ELSE 1 END AS v9 FROM c),
p AS (SELECT {every}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY {every}),
em(it, r) AS (
  SELECT 0, list_concat(list_concat(list_transform(range(10), lambda x: 0.3::DOUBLE), list_transform(range(10), lambda x: 0.02::DOUBLE)), [0.75::DOUBLE])
  UNION ALL
  SELECT it + 1, [{step}]::DOUBLE[] FROM (SELECT it, r, n, {every}, 1 / (1 + exp(-({odds}))) AS p FROM em, p WHERE it < {EM_ROUNDS}) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM v, em WHERE it = (SELECT max(it) FROM em)
"""
