"""URL filter: explicit rules first, then logistic regression on hashed character n-grams, in DataFrame functions only.

The model is fitted on a small labelled URL table (of a larger one, on MAX_LABELLED rows, so that it can be gathered) with
full-batch gradient steps; the default one is made by rule from word lists, and takes nothing from the tables that are judged. Judging a URL is one column expression: n-grams of host and of path are hashed into
BUCKETS, their learned weights are summed, and the sign of the sum decides. Nothing is shuffled or joined.

Defined results: a null url, or one without ``://``, has empty host and path, no rule fits it, and its verdict comes
from the marks of empty parts and the intercept. Rules compare bytes; only A-Z of the host is lower-cased. Repeated rows
stay; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 16_384
GRAM = 4
MAX_LABELLED = 20_000

#: (action, rule); a rule is a host, then a path prefix from the first slash on.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: What the default labelled table is made of: words of hosts to block, and ordinary words of four languages.
BAD_WORDS = (
    "casino", "poker", "slots", "jackpot", "roulette", "betting", "bets", "gambling", "pills", "pharmacy", "viagra", "cialis", "xxx", "porn", "adult", "sexcam", "escorts", "nude",
    "torrent", "warez", "crack", "keygen", "serial", "spam", "adserver", "adclick", "ads", "tracker", "banner", "popup", "phishing", "malware", "scam", "lottery", "prizes", "winner",
    "payday", "loans", "replica", "clickbait", "linkfarm", "forex", "bitcoin-doubler", "miracle-diet", "weightloss",
)
GOOD_WORDS = (
    "news", "library", "museum", "school", "garden", "recipe", "travel", "history", "science", "weather", "music", "theatre", "cycling", "village", "council", "hospital", "university",
    "journal", "archive", "market", "forum", "docs", "wiki", "photo", "nature", "astronomy", "knitting", "chess", "bakery", "freedom", "farming", "choir", "house", "better", "field",
    "mountain", "river", "people", "water", "paper", "animal", "world", "children", "country", "letter", "mother", "answer", "story", "family", "night", "number", "street", "picture",
    "important", "together", "understand", "government", "information", "education", "community", "development", "international", "engineering", "language", "business", "service",
    "zeitung", "schule", "garten", "wetter", "stadt", "kirche", "bahn", "buch", "arbeit", "gesundheit", "wissenschaft", "nachrichten", "verein", "freunde", "strasse", "tagblatt",
    "journaux", "ecole", "jardin", "cuisine", "voyage", "mairie", "monde", "livre", "sante", "region", "associations", "enfants", "recherche", "musique", "femme", "temps",
    "noticias", "escuela", "ciudad", "cocina", "viajes", "gobierno", "salud", "libro", "trabajo", "mundo", "pueblo", "deporte", "universidad", "historia", "pais", "tiempo",
)
_SHAPES = ("{a}{b}", "{a}-{b}", "{b}-{a}", "{a}", "www.{a}{b}", "{b}{a}", "{b}.{a}", "the{a}", "{a}online", "my-{a}")
_ENDS = ("com", "org", "net", "co.uk", "de", "fr", "es", "edu", "info", "xyz", "top", "eu")
_PATHS = ("/", "", "/index.html", "/{c}", "/{c}/{n}", "/{c}.html", "/2019/11/{c}", "/?q={c}", "/{c}/{d}", "/view?id={n}", "/{d}/{n}/{c}")
#: The share of URLs to block that fitting assumes, whatever the table's: unknown names are allowed.
SHARE = 0.1


def labelled_urls(part: int | None = None) -> list[tuple[str, int]]:
    """The default labelled table, made by rule: (url, 1 to block or 0 to allow).

    Hosts are one or two words of a class, in the same shapes and under the same ends for both, and so are paths, which are
    made of ordinary words alone. part: 0 or 1 for the URLs of every other word of both lists, which have no word in common.
    """
    good = [w for i, w in enumerate(GOOD_WORDS) if part is None or i % 2 == part]
    bad = [w for i, w in enumerate(BAD_WORDS) if part is None or i % 2 == part]
    out, number = [], 0
    for words, label, times in ((bad, 1, 16), (good, 0, 16)):
        for i, word in enumerate(words):
            for k in range(times):
                number += 1
                # A host to block may have an ordinary second word.
                other = (good if label and k % 2 else words)[(i * 7 + k * 5 + 1) % len(good if label and k % 2 else words)]
                host = f"{_SHAPES[(i + k) % len(_SHAPES)].format(a=word, b=other)}.{_ENDS[number * 5 % len(_ENDS)]}"
                path = _PATHS[number * 3 % len(_PATHS)].format(c=good[number * 11 % len(good)], d=good[number * 13 % len(good)], n=number * 7919 % 49_999)
                out.append((f"http{'s' * (number % 2)}://{host}{path}", label))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL; the labelled table is split with it, and tests hold the columns against it."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans(_UPPER, _LOWER)), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def _grams(host: str, path: str) -> list[int]:
    out = []
    for text in ("h^" + host + "$", "p^" + path + "$"):
        # A text shorter than a gram is one gram.
        for i in range(max(len(text) - GRAM, 0) + 1):
            out.append(int(hashlib.md5((text[0] + text[i : i + GRAM]).encode()).hexdigest()[:6], 16) % BUCKETS)
    return out


def fit(labelled: list[tuple[str, int]], steps: int = 1500, rate: float = 20.0, decay: float = 2e-5, share: float = SHARE) -> list[float]:
    """Weights by bucket, the intercept last. An empty table gives zeros: everything is allowed.

    URLs are counted as shares of their n-grams, so that long paths weigh no more than short ones; the classes weigh as
    ``share``, whatever their numbers.
    """
    if not labelled:
        return [0.0] * (BUCKETS + 1)
    grams = [_grams(*split_url(url)) for url, _ in labelled]
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    bucket = np.concatenate([np.array(g) for g in grams])
    part = 1.0 / np.bincount(row)[row]
    label = np.array([y for _, y in labelled], "f8")
    n = np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())])
    weight = np.where(label == 1, share / n[1], (1 - share) / n[0])
    weights, intercept = np.zeros(BUCKETS), math.log(share / (1 - share))
    for _ in range(steps):
        z = intercept + np.bincount(row, weights[bucket] * part, len(grams))
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))) - label) * weight
        step = decay * weights + 50.0 * np.bincount(bucket, error[row] * part, BUCKETS)
        weights, intercept = weights - rate * step, intercept - rate * (decay * intercept + error.sum())
    return [round(float(w), 6) for w in weights] + [round(float(intercept), 6)]


def trained(labelled: DataFrame) -> list[float]:
    """Weights fitted on a table (url, label: 1 to block, 0 to allow); of a larger one, on MAX_LABELLED rows by a hash."""
    known = labelled.where(F.col("label").isin(0, 1)).select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("int").alias("label"))
    rows = known.orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED).collect()
    return fit(sorted((r.url, r.label) for r in rows))


@functools.cache
def default_weights() -> tuple[float, ...]:
    return tuple(fit(labelled_urls()))


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = f"instr(`{url}`, '://')"
    rest = f"case when {at} > 0 then substring(`{url}`, {at} + 3) else '' end"
    return (
        pages.withColumn("__rest", F.coalesce(F.expr(rest), F.lit("")))
        .withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
        .withColumn("host", F.translate("__host", _UPPER, _LOWER))
        .withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0))
        .drop("__rest", "__host")
    )


def _text(value: str) -> Column:
    return F.lit(value)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The rule that fits best (longest first, then the longest host), and its action; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in reversed(ordered):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == _text(host)) | F.col("host").endswith(_text("." + host))) & F.col("path").startswith(_text(slash + path))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def log_odds(weights) -> Column:
    """Log odds that a URL is to be blocked."""
    array = "array(" + ",".join(f"{w!r}D" if w else "0D" for w in weights[:-1]) + ")"
    mark = lambda kind, col: f"concat('{kind}^', {col}, '$')"
    grams = lambda kind, col: f"transform(sequence(1, greatest(length({mark(kind, col)}) - {GRAM}, 0) + 1), i -> concat('{kind}', substring({mark(kind, col)}, i, {GRAM})))"
    every = f"concat({grams('h', 'host')}, {grams('p', 'path')})"
    bucket = f"cast(conv(substring(md5(g), 1, 6), 16, 10) as int) % {BUCKETS}"
    mean = f"aggregate({every}, named_struct('s', 0D, 'n', 0), (a, g) -> named_struct('s', a.s + get(__w, {bucket}), 'n', a.n + 1), a -> a.s / a.n)"
    return F.expr(mean.replace("__w", array)) + F.lit(float(weights[-1]))


def judged(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (allow or block); columns of these names are replaced.

    labelled: (url, label) that the model is fitted on; by default ``labelled_urls``.
    """
    rule, action = rule_columns(rules)
    odds = log_odds(default_weights() if labelled is None else trained(labelled))
    model = F.when(odds > 0, F.lit("block")).otherwise(F.lit("allow"))
    return with_host_and_path(pages, url).withColumn("rule", rule).withColumn("verdict", F.coalesce(action, model))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    act = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in ordered) + " END"
    weights = default_weights()
    used = ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(weights[:-1]) if w)
    grams = lambda kind, col: f"SELECT url, '{kind}' || substr('{kind}^' || {col} || '$', i, {GRAM}) AS g FROM u, unnest(range(1, greatest(length({col}) + 3 - {GRAM}, 0) + 2)) AS t(i)"
    return f"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
v AS (SELECT page_id, url, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
u AS (SELECT DISTINCT host, path, host || ' ' || path AS url FROM v),
g AS ({grams('h', 'host')} UNION ALL {grams('p', 'path')}),
w(b, w) AS (VALUES {used}),
s AS (SELECT url, sum(coalesce(w, 0)) / count(*) + ({weights[-1]!r}) AS odds
  FROM g LEFT JOIN w ON b = CAST('0x' || substr(md5(g), 1, 6) AS BIGINT) % {BUCKETS} GROUP BY url),
r AS (SELECT page_id, v.host, v.path, {rule} AS rule, odds FROM v JOIN s ON s.url = v.host || ' ' || v.path)
SELECT page_id, host, path, rule, coalesce({act}, CASE WHEN odds > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
