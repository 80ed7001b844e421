"""Quality rules, quality classifier, URL filter and chat formatting against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat, quality_classifier, quality_rules, url_filter
from rankloom.llm.common import written

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 400, "l1 w\nl1 w\n\nl2\nl1 w", "é ß # * <b> |", "a b c d e f g h i j " * 3 + "tail words here", "w" * 5000]


def more_counts_of(text):
    words = WORD.findall(text or "")
    plain = re.compile(r"[^\W\d_]+[.,;:]?")
    return (sum(w in quality_rules.COMMON_WORDS for w in words), len(set(words)), sum(bool(plain.fullmatch(w)) for w in words), sum(w.endswith(".") for w in words))


def test_rule_counts_match_brute_force(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate([*TEXTS, "the der. le,, of; a.b c.. . x:y don't", ". .", "the\nof\tand"])] + [(3, "one", "clash", "x"), (None, "two words", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines_ string, n_words string")
    got = quality_rules.counted(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(r.text)
        assert (r.n_common, r.n_distinct, r.n_plain, r.n_ends) == more_counts_of(r.text)


def prose(n):
    """Texts of varied words, some of them common, in sentences."""
    common = ("the", "of", "and", "to")
    sentence = lambda i, j: " ".join(common[k % 4] if k % 5 == 2 else f"word{'abcdefghij'[(i * 31 + j * 7 + k * 3) % 10]}{'klmnopqrst'[(i * 7 + j + k) % 10]}{'uvwxyz'[(i + j * k) % 6]}" for k in range(12)) + "."
    return ["\n".join(sentence(i, j) for j in range(10)) for i in range(n)]


def test_rules_keep_prose_and_drop_junk(spark):
    good = prose(40)
    junk = [" ".join(f"#w{i}*{j}$" for j in range(60)) for i in range(6)] + ["BUY NOW!! " + " ".join(f"CLICK{j}!!" for j in range(50 + i)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    votes = written(quality_rules.voted(quality_rules.counted(docs)), "votes")
    kept = {r.doc_id for r in quality_rules.judged(votes, quality_rules.estimated(quality_rules.pattern_counts(votes))).where("kept").collect()}
    assert kept == set(range(len(good)))


def test_posterior_differs_from_all_must_pass_and_is_right(spark):
    """Clean texts without any common word have one bad vote and stay; junk with many goes; no label is used."""
    good = prose(60)
    odd = [re.sub(r"\b(the|of|and|to)\b", "zebra", t) for t in prose(5)]
    junk = ["\n".join(" ".join(f"{w}{m}" for w, m in zip(line.split(), "#$%&*" * 3, strict=False)) for line in t.split("\n")) for t in prose(12)]
    docs = spark.createDataFrame(list(enumerate(good + odd + junk)), "doc_id long, text string")
    votes = written(quality_rules.voted(quality_rules.counted(docs)), "votes")
    rows = quality_rules.judged(votes, quality_rules.estimated(quality_rules.pattern_counts(votes))).collect()
    n = len(quality_rules.RULES)
    passes_all = {r.doc_id for r in rows if 0 not in quality_rules._digits(r.votes, n)}
    assert {r.doc_id for r in rows if r.kept} == set(range(len(good) + len(odd)))
    assert passes_all == set(range(len(good)))


@pytest.mark.parametrize("copies", [False, True])
def test_estimation_finds_planted_shares(copies):
    """Six independent rules: shares of bad votes and of good documents are found. With three of them copies of one rule
    (a group), which is more than the weights make up for, verdicts are still better than all-must-pass."""
    rng = random.Random(5)
    groups, on_bad, on_good = (["a", "a", "a", "b", "c", "d"] if copies else list("abcdef")), (0.7, 0.7, 0.7, 0.8, 0.6, 0.75), (0.02, 0.02, 0.02, 0.05, 0.03, 0.1)
    patterns, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        digits = [0 if rng.random() < r else 2 for r in (on_good if good else on_bad)]
        if copies:
            digits[1] = digits[2] = digits[0]
        if rng.random() < 0.3:
            digits[4] = 1
        key = sum(d * 3**i for i, d in enumerate(digits))
        patterns[key] = patterns.get(key, 0) + 1
        truth.setdefault(key, []).append(good)
    model = quality_rules.estimated(patterns, groups)
    if not copies:
        assert model.share == pytest.approx(0.8, abs=0.02)
        for found, planted in ((model.on_bad, on_bad), (model.on_good, on_good)):
            assert all(a == pytest.approx(b, abs=0.03) for a, b in zip(found, planted, strict=True))
    wrong = sum(sum(g != (model.posterior(quality_rules._digits(k, 6)) >= 0.5) for g in v) for k, v in truth.items())
    must_pass = sum(sum(g != (0 not in quality_rules._digits(k, 6)) for g in v) for k, v in truth.items())
    assert wrong < (0.6 if copies else 0.2) * must_pass


def test_posterior_column_is_the_formula(spark):
    n = len(quality_rules.RULES)
    model = quality_rules.Model(0.9, tuple(1 / (1 + i) for i in range(n)), tuple(0.3 + i / 50 for i in range(n)), tuple(0.01 + i / 100 for i in range(n)))
    patterns = [0, 1, 5, 3**n - 1, 1093]
    votes = spark.createDataFrame([(v, False) for v in patterns], "votes int, base_failed boolean")
    for r in quality_rules.judged(votes, model).collect():
        assert r.posterior == pytest.approx(model.posterior(quality_rules._digits(r.votes, n)))


def test_rules_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    votes = written(quality_rules.voted(quality_rules.counted(docs)), "votes")
    assert quality_rules.judged(votes, quality_rules.estimated(quality_rules.pattern_counts(votes))).count() == 0


def test_classifier_separates_held_out(spark):
    good = [" ".join(f"{a}{b}" for a in ("gentle", "river", "quiet", "stone")[i % 4 :] for b in ("s", "ing", "ed", f"x{i}")) + "." for i in range(200)]
    bad = [" ".join(f"###{i % 7}$$$ ***BUY{j}***" for j in range(12)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality_classifier.trained(docs, labels)
    got = quality_classifier.scored(docs, model).withColumn("held", quality_classifier.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held and r.doc_id < 400]
    assert len(held) > 50
    assert sum(r.predicted == int(r.doc_id < 200) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.doc_id >= 900]
    assert empty[0] == empty[1]


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.scored(docs, quality_classifier.trained(docs, labels)).first().score == 0.5


def test_classifier_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.trained(docs, labels) == quality_classifier.trained(docs, flipped)


def test_op5_against_brute_force(spark):
    """Scores by plain use of the two dictionaries, labels of held-out rows unseen, and their accuracy."""
    import math
    import zlib

    import zstandard

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    seen = labels.collect()
    model = quality_classifier.trained(docs, spark.createDataFrame([r for r in seen if not held(r.doc_id)], labels.schema))
    tools = [zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r for r in quality_classifier.op5_quality_classifier(spark, folder).collect()}
    assert set(got) == set(texts)
    for d, data in texts.items():
        good, bad = (sum(len(t.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)) for t in tools)
        z = model.slope * ((bad - good) / len(data) if data else 0.0) + model.intercept
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert (got[d].held_out, got[d].predicted) == (held(d), int(got[d].score >= 0.7))
    judged = [(r.quality, got[r.doc_id].predicted) for r in seen if held(r.doc_id)]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9  # of 300 labelled rows


def test_classifier_with_repeated_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5, "x") for i in range(60)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.trained(docs, labels)
    got = quality_classifier.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 60 and all(0 <= r.score <= 1 for r in got.collect())
    assert quality_classifier.scored(docs.where("false"), model).count() == 0


URLS = [
    ("http://a.example.org/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.ORG/en/12?x", "example.org/en/1", "block"),
    ("http://example.org/fr/", "org/", "allow"),
    ("http://notexample.org/es/", "org/", "allow"),
    ("http://x.com/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/1", "com/de/", "block"),
    ("http://org", None, None),
    ("http://x.com/DE/1", None, None),
    ("no scheme", None, None),
    (None, None, None),
    ("http://h?q=http://a.org/", None, None),
    ("://", None, None),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, rule_ string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    for i, (url, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path) == url_filter.split_url(url)
        assert got[i].rule == rule
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_model_matches_its_formula(spark):
    weights = url_filter.default_weights()
    urls = [u for u, _ in url_filter.labelled_urls()[::9]] + [u for u, _, _ in URLS]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in url_filter.with_host_and_path(pages).withColumn("odds", url_filter.log_odds(weights)).collect():
        grams = url_filter._grams(*url_filter.split_url(r.url))
        assert r.odds == pytest.approx(sum(weights[g] for g in grams) / len(grams) + weights[-1], abs=1e-9)
    assert url_filter.fit([]) == [0.0] * (url_filter.BUCKETS + 1)


#: Well-known sites, and invented ones of the kinds to block; neither list is made from the labelled table.
KNOWN_SITES = (
    "bbc.co.uk elpais.com mit.edu tagesschau.de lemonde.fr en.wikipedia.org github.com nytimes.com stackoverflow.com python.org nasa.gov who.int harvard.edu spiegel.de lefigaro.fr "
    "elmundo.es guardian.co.uk weather.com imdb.com gutenberg.org arxiv.org apache.org debian.org nature.com sciencedirect.com allrecipes.com tripadvisor.com zeit.de sueddeutsche.de "
    "ouest-france.fr lavanguardia.com ox.ac.uk un.org europa.eu archive.org mozilla.org kernel.org reuters.com aljazeera.com nps.gov"
).split()
SITES_TO_BLOCK = (
    "online-casino777.com bestpokerbonus.net cheap-viagra-shop.biz freepornvideos.xxx hot-adult-cams.com torrentcracks.org warezkeygens.net adtracker-banner.com jackpotslots-win.com "
    "payday-loans-now.com replicawatches-sale.com lottery-winner.info livebetting24.com pharmacy-pills.top malware-popup.xyz spamlinkfarm.net escortsnearyou.com forexscam.biz "
    "sportsbets.bet casino-royal-slots.com"
).split()


def blocked_urls(spark, urls, **more):
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url for r in url_filter.judged(table, rules=(), **more).where("verdict = 'block'").collect()}


def test_url_model_on_sites_that_it_does_not_know(spark):
    site = lambda own: {f"https://{h}/" for h in own}
    blocked = blocked_urls(spark, site(KNOWN_SITES) | site(SITES_TO_BLOCK))
    caught, wrong = blocked & site(SITES_TO_BLOCK), blocked & site(KNOWN_SITES)
    assert len(caught) / len(blocked) >= 0.95 and len(caught) / len(SITES_TO_BLOCK) >= 0.9 and len(wrong) <= 1


def test_url_model_on_words_that_it_does_not_know(spark):
    """Fitted on every other word, it blocks next to none of the other words' URLs to allow; it can't know those to block."""
    label = dict(url_filter.labelled_urls(1))
    table = spark.createDataFrame(url_filter.labelled_urls(0), "url string, label int")
    blocked = blocked_urls(spark, label, labelled=table)
    allowed = [u for u, y in label.items() if y == 0]
    assert len(blocked.intersection(allowed)) / len(allowed) < 0.05


def test_url_model_leaves_plain_pages_alone(spark):
    """The given pages, of which no word list here was made."""
    marks = "bets|pills|ads|spam|adult|casino"
    urls = [r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").where(f"url is not null and not url rlike '{marks}'").collect()]
    assert len(blocked_urls(spark, urls)) / len(urls) < 0.02


def test_url_model_of_a_given_table(spark):
    table = spark.createDataFrame([(f"http://red{i}.example.com/{i}", 1) for i in range(30)] + [(f"http://blue{i}.example.com/{i}", 0) for i in range(30)] + [(None, 0), ("x", None), ("y", 7)], "url string, label int")
    pages = spark.createDataFrame([("http://red99.example.net/5", "h", "r"), ("http://blue99.example.net/5", "h", "r")] * 2, "url string, host string, rule string")
    got = [(r.host, r.rule, r.verdict) for r in url_filter.judged(pages, labelled=table, rules=()).collect()]
    assert got == [("red99.example.net", None, "block"), ("blue99.example.net", None, "allow")] * 2
    assert url_filter.judged(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, labelled=table.where("false"), rules=()).collect()} == {"allow"}


NASTY = ["", "plain", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "a<|b<\\|c\n<|im_end|>\n", "ends with <", "\n\n", "$1 \\1 \\"]


def test_chat_round_trip(spark):
    turns = [(c, t, role, text) for c, role in enumerate(("user", "assistant", "we\nird<|nl|>\\", "")) for t, text in enumerate(NASTY)]
    rows = spark.createDataFrame(turns + [(9, None, None, None), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    done = chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of_turn_rows(rows), "record"))).collect()
    assert len(done) == 6
    for r in done:
        said = sorted([(t or 0, role or "", text or "") for c, t, role, text in turns + [(9, 0, "", ""), (None, 0, "assistant", "x")] if c == r.conv_id])
        assert [(x.role, x.text) for x in r.read_turns] == [(b, c) for _, b, c in said]
        assert r.loss_text == "".join(c for _, b, c in said if b == "assistant")
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)


def test_chat_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}', "messages", ["q", "a"]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "conversations", ["q", "a"]),
        ('{"instruction": "q", "input": "i", "output": "a"}', "instruction_input", ["q\n\ni", "a"]),
        ('{"instruction": "q", "output": "a"}', "instruction", ["q", "a"]),
        ('{"prompt": "q", "completion": "a"}', "prompt_completion", ["q", "a"]),
        ('{"system": "s", "prompt": "q", "response": "a"}', "system_prompt_response", ["s", "q", "a"]),
        ('{"question": "q", "answer": "a"}', "question_answer", ["q", "a"]),
        ('{"unknown": 1}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "id long, payload string")
    got = {r.id: r for r in chat.formatted(chat.canonical_turns(rows, "payload")).collect()}
    for i, (_, layout, texts) in enumerate(records):
        assert got[i].layout == layout
        assert (got[i].turns and [t.text for t in got[i].turns]) == texts
        assert (got[i].formatted is None) == (texts is None)


def test_chat_of_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of_turn_rows(rows), "record"))).count() == 0
    clash = spark.createDataFrame([('{"prompt": "q", "completion": "a"}', "l", "t", "f", "m")], "payload string, layout string, turns string, formatted string, loss_mask string")
    row = chat.read_back(chat.formatted(chat.canonical_turns(clash, "payload"))).first()
    assert row.layout == "prompt_completion" and row.loss_text == "a" and [t.text for t in row.read_turns] == ["q", "a"]


def test_digest_of_extra_conversation(spark):
    expected = hashlib.sha256(f"user\n{chat.EXTRA}\nassistant\n{chat.EXTRA}\n".encode()).hexdigest()
    row = chat.op8_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.turns_sha256, row.loss_chars) == (2, expected, len(chat.EXTRA))
