"""Toxicity, quality rules, URL filter and language model: brute force, held-out accuracy, edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metercast.llm import elias_fano, ngram_lm, quality_rules, toxicity, url_filter

from ..conftest import SF_SMALL
from .conftest import SENTENCE, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- toxicity -------------------------------------------------------------------------
def toxic_corpus():
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeioustnr"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choice(plain, rng.integers(5, 80)).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words) + 1)), "zgorq" + str(rng.choice(["al", "im", "ust", "", "er"])))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark, make_docs, messy_rows):
    rows, labels = toxic_corpus()
    # forms that no training text has
    rows += [(5000 + k, f"sun rain {w} store tea {w}") for k, w in enumerate(["zgorqent", "Zgorqis", "ZGORQON!"])]
    rows += [(6000 + k, t) for k, (_, t) in enumerate(messy_rows)] + [(None, None)]
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (77777, 1)], "doc_id long, toxic int")
    docs = make_docs(rows)
    model = toxicity.train_toxicity(docs, lab, toxicity.fold(F.col("doc_id")) != 1)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    truth = dict(labels)
    right = sum(got[i].predicted == truth[i] for i in held)
    assert len(held) > 200 and right / len(held) > 0.97
    assert all(got[5000 + k].predicted == 1 for k in range(3))
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = {r.score for i, r in got.items() if i is None or (i >= 6000 and not WORD.findall(dict(rows)[i] or ""))}
    assert len(empty) == 1 and empty.pop() < 0.7
    assert toxicity.score_toxicity(make_docs([]), model).count() == 0


def test_toxicity_without_labels(spark, make_docs):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity(make_docs([(1, SENTENCE)]), lab, F.lit(True))
    assert [r.predicted for r in toxicity.score_toxicity(make_docs([(1, SENTENCE), (2, None)]), model).collect()] == [0, 0]


def test_kneser_ney_ratios_are_of_proper_distributions():
    """Each class's probabilities over all next bytes sum to one for a seen context (checked through the ratio's parts)."""
    words = [b"abab", b"abba", b"baab", b"bbbb"]
    gram, word = toxicity.sequences(words, 3)
    keys = np.unique(gram)
    counts = [np.array([np.sum(gram == k) for k in keys], float), np.array([np.sum(gram[word < 2] == k) for k in keys], float)]
    r = toxicity.kneser_ney_ratios(keys, counts, 3)
    assert np.isfinite(r.grams[1]).all() and np.isfinite(r.contexts[1]).all()
    # equal counts in both classes: no evidence
    same = toxicity.kneser_ney_ratios(keys, [counts[0], counts[0]], 3)
    assert np.allclose(same.grams[1], 0) and np.allclose(same.of_words([b"abab", b"zzz"]), 0)


# -- quality ----------------------------------------------------------------------------
def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_quality_counts_and_base_rules(spark, make_docs, messy_rows):
    rows = messy_rows + [(400, (SENTENCE + "\n") * 3 + "unrelated closing words"), (401, "x " * 15), (402, "a b c d e f g h " * 3),
                         (403, "# $ % | <b> &amp; *"), (404, SENTENCE + " " + SENTENCE), (405, "p q r s t u v w x p q r s t u v w x")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge_quality(make_docs(rows), labels)
    want = sorted([(i, *brute_counts(t)) for i, t in rows], key=str)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == want
    for r in rows_of(got):
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no labels, no rules
    assert quality_rules.judge_quality(make_docs([]), labels).count() == 0


def test_quality_rules_are_learned_and_ordered(spark, make_docs):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60)]
        kind = i % 6
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 1)))
    lab = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    got = quality_rules.judge_quality(make_docs(rows), lab)
    assert {r.doc_id: int(r.kept) for r in got.collect()} == dict(labels)


def test_rules_expression_equals_the_rules_in_order(spark):
    rules = [(quality_rules.Condition("a", True, 0.5), quality_rules.Condition("b", False, 0.2)),
             (quality_rules.Condition("b", True, 0.9),)]
    x = np.random.default_rng(1).random((500, 2))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [r[0] for r in frame.select(quality_rules.rules_expression(rules)).collect()]
    want = ~((x[:, 0] >= 0.5) & (x[:, 1] < 0.2)) & ~(x[:, 1] >= 0.9)
    assert got == want.tolist()
    assert quality_rules.learn_rules(np.zeros((50, 1)), np.zeros(50, bool), ["a"]) == []
    assert quality_rules.learn_rules(np.zeros((50, 1)), np.arange(50) % 2 == 0, ["a"]) == []  # nothing to tell them apart


# -- URLs ---------------------------------------------------------------------------------
URLS = [("http://a.example.com/de/1?x=1", "a.example.com", "/de/1", "example.com/de/", "block"),
        ("https://WWW.Example.NET/en/x#t", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/en", "example.net", "/en", "net/", "block"), ("ftp://x.net", "x.net", "", None, None),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, None), ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://b.org/FR/", "b.org", "/FR/", None, None), ("no scheme/path", "", "", None, None), ("", "", "", None, None),
        (None, "", "", None, None), ("x://h?q=://y/z", "h", "", None, None), ("a://b://net/", "b:", "//net/", None, None),
        ("http://ÄB.net/ä", "Äb.net", "/ä", "net/", "block"), ("http://net/a\nb?c", "net", "/a\nb", "net/", "block"),
        ("://", "", "", None, None), ("http://" + "y" * 5000 + ".org/fr/" + "z/" * 3000, "y" * 5000 + ".org",
                                       "/fr/" + "z/" * 3000, "org/fr/", "allow")]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u[0], "block") for k, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[k][0][:60]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    empty = pages.where("false")
    assert url_filter.judge_urls(empty).count() == 0


def test_url_trees_equal_their_expression_and_learn(spark):
    rng = np.random.default_rng(0)
    urls = [f"http://h{i % 7}.{'com' if i % 2 else 'org'}/" + "a/" * int(rng.integers(0, 6)) + str(int(rng.integers(0, 10**int(rng.integers(1, 9)))))
            for i in range(800)]
    label = [int(sum(c.isdigit() for c in u) / len(u) > 0.2) for u in urls]
    frame = spark.createDataFrame(list(zip(urls, label)), "url string, label int")
    model = url_filter.train_url_model(frame)
    judged = url_filter.judge_urls(frame.selectExpr("monotonically_increasing_id() AS page_id", "url", "label AS rule"), rules=[], model=model)
    verdicts = {r.page_id: r.verdict for r in judged.collect()}
    truth = [r.label for r in frame.collect()]
    ids = [r.page_id for r in frame.selectExpr("monotonically_increasing_id() AS page_id").collect()]
    right = np.mean([(verdicts[i] == "block") == bool(t) for i, t in zip(ids, truth)])
    assert right > 0.97
    bins, n, pos = rng.integers(0, 3, (60, len(url_filter.FEATURES))), np.ones(60), (rng.random(60) < 0.5).astype(float)
    base, trees = url_filter.boost(bins, n, pos, 5, 2)
    assert len(trees) == 5 and np.isfinite(base)


def test_url_features(spark):
    url = "http://ab.cd.org/x1/y2?p=1&q=22#f"
    frame = spark.createDataFrame([(url,), ("",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = frame.select(*[c.alias(k) for k, c in url_filter.lexical(F.col("url"), host, path).items()]).collect()
    c = Counter(url)
    entropy = -sum(v / len(url) * math.log2(v / len(url)) for v in c.values())
    assert rows[0].url_length == len(url) and rows[0].path_depth == 2 and rows[0].n_params == 2 and rows[0].host_labels == 3
    assert math.isclose(rows[0].digit_ratio, 5 / len(url)) and math.isclose(rows[0].entropy, entropy)
    assert rows[0].host_suffix == "org" and set(rows[1].asDict().values()) == {0.0, ""}


# -- language model ---------------------------------------------------------------------------
@pytest.mark.parametrize("n,universe", [(0, 5), (1, 1), (5, 5), (10, 1000), (1000, 1500), (900, 10**6), (500, 2**44)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n))
    ef = elias_fano.EliasFano.build(v, universe)
    assert ef.values().tolist() == v.tolist()
    ask = np.concatenate([v, np.minimum(v + 1, universe - 1), rng.integers(0, universe, 300)])
    place = {x: i for i, x in enumerate(v.tolist())}
    assert ef.find(ask).tolist() == [place.get(x, -1) for x in ask.tolist()]


def brute_lm(train, order):
    counts = [None] + [Counter() for _ in range(order)]
    for w in train:
        x = [*w, "</s>"]
        counts[1].update(x)
        y = ["<s>", *x]
        for n in range(2, order + 1):
            counts[n].update(tuple(y[k:k + n]) for k in range(len(y) - n + 1))
    total, words = sum(counts[1].values()), len(counts[1])
    discount, sums = {}, {}
    for n in range(2, order + 1):
        of = Counter(counts[n].values())
        discount[n] = [0, *ngram_lm.modified_discounts(np.array([of[k] for k in (1, 2, 3, 4)], float))]
        sums[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts[n].items():
            s = sums[n][g[:-1]]
            s[0] += c
            s[min(c, 3)] += 1

    def p(context, w):
        n = len(context) + 1
        if n == 1:
            return (counts[1][w] + 0.5) / (total + 0.5 * (words + 1))
        lower, s = p(context[1:], w), sums[n].get(context)
        if not s:
            return lower
        left = sum(discount[n][k] * s[k] for k in (1, 2, 3)) / s[0]
        c = counts[n].get((*context, w), 0)
        return (c - discount[n][min(c, 3)]) / s[0] + left * lower if c else left * lower
    return p, counts, total


@pytest.mark.parametrize("order,part_tokens", [(1, 1000), (2, 1 << 21), (2, 40), (3, 60), (4, 500)])
def test_language_model_equals_brute_force(make_docs, messy_rows, order, part_tokens):
    rng = np.random.default_rng(order)
    rows = [r for r in messy_rows if r[0] not in (11, 12)]
    rows += [(5000 + k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 300)) for k in range(120)]
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    train = [(i, t) for i, t in rows if i is None or i % 4]
    model = ngram_lm.train_model(make_docs(train, 4), order=order, part_tokens=part_tokens)
    got = ngram_lm.score_texts(make_docs(rows), model).collect()
    p, counts, total = brute_lm([low(t) for _, t in train], order)
    text = dict(rows)
    text[2] = SENTENCE
    assert len(got) == len(rows)
    for r in got:
        x = ["<s>", *low(text[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x) - 1, sum(counts[1][w] > 0 for w in x[1:]), total)
        assert math.isclose(r.base_score, sum(math.log10(p((), w)) for w in x[1:]), rel_tol=1e-9)
        want = sum(math.log10(p(tuple(x[max(0, k - order + 1):k]), x[k])) for k in range(1, len(x)))
        assert abs(r.score - want) < 0.0005 * (order + 1) * r.n_tokens  # 16-bit steps


def test_language_model_of_nothing(make_docs):
    model = ngram_lm.train_model(make_docs([]))
    got = ngram_lm.score_texts(make_docs([(1, "a b"), (2, None)]), model).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert ngram_lm.score_texts(make_docs([]), model).count() == 0


def test_registered_scores_beat_the_unigrams_on_held_out_texts(spark):
    from metercast.llm.queries import QUERIES
    rows = [r for r in QUERIES["op7_lm_scoring"](spark, SF_SMALL).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_default_model_counts_and_uses_trigrams(make_docs):
    train = [(k, "a b c") for k in range(30)] + [(100 + k, "x b d") for k in range(30)]
    model = ngram_lm.train_model(make_docs(train))
    assert model.order >= 3 and len(model.levels) == model.order and model.levels[2].n > 0
    score = {r.doc_id: r.score for r in ngram_lm.score_texts(make_docs([(1, "a b c"), (2, "a b d")]), model).collect()}
    assert score[1] > score[2] + 0.5  # "b c" and "b d" are equally frequent: only the word before tells


def test_of_equally_long_rules_the_first_listed_wins(spark):
    from pyspark.sql import functions as F

    from metercast.llm.url_filter import rule_columns
    df = spark.createDataFrame([("a.com.x", "/"), ("b.a.com.x", "/yz")], "host string, path string")
    rules = [("a.com.x", "/", "block"), ("com.x", "/yz", "allow"), ("com.x", "/", "allow")]
    for order, want in ((rules, ["block", "block"]), ([rules[1], rules[0], rules[2]], ["block", "allow"]),
                        ([("com.x", "/yz", "allow"), ("a.com.x", "", "block")], ["block", "allow"]),
                        ([("a.com.x", "", "block"), ("com.x", "/y", "allow")], ["block", "block"]),
                        ([("com.x", "/y", "allow"), ("a.com.x", "", "block")], ["block", "allow"])):
        text, verdict = rule_columns(F.col("host"), F.col("path"), order)
        assert [r[0] for r in df.select(verdict).collect()] == want, order


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\u00a0\u2003AaZÉé😀,"), max_size=30), max_size=8))
def test_words_of_texts(texts):
    texts = [t.encode() for t in texts]
    words, which, sizes = ngram_lm.split_words(texts)
    want = [t.lower().split() for t in texts]
    assert [words[k] for k in which] == sum(want, []) and len(set(words)) == len(words)
    assert sizes.tolist() == [len(x) for x in want]


def test_a_repeated_word_is_looked_up_once():
    class Counted(ngram_lm._Numbers):
        looked_up = 0

        def __getitem__(self, word):
            Counted.looked_up += 1
            return super().__getitem__(word)
    worker = ngram_lm.Worker(ngram_lm.NgramModel(3))
    worker.index = Counted()
    ids, counts, sizes = worker.tokens([b"the the THE a " * 500, b"", b" a"])
    assert sizes.tolist() == [2001, 1, 2] and (ids == -1).all() and not counts.any()
    assert Counted.looked_up == 3  # the, a and the end


def test_elias_fano_reads_little(monkeypatch):
    """Values of one bucket share its pointers, and a value alone in its bucket is compared once."""
    selected, read = [], []
    select, low = elias_fano._select, elias_fano.EliasFano._low
    monkeypatch.setattr(elias_fano, "_select", lambda word, k: selected.append(len(k)) or select(word, k))
    monkeypatch.setattr(elias_fano.EliasFano, "_low", lambda self, i: read.append(len(i)) or low(self, i))
    hot = np.concatenate([np.arange(4000) * 3, 10**7 + np.arange(40) * 100_000])  # two full buckets, then sparse ones
    ef = elias_fano.EliasFano.build(hot, 2 * 10**7)
    assert ef.find(hot[:4000]).tolist() == list(range(4000)) and ef.find(hot[:4000] + 1).max() == -1
    assert sum(selected) <= 4 * len(np.unique(hot[:4000] >> ef.width))  # before: one for each value
    read.clear()
    assert ef.find(hot[4000:]).tolist() == list(range(4000, 4040))
    assert sum(read) == 40  # before: 80


@settings(max_examples=100, deadline=None)
@given(values=st.sets(st.one_of(st.integers(0, 300), st.integers(0, 2**40)), max_size=200),
       ask=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**40)), max_size=200))
def test_elias_fano_finds_in_any_order(values, ask):
    v = np.array(sorted(values), np.int64)
    ef = elias_fano.EliasFano.build(v, 2**40 + 1)
    place = {x: i for i, x in enumerate(v.tolist())}
    for some in (ask, sorted(ask), sorted(values)[::-1], sorted(values) * 2):
        assert ef.find(np.array(some, np.int64)).tolist() == [place.get(x, -1) for x in some]


@pytest.mark.parametrize("bits,top", [(10, 1 << 40), (30, 1 << 40)])  # the second one's pairs are no 64-bit numbers
def test_pairs_are_counted_and_told_apart(bits, top):
    rng = np.random.default_rng(bits)
    context = np.concatenate([rng.integers(0, 4, 300), top + rng.integers(0, 4, 300)])
    word = rng.integers(0, 5, 600)
    pairs = list(zip(context.tolist(), word.tolist()))
    c, w, n = ngram_lm._counted(context, word, bits)
    assert list(zip(zip(c.tolist(), w.tolist()), n.tolist())) == sorted(Counter(pairs).items())
    c, w, which = ngram_lm.NgramModel(3, bits=bits)._distinct(context, word)
    assert [(int(c[k]), int(w[k])) for k in which] == pairs
    assert list(zip(c.tolist(), w.tolist())) == sorted(zip(c.tolist(), w.tolist()))


def test_numbers_of_words():
    index = ngram_lm._Numbers()
    number, new = index.numbers([b"b", b"a", b" "])
    assert number.tolist() == [0, 1, 2] and new == [b"b", b"a", b" "]
    number, new = index.numbers([b"c", b"a", b"d", b" "])
    assert number.tolist() == [3, 1, 4, 2] and new == [b"c", b"d"] and list(index) == [b"b", b"a", b" ", b"c", b"d"]
