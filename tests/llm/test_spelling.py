"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from metercast.llm import queries, spelling
from metercast.llm.common import work_dir, written

from ..conftest import SF_SMALL
from .test_dedup import lower


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def brute_near(words):
    """Near words by deletion neighbourhoods, each pair checked."""
    groups = {}
    for w in words:
        for k in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))} | {(w[:k], w[k + 1:]) for k in range(len(w))}:
            groups.setdefault(k, set()).add(w)
    near = {w: set() for w in words}
    for g in groups.values():
        for a in g:
            near[a] |= {b for b in g if a != b and one_edit(a, b)}
    return near


def brute(rows):
    n = brute_counts(rows)
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(rng, words, n):
    letters = list("abcdeé÷ÿ")
    out = []
    for w in rng.choice(words, n):
        k = int(rng.integers(0, len(w)))
        kind = rng.integers(0, 3)
        out.append(w[:k] + w[k + 1:] if kind == 0 else w[:k] + str(rng.choice(letters)) + w[k + int(kind == 1):])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make_docs, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aabcdeé"), int(rng.integers(4, 9)))) for _ in range(120)]
    words += ["aaaaa" + "a" * k for k in range(6)] + ["Straße" * 30, "straße" * 30 + "x", "ÀÀÀÀÀ", "àÀÀÀÀ", "x" * 4000, "x" * 3999]
    for _ in range(3):
        words += variants(rng, words, 100)
    rows = [(k, " ".join(rng.choice(words, 60)) + "," + "-".join(rng.choice(words, 3)).upper()) for k in range(250)]
    rows += [(7, rows[0][1]), (None, "hello hello hello hallo hallo hallo"), (900, None), (901, ""), (902, "1234 ,,"), (903, "abcde5abcdf_abcde")]
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and max(len(r[0]) for r in want) > 3000
    assert result(spelling.spelling_variants(make_docs(rows))) == want


def test_every_edit_of_short_and_long_words(spark):
    """All one-edit pairs around a word, at every place, forwards and backwards."""
    base = ["abcab", "aaaaa", "zabzabzab", "q" * 40 + "r" + "q" * 40]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + w[k + 1:], w[:k] + "q" + w[k:], w[:k] + "é" + w[k + 1:]}
    words = sorted(w for w in words if len(w) >= 5)
    df = spark.createDataFrame(list(enumerate(words)), "wid long, word string").selectExpr("wid", "word", "wid + 3 as n")
    folder = work_dir(spark)
    got = spelling.near_words(written(df, "words", folder), folder).collect()
    assert Counter((r.word, r.near) for r in got) == Counter((w, v) for w, s in brute_near(words).items() for v in s)
    assert all(words[r.n - 3] == r.word and words[r.near_n - 3] == r.near for r in got)


def test_equal_hashes_of_different_prefixes_do_no_harm(spark):
    """Nodes that share a hash add states, which the last comparison removes."""
    words = ["abcde", "abcdx", "abcd", "zbcde", "qqqqq", "qqqqqq", "rstuv", "rstxv"]
    words = [w for w in words if len(w) >= 5]
    df = spark.createDataFrame(list(enumerate(words)), "wid long, word string").selectExpr("wid", "word", "3L as n")
    folder = work_dir(spark)
    got = spelling.near_words(written(df, "words", folder), folder, modulus=7).collect()
    assert Counter((r.word, r.near) for r in got) == Counter((w, v) for w, s in brute_near(words).items() for v in s)


def test_messy_and_empty_tables(make_docs, messy_rows):
    rows = messy_rows * 3
    assert result(spelling.spelling_variants(make_docs(rows))) == brute(rows)
    assert spelling.spelling_variants(make_docs([])).count() == 0


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op13_spelling_variants"](spark, SF_SMALL)) == brute(rows)
