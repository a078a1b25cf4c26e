"""Learned quality rules: a decision list over text statistics.

Sequential covering on labelled statistics grows conjunctions of thresholds
on two thirds of a bounded sample and prunes them on the rest; the accepted
rules become one ordered Spark conditional expression over the statistics of
all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, claim_memory, map_texts, text_bytes, work_dir, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Labelled documents that the rules are fitted on, at most (those of smallest id hash).
MAX_LABELLED = 20_000

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
           "n_marks", "n_distinct"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS]])


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in windows of ``window`` (a power of two) words found twice or more in that text.

    Windows get exact numbers by doubling: a number for each word, then for
    each pair of numbers at half the width, all texts at once.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < window:
        return np.zeros(len(words), np.int64)
    ids: dict[bytes, int] = {}
    counter = count()
    code = np.fromiter((ids.setdefault(w, n) for text in words for w, n in zip(text, counter)), np.int64, total)
    width = 1
    while width < window:
        code = pd.factorize(code[:-width] * total + code[width:])[0]
        width *= 2
    text = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(code)) + window <= ends[:len(code)])
    twice = pd.Series(code[starts] * len(words) + text[starts]).duplicated(keep=False).to_numpy()
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + window, -1)
    return np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=len(words))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every whole text: one row per row of ``docs``."""
    def counts(ids, texts):
        claim_memory()
        words = [t.split() for t in texts]
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        lost = lambda t, chars: len(t) - len(t.translate(None, chars))
        return {"doc_id": ids, "n_words": [len(w) for w in words],
                "word_chars": [len(t.translate(None, _SPACE + _CONTINUATION)) for t in texts],
                "n_symbols": [lost(t, _SYMBOLS) for t in texts],
                "n_dup_lines": [len(x) - len(set(x)) for x in lines],
                "n_repeat_words": repeated_words(words),
                "n_lines": [len(x) for x in lines], "n_upper": [lost(t, _UPPER) for t in texts],
                "n_digits": [lost(t, b"0123456789") for t in texts], "n_marks": [lost(t, b"!?") for t in texts],
                "n_distinct": [len(set(w)) for w in words]}
    return map_texts(text_bytes(docs, id_col, text_col), counts,
                     "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS), _SCHEMA)


def features() -> dict[str, Column]:
    """Ratios that the rules test, from the counts; all defined for empty texts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / chars, "upper_ratio": F.col("n_upper") / chars,
            "digit_ratio": F.col("n_digits") / chars, "mark_ratio": F.col("n_marks") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words,
            "distinct_ratio": F.col("n_distinct") / words, "words_per_line": words / F.greatest(F.col("n_lines"), F.lit(1)),
            "n_words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Condition:
    feature: str
    over: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def column(self) -> Column:
        c, t = F.col(self.feature), F.lit(float(self.threshold))
        return c >= t if self.over else c < t

    def test(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.over else x < self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x[:, names.index(c.feature)])
    return out


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the highest information gain for the positives it keeps."""
    p0, n0 = int(y.sum()), int((~y).sum())
    base = np.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for f, name in enumerate(names):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        below_p, below_n = pos[cuts], cuts + 1 - pos[cuts]
        for over, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, over, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 20, max_conditions: int = 4,
                min_precision: float = 0.8, min_cover: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering. ``y``: True for the rows to reject; returns ordered rules.

    A rule is kept if, on the rows that earlier rules leave, at least
    ``min_precision`` of what it covers is to be rejected, in the growing and
    in the pruning part (where it covers anything there). No positives: no rules.
    """
    part = np.random.default_rng(seed).permutation(len(y)) % 3
    left = np.ones(len(y), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & (part != 0), left & (part == 0)
        if y[grow].sum() < min_cover:
            break
        rule: Rule = ()
        rows = np.flatnonzero(grow)
        while len(rule) < max_conditions and (~y[rows]).any():
            _, c = _best_condition(x[rows], y[rows], names)
            if c is None:
                break
            rule += (c,)
            rows = rows[c.test(x[rows, names.index(c.feature)])]
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = _covered(r, x, names) & prune
            return (int(y[hit].sum()) - int((~y[hit]).sum())) / max(1, int(hit.sum()))
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)  # ties: the shortest
        hit = _covered(rule, x, names)
        shares = [y[hit & s].mean() for s in (grow, prune) if (hit & s).any()]
        if (hit & left & y).sum() < min_cover or min(shares) < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_expression(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects: one ordered conditional."""
    out = F.lit(True)
    for rule in reversed(rules):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(False)).otherwise(out)
    return out


def train_rules(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled rows of ``stats`` (counts by doc_id); ``labels``: (doc_id, quality 0/1).

    At most ``max_labelled`` labelled rows, those of smallest id hash, reach
    the driver as a handful of numbers each.
    """
    names = list(features())
    sample = bounded_sample(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality"), max_labelled)
    rows = stats.join(sample, "doc_id").select("doc_id", "quality", *[c.alias(f"f_{k}") for k, c in features().items()])
    data = sorted(tuple(r) for r in rows.collect())
    if not data:
        return []
    table = np.array([r[2:] for r in data], float)
    return learn_rules(table, np.array([r[1] == 0 for r in data]), names)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[Rule] | None = None, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept.

    base_failed: under 20 words, or over 30 % of the words in repeated
    8-word windows. kept: neither base_failed nor rejected by a learned rule
    (fitted on ``labels``, unless ``rules`` are given). Null and empty texts
    have no words and fail. Repeated rows repeat; an empty table gives an
    empty result; other columns are ignored. Without labels no rule is
    learned and the base rules decide alone.
    """
    stats = written(text_statistics(docs, id_col, text_col), "statistics", folder or work_dir(docs.sparkSession))
    return verdicts(stats, train_rules(stats, labels) if rules is None else rules)


def verdicts(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of :func:`judge_quality` from counts (:func:`text_statistics`) and rules, one for each row of counts."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = [F.col(c) for c in _COUNTS if c != "n_words"]
    return (stats.withColumn("_n", F.col("n_words"))
            .select("doc_id", *counts, F.col("_n").alias("n_words_long"), base.alias("base_failed"),
                    *[c.alias(k) for k, c in features().items()])
            .withColumn("kept", ~F.col("base_failed") & rules_expression(rules))
            .select("doc_id", F.col("n_words_long").alias("n_words"), *counts, "base_failed", "kept"))
