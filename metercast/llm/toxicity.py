"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

One model of order six for toxic and one for ordinary labelled texts; both
back off to the same lower orders, which count in how many different contexts
of either class a character sequence occurs. So an expression that neither
class has seen often gets nearly the same likelihood from both, and for a
sequence unseen in both the shared factor cancels in the ratio: a word needs
two look-ups for each character. A text's evidence is its length-normalised
log-likelihood ratio and the highest such ratios among its words; a logistic
function, fitted on labelled texts that the counts did not see, maps it to 0..1.

Scoring uses the text alone. The counts and the fit come from a bounded sample
of labelled texts (``max_per_class`` of each label).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, claim_memory, map_texts, text_bytes

ORDER = 6
#: Labelled texts of each label used for fitting, at most (those of smallest id hash).
MAX_PER_CLASS = 8_000
THRESHOLD = 0.7
#: Scored words that a worker keeps; it starts afresh beyond that (memory only, results don't depend on it).
CACHE_WORDS = 400_000

_START, _END = 1, 2
_EDGE = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")  # ASCII punctuation around a word


def fold(doc_id: Column, parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words, cut at ASCII white space."""
    return text.decode("utf-8", "replace").lower().encode().split()


def sequences(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams, word number) of all characters of the words and their ends.

    A gram is the ``order`` bytes up to a character, in one integer, the
    oldest first; words begin with start marks.
    """
    bodies = [_EDGE.sub(b"", w) + bytes([_END]) for w in words]
    pad = bytes([_START]) * (order - 1)
    data = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8).astype(np.int64)
    sizes = np.array([len(b) for b in bodies], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes + order - 1) - sizes
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(word))
    gram = np.zeros(len(word), np.int64)
    for j in range(order):
        gram = (gram << 8) | data[at - (order - 1) + j]
    return gram, word


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights, len(found))


def _value(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    """Values of sorted ``keys`` in a (sorted keys, values) table."""
    have, values = table
    if not len(have):
        return np.full(len(keys), missing)
    k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[k] == keys, values[k], missing)


def discount(counts: np.ndarray) -> float:
    """Ney's absolute discount, from how many counts are one and two."""
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


@dataclass
class Ratios:
    """log P(character | context, toxic) - log P(... | ordinary), for every gram and context that was seen."""
    order: int
    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]  # for grams unseen in both classes
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    bias: float = 0.0
    middle: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    spread: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0])

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        gram, word = sequences(words, self.order)
        found, where = np.unique(gram, return_inverse=True)
        unseen = _value(self.contexts, found >> 8, 0.0)
        have, values = self.grams
        if len(have):
            k = np.minimum(np.searchsorted(have, found), len(have) - 1)
            unseen = np.where(have[k] == found, values[k], unseen)
        return np.bincount(word, unseen[where], len(words))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        z = ((evidence - np.array(self.middle)) / np.array(self.spread)) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def kneser_ney_ratios(grams: np.ndarray, counts: list[np.ndarray], order: int = ORDER) -> Ratios:
    """``grams``: distinct sorted grams; ``counts``: their counts in ordinary and in toxic texts."""
    # shared lower orders: in how many different contexts a shorter gram occurs, whatever the class
    lower = np.full(len(grams), 1.0 / 256)
    tables = []
    keys = grams
    for n in range(order - 1, 0, -1):
        keys, n_contexts = _grouped(keys & ((1 << (8 * n)) - 1), np.ones(len(keys)))
        tables.append((n, keys, n_contexts))
    for n, keys, n_contexts in reversed(tables):
        d = discount(n_contexts)
        total = _grouped(keys >> 8, n_contexts)
        kinds = _grouped(keys >> 8, np.ones(len(keys)))
        short = grams & ((1 << (8 * n)) - 1)
        t = _value(total, short >> 8, 0.0)
        own = np.maximum(_value((keys, n_contexts), short, 0.0) - d, 0.0)
        lower = np.where(t > 0, (own + d * _value(kinds, short >> 8, 0.0) * lower) / np.maximum(t, 1), lower)
    context = grams >> 8
    logs, backoffs = [], []
    all_contexts = np.unique(context)
    for c in counts:
        d = discount(c)
        total, kinds = _grouped(context, c), _grouped(context, (c > 0).astype(float))
        t = _value(total, context, 0.0)
        p = np.where(t > 0, (np.maximum(c - d, 0) + d * _value(kinds, context, 0.0) * lower) / np.maximum(t, 1), lower)
        logs.append(np.log(p))
        left = np.where(total[1] > 0, d * kinds[1] / np.maximum(total[1], 1), 1.0)
        backoffs.append(np.log(_value((total[0], left), all_contexts, 1.0)))
    return Ratios(order, (grams, logs[1] - logs[0]), (all_contexts, backoffs[1] - backoffs[0]))


class WordScorer:
    """Evidence of texts, from remembered words' ratios."""

    def __init__(self, ratios: Ratios):
        self.ratios = ratios
        self.cache: dict[bytes, float] = {}

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: the mean ratio of its words, the highest, and the mean of the two highest. No words: zeros."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        words = [plain_words(t) for t in texts]
        new = set()
        for w in words:
            new |= set(w).difference(self.cache)
        new = list(new)
        for k in range(0, len(new), 100_000):
            part = new[k:k + 100_000]
            self.cache.update(zip(part, self.ratios.of_words(part).tolist()))
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(texts), 3))
        some = np.flatnonzero(sizes)
        if len(some):
            get = self.cache.__getitem__
            v = np.fromiter((x for w in words for x in map(get, w)), float, int(sizes.sum()))
            start = np.cumsum(sizes[some]) - sizes[some]
            out[some, 0] = np.add.reduceat(v, start) / sizes[some]
            top = np.maximum.reduceat(v, start)
            first = np.flatnonzero(v == np.repeat(top, sizes[some]))
            text = np.repeat(np.arange(len(some)), sizes[some])[first]
            v[first[np.unique(text, return_index=True)[1]]] = -np.inf  # one of the highest goes
            second = np.maximum.reduceat(v, start)
            out[some, 1] = top
            out[some, 2] = np.where(np.isfinite(second), (top + second) / 2, top / 2)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weighted by class, ridge; Newton steps. Returns weights and bias."""
    a = np.column_stack([x, np.ones(len(x))])
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (share * (p - y)) + ridge @ w
        h = (a * (share * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, data, toxic): the labelled texts used for fitting, ``max_per_class`` of each label at most."""
    rows = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for label in (0, 1):
        part = bounded_sample(rows.where(F.col("toxic") == label), max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_per_class narrow rows
    return text_bytes(docs).join(F.broadcast(picked), "doc_id")


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = MAX_PER_CLASS,
                   order: int = ORDER) -> Ratios:
    """Fit on labelled texts whose label row meets ``usable``.

    Four fifths of them (by id hash) are counted, the rest calibrates.
    Without labelled texts every score is 0.
    """
    sample = labelled_sample(docs, labels, usable, max_per_class)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(5))
    schema = pa.schema([("gram", pa.int64()), ("toxic", pa.int64()), ("ordinary", pa.int64())])
    counted = sample.where(part != 0)

    def grams_of(label: int) -> DataFrame:
        def count(_, texts):
            words: dict[bytes, int] = {}
            for t in texts:
                for w in plain_words(t):
                    words[w] = words.get(w, 0) + 1
            gram, word = sequences(list(words), order)
            n = np.array(list(words.values()), float)
            keys, sums = _grouped(gram, n[word]) if words else (gram, np.zeros(0))
            sums = sums.astype(np.int64)
            zero = np.zeros(len(keys), np.int64)
            return {"gram": keys, "toxic": sums if label else zero, "ordinary": zero if label else sums}
        return map_texts(counted.where(F.col("toxic") == label).select("doc_id", "data"), count,
                         "gram long, toxic long, ordinary long", schema)
    # bounded by the characters of the sample
    table = (grams_of(0).unionByName(grams_of(1)).groupBy("gram")
             .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow())
    if not table.num_rows:
        return Ratios(order, (np.zeros(0, np.int64), np.zeros(0)), (np.zeros(0, np.int64), np.zeros(0)), bias=-60.0)
    gram = table["gram"].to_numpy()
    rank = np.argsort(gram)
    ratios = kneser_ney_ratios(gram[rank], [table[c].to_numpy()[rank].astype(float) for c in ("ordinary", "toxic")], order)
    held = _evidence(sample.where(part == 0).select("doc_id", "data"), ratios).join(
        sample.where(part == 0).select("doc_id", "toxic"), "doc_id").select("mean", "top", "top2", "toxic").collect()
    x, y = np.array([tuple(r)[:3] for r in held], float).reshape(-1, 3), np.array([r.toxic == 1 for r in held], bool)
    if y.all() or not y.any():  # nothing to calibrate on: half way at a ratio of 10
        ratios.weights, ratios.bias = [0.0, 1.0, 0.0], -10.0
        return ratios
    ratios.middle, ratios.spread = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    w, b = fit_logistic((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), y)
    ratios.weights, ratios.bias = w.tolist(), b
    return ratios


def _evidence(rows: DataFrame, ratios: Ratios) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(ratios)  # bounded by the labelled sample
    schema = pa.schema([("doc_id", pa.int64()), ("mean", pa.float64()), ("top", pa.float64()), ("top2", pa.float64()),
                        ("score", pa.float64())])

    def score(ids, texts, scorer):
        e = scorer.evidence(texts)
        return {"doc_id": ids, "mean": e[:, 0], "top": e[:, 1], "top2": e[:, 2], "score": scorer.ratios.probability(e)}
    return map_texts(rows, score, "doc_id long, mean double, top double, top2 double, score double", schema,
                     setup=lambda: _scorer(shared))


_SCORERS: dict[int, WordScorer] = {}


def _scorer(shared) -> WordScorer:
    """One scorer for each worker process and model."""
    claim_memory("scorers", _SCORERS.clear)
    ratios = shared.value
    if id(ratios) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(ratios)] = WordScorer(ratios)
    return _SCORERS[id(ratios)]


def score_toxicity(docs: DataFrame, ratios: Ratios, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, log_ratio_per_word, top_word_ratio) of every whole text.

    A null or empty text has no evidence and gets the score of none.
    Repeated rows repeat; an empty table gives an empty result; other columns
    are ignored.
    """
    return (_evidence(text_bytes(docs, id_col, text_col), ratios)
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                    F.col("mean").alias("log_ratio_per_word"), F.col("top").alias("top_word_ratio")))
