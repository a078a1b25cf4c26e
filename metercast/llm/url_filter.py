"""URL filter: host and path rules, and gradient-boosted trees for the URLs that no rule decides.

Everything that touches the table is a DataFrame expression: host and path,
rules, lexical features, the binned training counts, and the trees, which are
emitted as nested conditional expressions. The trees are fitted on binned
feature vectors that Spark has already counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Host and path rules: (host, path, verdict). Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

FEATURES = ["url_length", "path_depth", "digit_ratio", "entropy", "n_params", "host_labels", "suffix_rate"]
#: Cut points of each feature's bins (suffix_rate: of a share in 0..1).
CUTS = {"url_length": [20, 30, 35, 40, 45, 50, 60, 80, 120, 200], "path_depth": [1, 2, 3, 4, 5, 6, 8],
        "digit_ratio": [0.01, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3], "entropy": [2.5, 3.0, 3.4, 3.6, 3.8, 4.0, 4.2, 4.5],
        "n_params": [1, 2, 3, 5], "host_labels": [2, 3, 4, 5],
        "suffix_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/?#`` or the end, A-Z lower-cased; path: then up to ``?#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, else nulls. Equally long ones: the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # the longest, then the first, ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL; all defined (0) for the empty one. host_suffix feeds suffix_rate."""
    n = F.length(url)
    chars = F.split(url, "")
    # each distinct character's count comes from the sorted string's length without it
    entropy = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
            (lambda p: -p * F.log2(p))((n - F.length(F.replace(url, c, F.lit("")))) / n)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": n.cast("double"),
        "path_depth": (F.length(path) - F.length(F.translate(path, "/", ""))).cast("double"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": F.when(query == "", 0.0).otherwise(
            (F.length(query) - F.length(F.translate(query, "&", "")) + 1).cast("double")),
        "host_labels": F.when(host == "", 0.0).otherwise(
            (F.length(host) - F.length(F.translate(host, ".", "")) + 1).cast("double")),
        "host_suffix": F.substring_index(host, ".", -1),
    }


@dataclass
class Tree:
    """A split (feature, cut: left if below) or, without feature, a leaf value."""
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None


@dataclass
class UrlModel:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    suffix_rates: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5

    def margin(self, features: dict[str, Column]) -> Column:
        def expr(t: Tree) -> Column:
            if t.feature < 0:
                return F.lit(float(t.value))
            return F.when(features[FEATURES[t.feature]] < F.lit(float(t.cut)), expr(t.left)).otherwise(expr(t.right))
        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + expr(t)
        return out

    def suffix_rate(self, suffix: Column) -> Column:
        out = F.lit(float(self.prior))
        for s, r in self.suffix_rates.items():
            out = F.when(suffix == s, F.lit(float(r))).otherwise(out)
        return out


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, l2: float) -> Tree:
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0)
    for f in range(bins.shape[1]) if depth else ():
        width = len(CUTS[FEATURES[f]]) + 1
        gl = np.cumsum(np.bincount(bins[rows, f], g[rows], width))[:-1]
        hl = np.cumsum(np.bincount(bins[rows, f], h[rows], width))[:-1]
        gain = gl**2 / (hl + l2) + (gs - gl)**2 / (hs - hl + l2) - gs**2 / (hs + l2)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return Tree(value=-rate * gs / (hs + l2))
    _, f, k = best
    below = bins[rows, f] <= k
    return Tree(f, float(CUTS[FEATURES[f]][k]), 0.0, _grow(bins, g, h, rows[below], depth - 1, rate, l2),
                _grow(bins, g, h, rows[~below], depth - 1, rate, l2))


def _apply(t: Tree, bins: np.ndarray) -> np.ndarray:
    if t.feature < 0:
        return np.full(len(bins), t.value)
    left = bins[:, t.feature] <= CUTS[FEATURES[t.feature]].index(t.cut)
    return np.where(left, _apply(t.left, bins), _apply(t.right, bins))


def boost(bins: np.ndarray, n: np.ndarray, pos: np.ndarray, n_trees: int, depth: int, rate: float = 0.3,
          l2: float = 1.0) -> tuple[float, list[Tree]]:
    """Second-order boosting of the logistic loss over counted feature vectors."""
    prior = (pos.sum() + 0.5) / (n.sum() + 1.0)
    base = float(np.log(prior / (1 - prior)))
    f, trees = np.full(len(n), base), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        t = _grow(bins, n * p - pos, n * p * (1 - p), np.arange(len(n)), depth, rate, l2)
        f = f + _apply(t, bins)
        trees.append(t)
    return base, trees


def _binned(feature: str, c: Column) -> Column:
    out = F.lit(0)
    for cut in CUTS[feature]:
        out = out + (c >= F.lit(float(cut))).cast("int")
    return out


def train_url_model(labelled: DataFrame, max_suffixes: int = 200, max_vectors: int = 200_000, n_trees: int = 20,
                    depth: int = 3) -> UrlModel:
    """Fit the trees on all labelled URLs: (url string, label 0/1; 1: block).

    Two aggregates reach the driver: positives by host suffix (the
    ``max_suffixes`` commonest) and counts by binned feature vector (the
    ``max_vectors`` commonest; rarer ones would be left out of this fit, as a
    classifier's bounded sample). No labelled rows give a model that allows all.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    feats = lexical(url, host, path)
    base = labelled.select(*[c.alias(k) for k, c in feats.items()], F.col("label").cast("long").alias("label"))
    rows = (base.groupBy("host_suffix").agg(F.count("label").alias("n"), F.sum("label").alias("pos"))
            .orderBy(F.desc("n"), "host_suffix").limit(max_suffixes).collect())
    n, pos = sum(r.n for r in rows), sum(r.pos or 0 for r in rows)
    if not n:
        return UrlModel(base=-10.0)
    prior = (pos + 1) / (n + 2)
    model = UrlModel(prior=prior, suffix_rates={r.host_suffix: (r.pos + 10 * prior) / (r.n + 10) for r in rows})
    binned = base.withColumn("suffix_rate", model.suffix_rate(F.col("host_suffix")))
    counted = (binned.groupBy(*[_binned(f, F.col(f)).alias(f) for f in FEATURES])
               .agg(F.count("label").alias("n"), F.sum("label").alias("pos"))
               .orderBy(F.desc("n"), *FEATURES).limit(max_vectors).collect())
    table = np.array([tuple(r) for r in counted], dtype=np.int64)
    model.base, model.trees = boost(table[:, :-2], table[:, -2].astype(float), table[:, -1].astype(float), n_trees, depth)
    return model


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    The longest rule that fits decides; a host rule holds for the host and
    its subdomains. Other URLs are blocked if the model's probability is over
    ``threshold``; without a model it is trained on the URLs that the rules
    decide. A null url, or one without ``://``, has an empty host and path
    and gets the model's verdict for the empty URL or the text given.
    Repeated rows repeat; empty tables give empty results; other columns are
    ignored.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rule, decided = rule_columns(host, path, rules)
    if model is None:
        labelled = (pages.select(url.alias("url"), decided.alias("decided")).where("decided IS NOT NULL")
                    .select("url", (F.col("decided") == "block").cast("int").alias("label")))
        model = train_url_model(labelled)
    feats = lexical(F.col("_url"), F.col("host"), F.col("path"))
    base = (pages.select(F.col(id_col), url.alias("_url"), host.alias("host"), path.alias("path"), rule.alias("rule"),
                         decided.alias("_decided"))
            .select("*", *[c.alias(f"_{k}") for k, c in feats.items()]))
    cols = {f: F.col(f"_{f}") for f in FEATURES if f != "suffix_rate"}
    base = base.withColumn("_suffix_rate", model.suffix_rate(F.col("_host_suffix")))
    cols["suffix_rate"] = F.col("_suffix_rate")
    score = 1 / (1 + F.exp(-model.margin(cols)))
    return (base.withColumn("block_score", score)
            .select(id_col, "host", "path", "rule",
                    F.coalesce("_decided", F.when(F.col("block_score") > threshold, "block").otherwise("allow"))
                    .alias("verdict"), "block_score"))
