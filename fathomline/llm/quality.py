"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
NAMES = (
    "chars", "words", "word_length", "upper", "digits", "spaces", "letters", "symbols", "marks_per_word", "bangs", "bars", "lines", "line_length",
    "repeated_lines", "distinct_words", "top_word", "repeated_next", "short_words", "long_words", "capital_words", "wide", "stops", "distinct_pairs",
)
LETTERS = re.compile(r"[^\W\d_]")
MARKED = re.compile(r"\w[^\w\s.,;:'\"!?-]+(?:\s|$)")


def statistics(text: str) -> list[float]:
    """The numbers a document is judged by; all are 0 for an empty text."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(n), *[0.0] * (len(NAMES) - 1)]
    w = len(words)
    counts = Counter(words)
    lines = text.split("\n")
    raw = text.encode("utf-8", "replace")
    codes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = codes[65:91].sum(), codes[97:123].sum(), codes[48:58].sum()
    spaces = codes[[9, 10, 11, 12, 13, 32]].sum()
    wide = codes[128:].sum()
    symbols = codes[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    b = len(raw)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(n), float(w), lengths.mean(), upper / b, digits / b, spaces / b, (upper + lower + wide) / b, symbols / b, symbols / w, codes[33] / w, codes[124] / w,
        float(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / w, counts.most_common(1)[0][1] / w,
        sum(map(str.__eq__, words, words[1:])) / w, float((lengths <= 3).mean()), float((lengths >= 15).mean()), sum(map(str.isupper, words)) / w, wide / b,
        (codes[46] + codes[63]) / w, pairs / max(1, w - 1),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node i of tree t splits at ``threshold[t, i]`` of ``feature[t, i]``; children are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All rows and trees go down one level at a time."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        which = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            goes_right = x[rows, self.feature[which, at]] > self.threshold[which, at]
            at = 2 * at + 1 + goes_right
        z = self.base + self.leaf[which, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Forest:
    """Boosts depth-wise trees on histograms of BINS quantile bins, for logistic loss."""
    n, d = x.shape
    inner = 2**depth - 1
    if not n:
        return Forest(np.zeros((1, inner), int), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), 0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    z = np.full(n, base)
    cell = binned + np.arange(d) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, begin = 2**level, 2**level - 1
            key = ((at - begin)[:, None] * (d * BINS) + cell).ravel()
            hist_g = np.bincount(key, weights=np.repeat(g, d), minlength=nodes * d * BINS).reshape(nodes, d, BINS).cumsum(axis=2)
            hist_h = np.bincount(key, weights=np.repeat(h, d), minlength=nodes * d * BINS).reshape(nodes, d, BINS).cumsum(axis=2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            gain = hist_g**2 / (hist_h + ridge) + (all_g - hist_g) ** 2 / (all_h - hist_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(hist_h < 2) | (all_h - hist_h < 2)] = 0
            for k in range(nodes):
                j, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, begin + k], threshold[t, begin + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        sums_g = np.bincount(at - inner, weights=g, minlength=inner + 1)
        sums_h = np.bincount(at - inner, weights=h, minlength=inner + 1)
        leaf[t] = rate * sums_g / (sums_h + ridge)
        z += leaf[t, at - inner]
    return Forest(feature, threshold, leaf, base)


def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t or "") for t in texts])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fits on at most ``rows`` labelled documents, chosen by a hash of their identifier.

    Spark computes the statistics of the chosen documents; the driver gets
    those numbers only. Rows without label or identifier are not used; of
    several labels for one document the greatest counts.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("_id", F.lit(2)), "_id").limit(rows))  # at most ``rows`` small rows
    table = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_id", "_y", F.pandas_udf(_statistics, "array<double>")("_text").alias("x")).collect()
    table = sorted((r["_id"], r["_y"], r["x"]) for r in table)
    x = np.array([r[2] for r in table], dtype=float).reshape(len(table), len(NAMES))
    return fit_forest(x, np.array([r[1] for r in table], dtype=float))


def score_quality(docs: DataFrame, model: Forest, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: better) to ``docs``; an earlier column of this name is replaced.

    Null counts as the empty text, whose statistics are all 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest = sent.value
        for texts in batches:
            x = np.array([statistics(t or "") for t in texts], dtype=float).reshape(len(texts), len(NAMES))
            yield pd.Series(forest.predict(x))

    return docs.withColumn("score", score(F.col(text_col)))
