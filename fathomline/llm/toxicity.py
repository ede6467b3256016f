"""Toxic spans by a two-label linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import fresh

#: Documents of each label that the model is fitted on, at most.
TRAIN_ROWS_PER_LABEL = 1000
BLOCK = 64
CACHE_WORDS = 400_000
#: Tokens whose marginals are worked out at once in training, which bounds the driver's memory.
TRAIN_TOKENS = 200_000
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """Features of one lower-cased word: itself, its first 4 and 5 and its last 4 letters."""
    parts = ["w" + word]
    if len(word) > 4:
        parts += ["p" + word[:4], "s" + word[-4:]]
    if len(word) > 5:
        parts.append("q" + word[:5])
    return parts


@dataclass
class Chain:
    """Weights of the field: those of emission features that are not near 0, and the odds of each transition.

    ``start`` is the odds of beginning toxic; ``stay[i, j]`` the factor for
    going from label i to j.
    """

    weights: dict[str, float]
    start: float
    stay: np.ndarray
    bias: float
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))


def marginals(odds: np.ndarray, first: np.ndarray, start: float, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many documents laid end to end.

    ``odds`` holds exp(emission) of every token, ``first`` marks the tokens
    that begin a document. Returns the marginal of label 1 for each token and
    the expected transition counts (2 x 2). The tokens are cut into blocks of
    BLOCK; a block's transfer matrix is the product of its tokens', products
    are chained over blocks, and then all blocks run side by side.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    blocks = -(-n // BLOCK)
    e = np.ones(blocks * BLOCK)
    e[:n] = odds
    f = np.zeros(blocks * BLOCK, dtype=bool)
    f[:n] = first
    last = np.ones(blocks * BLOCK, dtype=bool)  # the next token, if any, begins a document
    last[: n - 1] = first[1:]
    e, f, last = e.reshape(blocks, BLOCK).T.copy(), f.reshape(blocks, BLOCK).T.copy(), last.reshape(blocks, BLOCK).T.copy()
    (a00, a01), (a10, a11) = stay

    def chained(m: np.ndarray, begin: float, backwards: bool) -> np.ndarray:
        """The odds with which each block is entered."""
        out, r = np.empty(blocks), begin
        for b in range(blocks - 1, -1, -1) if backwards else range(blocks):
            out[b] = r
            r = (m[0, 1, b] + m[1, 1, b] * r) / (m[0, 0, b] + m[1, 0, b] * r)
        return out

    # Forward: odds of label 1 against 0 given the past and the token itself.
    m = np.zeros((2, 2, blocks))
    m[0, 0] = m[1, 1] = 1.0
    for t in range(BLOCK):
        x0 = np.where(f[t], 1.0, a00), np.where(f[t], 1.0, a10)
        x1 = np.where(f[t], start, a01) * e[t], np.where(f[t], start, a11) * e[t]
        nxt = np.stack([np.stack([m[i, 0] * x0[0] + m[i, 1] * x0[1], m[i, 0] * x1[0] + m[i, 1] * x1[1]]) for i in (0, 1)])
        m = nxt / nxt.max(axis=(0, 1))
    r = chained(m, start, False)
    fwd = np.empty((BLOCK, blocks))
    before = np.empty((BLOCK, blocks))
    for t in range(BLOCK):
        before[t] = r
        r = np.where(f[t], start, (a01 + a11 * r) / (a00 + a10 * r)) * e[t]
        fwd[t] = r
    # Backward: how much likelier the future is after label 1 than after 0.
    m[:] = 0.0
    m[0, 0] = m[1, 1] = 1.0
    for t in range(BLOCK - 1, -1, -1):
        # (beta0, beta1) before the token from (beta0, beta1) after it
        y00, y01 = np.where(f[t], 1.0, a00), np.where(f[t], start, a01) * e[t]
        y10, y11 = np.where(f[t], 1.0, a10), np.where(f[t], start, a11) * e[t]
        nxt = np.stack([np.stack([m[i, 0] * y00 + m[i, 1] * y01, m[i, 0] * y10 + m[i, 1] * y11]) for i in (0, 1)])
        m = nxt / nxt.max(axis=(0, 1))
    r = chained(m, 1.0, True)
    bwd = np.empty((BLOCK, blocks))
    for t in range(BLOCK - 1, -1, -1):
        bwd[t] = np.where(last[t], 1.0, r)
        r = (a10 + a11 * e[t] * bwd[t]) / (a00 + a01 * e[t] * bwd[t])
    joint = fwd * bwd
    p = joint / (1.0 + joint)
    # Expected transitions into each token that does not begin a document.
    inner = ~f
    inner.T.reshape(-1)[n:] = False
    inside = np.zeros(blocks * BLOCK, dtype=bool)
    inside[:n] = ~first
    inside = inside.reshape(blocks, BLOCK).T
    w = np.stack([np.ones_like(fwd) * a00, a01 * e * bwd, before * a10, before * a11 * e * bwd])
    w = (w / w.sum(axis=0))[:, inside].sum(axis=1)
    return p.T.reshape(-1)[:n], w.reshape(2, 2)


def label_tokens(docs: list[np.ndarray], toxic: np.ndarray, table: np.ndarray, sizes: np.ndarray, kinds: int) -> np.ndarray:
    """Which features mark toxic words, from labels of whole documents.

    Greedy cover: the feature that occurs in most toxic documents not yet
    explained is taken, if it is in hardly any clean one; its documents then
    count as explained. So a rare word that only shares a document with a
    marked one is not taken.
    """
    # Of near copies, which share the word of least rank, one speaks for all.
    order = np.random.default_rng(5).permutation(len(table))
    least = np.array([order[d].min() if len(d) else -1 for d in docs], dtype=np.int64)
    _, one = np.unique(least * 2 + toxic, return_index=True)
    docs, toxic = [docs[i] for i in one], toxic[one]
    if not len(docs):
        return np.zeros(kinds, dtype=bool)
    pairs = [np.unique(table[d][np.arange(table.shape[1]) < sizes[d][:, None]]) for d in docs]
    clean = np.bincount(np.concatenate([p for p, y in zip(pairs, toxic, strict=True) if not y] or [np.zeros(0, int)]), minlength=kinds)
    owner = np.repeat(np.arange(len(docs)), [len(p) for p in pairs])
    flat = np.concatenate(pairs) if pairs else np.zeros(0, int)
    keep = toxic[owner]
    owner, flat = owner[keep], flat[keep]
    whole = np.bincount(flat, minlength=kinds)
    open_ = toxic.copy()
    marked = np.zeros(kinds, dtype=bool)
    share = toxic.mean() if len(toxic) else 0.0
    pure = clean * 25 * share <= whole * (1 - share)
    enough = max(3.0, 0.005 * toxic.sum())  # fewer documents than this agree by chance
    for _ in range(2000):
        left = np.bincount(flat[open_[owner]], minlength=kinds) * pure
        best = int(left.argmax())
        if left[best] < enough:
            break
        # Of features in the same documents the purest and commonest goes first.
        marked[best] = True
        open_[owner[flat == best]] = False
    # And those, explained or not, that are in so many toxic documents and hardly any clean one that chance can't do it for any feature.
    by_chance = np.log(100 * kinds) / -np.log(min(max(share, 1e-6), 1 - 1e-6))
    marked |= (whole >= by_chance) & (clean * 200 * share <= whole * (1 - share)) & (whole >= 0.01 * toxic.sum())
    return marked


def train(texts: list[str], toxic: np.ndarray, rounds: int = 30) -> Chain:
    """Fits the field on token labels derived from document labels, then a calibration of document scores."""
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(t.lower())], dtype=np.int32) for t in texts]
    named: dict[str, int] = {}
    table = np.full((max(1, len(ids)), 4), -1, dtype=np.int32)
    for i, word in enumerate(ids):
        for j, f in enumerate(features(word)):
            table[i, j] = named.setdefault(f, len(named))
    kinds = max(1, len(named))
    sizes = (table >= 0).sum(axis=1)
    table = np.maximum(table, 0)
    used = np.arange(4) < sizes[:, None]
    toxic = toxic.astype(bool)
    marked = label_tokens(docs, toxic, table, sizes, kinds)
    word_marked = (marked[table] & used).any(axis=1)
    stream = np.concatenate([*docs, np.zeros(0, dtype=np.int32)])
    first = np.zeros(len(stream), dtype=bool)
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    first[starts[lengths > 0]] = True
    y = word_marked[stream] & np.repeat(toxic, lengths)

    # Cuts between documents, every TRAIN_TOKENS or so.
    ends = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([[0], ends[np.flatnonzero(np.diff(ends // TRAIN_TOKENS, prepend=0) > 0)], [len(stream)]])).astype(np.int64)

    weights, bias = np.zeros(kinds), np.array([-3.0])
    trans = np.zeros((2, 2))  # log factors; [0, 0] stays 0
    seen = np.zeros((2, 2))
    if len(y) > 1:
        pair = ~first[1:]
        np.add.at(seen, (y[:-1][pair].astype(int), y[1:][pair].astype(int)), 1.0)
    word_y = np.bincount(stream, weights=y, minlength=len(table))
    steps = [np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(trans)]
    scale = max(1.0, float(y.sum()))
    for _ in range(rounds):
        emission = (weights[table] * used).sum(axis=1) + bias[0]
        odds = np.exp(np.clip(emission, -30, 30))
        parts = [marginals(odds[stream[a:b]], first[a:b], 1.0, np.exp(trans)) for a, b in zip(cuts, cuts[1:], strict=False)]
        p, expected = np.concatenate([q for q, _ in parts] or [np.zeros(0)]), sum((e for _, e in parts), np.zeros((2, 2)))
        gap = word_y - np.bincount(stream, weights=p, minlength=len(table))
        grad = np.bincount(table[used], weights=np.repeat(gap, used.sum(axis=1)), minlength=kinds)
        grads = [grad / scale - 1e-4 * weights, np.array([gap.sum() / scale]), (seen - expected) / scale - 1e-4 * trans]
        grads[2][0, 0] = 0.0
        for i, (value, g) in enumerate(zip((weights, bias, trans), grads, strict=True)):
            steps[i] += g * g
            value += 1.2 * g / np.sqrt(steps[i] + 1e-8)
    kept = {name: float(weights[i]) for name, i in named.items() if abs(weights[i]) > 0.05}
    model = Chain(kept, 1.0, np.exp(trans), float(bias[0]))
    scorer = Scorer(model)
    x = np.array([evidence(p) for part in portions(texts, 1_000_000) for p in scorer.token_marginals(part)]).reshape(len(texts), 3)
    model.calibration = logistic(np.hstack([np.ones((len(x), 1)), x]), toxic.astype(float))
    return model


def evidence(p: np.ndarray) -> np.ndarray:
    """What a document's score is made of: its largest marginal, the expected toxic tokens, and noisy-or log odds."""
    if not len(p):
        return np.zeros(3)
    none = np.log1p(-np.minimum(p, 1 - 1e-9)).sum()
    some = -np.expm1(min(none, -1e-12))
    return np.array([p.max(), min(p.sum(), 5.0), np.clip(np.log(some) - none, -12.0, 12.0) / 12.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
    return w


class Scorer:
    """Scores texts in batches; remembers the emissions of words within a bound."""

    def __init__(self, model: Chain):
        self.model = model
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        """Works out the emissions of words not met before, all at once."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        get = self.model.weights.get
        values = np.exp(np.clip(np.array([sum([get(f, 0.0) for f in features(w)]) for w in words]) + self.model.bias, -30, 30))
        self.known.update(zip(words, values.tolist(), strict=True))

    def token_marginals(self, texts: list[str]) -> list[np.ndarray]:
        parts = [WORD.findall(text.lower()) for text in texts]
        new = list(set().union(*parts).difference(self.known))
        if new:
            self.learn(new if len(self.known) + len(new) <= CACHE_WORDS else list(set().union(*parts)))
        known = self.known
        odds = np.array([known[w] for part in parts for w in part])
        ends = np.cumsum([len(part) for part in parts])
        first = np.zeros(len(odds), dtype=bool)
        starts = ends - [len(part) for part in parts]
        first[starts[starts < ends]] = True
        p, _ = marginals(odds, first, self.model.start, self.model.stay)
        return np.split(p, ends[:-1]) if texts else []

    def score(self, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        parts = self.token_marginals(texts)
        x = np.stack([evidence(p) for p in parts]) if parts else np.zeros((0, 3))
        z = np.hstack([np.ones((len(x), 1)), x]) @ self.model.calibration
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist(), [spans(t, p) for t, p in zip(texts, parts, strict=True)]


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Character offsets of the runs of tokens that are toxic by at least even odds."""
    if not len(p) or p.max() < 0.5:
        return []
    out: list[dict] = []
    lowered = text.lower()
    # A few letters grow in lower case; then places are found by how far each letter of the text reaches.
    reach = None if len(lowered) == len(text) else np.cumsum([len(c.lower()) for c in text])
    place = (lambda i: i) if reach is None else (lambda i: int(np.searchsorted(reach, i, side="right")))
    for k, match in enumerate(WORD.finditer(lowered)):
        if p[k] >= 0.5:
            end = place(match.end() - 1) + 1
            if out and out[-1]["_k"] == k - 1:
                out[-1] |= {"end": end, "probability": max(out[-1]["probability"], float(p[k])), "_k": k}
            else:
                out.append({"start": place(match.start()), "end": end, "probability": float(p[k]), "_k": k})
    return [{k: v for k, v in s.items() if k != "_k"} for s in out]


SPANS = "array<struct<start:int,end:int,probability:double>>"


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = TRAIN_ROWS_PER_LABEL) -> Chain:
    """Fits on at most ``rows_per_label`` labelled documents of each label, chosen by a hash of their identifier.

    Rows of ``labels`` without a label or identifier are not used; a document
    labelled twice counts as toxic if either label says so, and of several rows
    of one identifier the least text is taken. Without any labelled row the
    scores are all the same.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    order = F.xxhash64("_id", F.lit(1))
    chosen = None
    for value in (0, 1):
        part = marks.filter(F.col("_y") == value).orderBy(order, "_id").limit(rows_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    rows = sorted({(r["_id"], r["_text"], r["_y"]) for r in rows})
    return train([r[1] for r in rows], np.array([r[2] for r in rows], dtype=float))


def score_toxicity(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``toxic_spans`` (character offsets in the text, the end not included) to ``docs``.

    Null and empty texts have no token and get the score of a document without
    evidence. Earlier columns of these names are replaced, all others pass
    unchanged. Each row is scored by itself, so repeated rows and rows without
    identifier are scored like any other; an empty table stays empty. Whole
    texts are read, in batches of bounded size.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, spans {SPANS}")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            values = [t or "" for t in texts]
            scores, found = [], []
            for part in portions(values):
                s, f = scorer.score(part)
                scores += s
                found += f
            yield pd.DataFrame({"score": scores, "spans": found})

    (tags,) = fresh(docs.columns, "_tags")
    tagged = docs.withColumn(tags, tag(F.coalesce(F.col(text_col), F.lit(""))))
    return tagged.withColumn("score", F.col(tags)["score"]).withColumn("toxic_spans", F.col(tags)["spans"]).drop(tags)


def portions(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
