"""Document quality by a generalised additive model with pairwise interactions.

Every feature is binned at quantiles of the training sample. Cyclic boosting goes round the features, fits a
shallow tree on the current gradient over a feature's bins and adds a small multiple of its leaves to that
feature's lookup table; then the pairs with the largest remaining gain are boosted the same way over two-dimensional
bins. A score is the logistic of an intercept and one table entry for each feature and pair: vectorised additions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import id_text_crc, small_arrow_batches, spread

#: Least score of a document that is kept.
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "upper", "digit", "punctuation", "symbol", "exclaim", "bar", "space", "wide", "distinct", "repeat", "commonest", "line_words", "line_distinct", "short_words", "upper_first")
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_PUNCTUATION, _SYMBOL = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b".,;:?'\"()-", b"#$%&*@^~_=+<>{}[]\\/"))
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f\v", np.uint8))
WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Settings:
    """Training. max_rows bounds the sample of labelled rows (expected number, by a hash of doc_id)."""

    max_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 200
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.1
    leaf: int = 10
    seed: int = 29


def measure(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null one has zeros."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(data), 1)
    seen = np.bincount(data, minlength=256)
    tokens = WORD.findall(text)
    m = max(len(tokens), 1)
    counts = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(int(seen[_UPPER | _LOWER].sum()), 1)
    return [
        np.log1p(len(tokens)),
        sum(map(len, tokens)) / m,
        seen[_UPPER].sum() / letters,
        seen[_DIGIT].sum() / n,
        seen[_PUNCTUATION].sum() / n,
        seen[_SYMBOL].sum() / n,
        seen[33] / n,
        seen[124] / n,
        seen[_SPACES].sum() / n,
        seen[128:].sum() / n,
        len(counts) / m,
        sum(a == b for a, b in zip(tokens, tokens[1:])) / m,
        max(counts.values(), default=0) / m,
        len(tokens) / max(len(lines), 1),
        len(set(lines)) / max(len(lines), 1),
        sum(len(w) <= 3 for w in tokens) / m,
        sum(w[0].isupper() for w in tokens) / m,
    ]


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Leaf values over ordered bins of a tree of ``depth`` splits down, each chosen by its gain."""
    g, h, n = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, weight, count))
    value = np.zeros(len(gradient))

    def grow(a: int, b: int, left: int) -> None:
        if left and b - a > 1:
            cuts = np.arange(a + 1, b)
            gain = (g[cuts] - g[a]) ** 2 / (h[cuts] - h[a] + 1) + (g[b] - g[cuts]) ** 2 / (h[b] - h[cuts] + 1)
            gain = np.where((n[cuts] - n[a] >= least) & (n[b] - n[cuts] >= least), gain, -1.0)
            best = int(gain.argmax())
            if gain[best] > (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1) + 1e-9:
                grow(a, int(cuts[best]), left - 1)
                grow(int(cuts[best]), b, left - 1)
                return
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)

    grow(0, len(gradient), depth)
    return value


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray, s: Settings) -> AdditiveModel:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) for c in x.T]
        self.pair_edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.pair_bins + 1)[1:-1])) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.intercept = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.intercept)
        bins = self._binned(x, self.edges)
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        for _ in range(s.rounds):
            for b, t, c in zip(bins, self.tables, counts):
                p = 1 / (1 + np.exp(-total))
                step = s.rate * shallow_tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), c, 2, s.leaf)
                t += step
                total += step[b]
        coarse, width = self._binned(x, self.pair_edges), [len(e) + 1 for e in self.pair_edges]
        p = 1 / (1 + np.exp(-total))
        gains = []
        for i in range(len(width)):
            for j in range(i + 1, len(width)):
                cell = coarse[i] * width[j] + coarse[j]
                g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
                gains.append((-float((g**2 / (h + 1)).sum()), i, j))
        chosen = [(i, j, np.zeros(width[i] * width[j])) for _, i, j in sorted(gains)[: s.pairs]]
        for _ in range(s.pair_rounds):
            for i, j, t in chosen:
                p = 1 / (1 + np.exp(-total))
                cell = coarse[i] * width[j] + coarse[j]
                g, h, c = (np.bincount(cell, v, len(t)).reshape(width[i], -1) for v in (y - p, p * (1 - p), np.ones(len(y))))
                # Two levels: a split of the first feature's bins, then of the second's within each side.
                rows = shallow_tree(g.sum(1), h.sum(1), c.sum(1), 1, s.leaf)
                step = np.zeros_like(g)
                for side in np.unique(rows):
                    own = rows == side
                    step[own] = shallow_tree(g[own].sum(0), h[own].sum(0), c[own].sum(0), 1, s.leaf)
                t += s.rate * step.ravel()
                total += s.rate * step.ravel()[cell]
        self.pairs = chosen
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for b, t in zip(self._binned(x, self.edges), self.tables):
            total += t[b]
        coarse = self._binned(x, self.pair_edges)
        for i, j, t in self.pairs:
            total += t[coarse[i] * (len(self.pair_edges[j]) + 1) + coarse[j]]
        return 1 / (1 + np.exp(-total))


def features(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of docs and one array of features for each row."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(kept)].assign(features=[measure(t) for t in pdf["text"]])

    return docs.select(*kept, "text").mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "features array<double>"]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> AdditiveModel:
    """Train on the texts of ``docs`` whose ids have a non-null quality in ``labels``.

    A bounded sample by a hash of doc_id; an id labelled more than once counts by its larger label, an id with several texts by the one with the
    least hash, so that a sampled id is one row. Without any
    label the model gives every text the score 0.5; with labels of one class it gives that class's clipped share.
    """
    rated = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    share = min(1.0, settings.max_rows / max(rated.count(), 1))
    small_arrow_batches(spark)
    picked = rated.where(spread(F.col("doc_id"), settings.seed) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    sample = features(one, "doc_id", "y").collect()
    sample.sort(key=lambda r: r["doc_id"])
    if not sample:
        zero = np.zeros((1, len(FEATURES)))
        return AdditiveModel(0.0, [c[:0] for c in zero.T], [np.zeros(1)] * len(FEATURES), [c[:0] for c in zero.T], [])
    return AdditiveModel().fit(np.array([r["features"] for r in sample]), np.array([r["y"] for r in sample]), settings)


def score_column(spark: SparkSession, text: Column, model: AdditiveModel) -> Column:
    """The score of every whole text, null or empty ones too; only the text goes to Python."""
    small_arrow_batches(spark)

    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([measure(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return F.pandas_udf(rate, "double")(text)


def held_out_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on labels whose crc32(doc_id as text) mod 5 is not 0, score all: doc_id, held_out, score, predicted."""
    out = F.coalesce(id_text_crc(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(spark, docs, labels.where(~out), settings)
    scored = docs.select("doc_id", score_column(spark, F.col("text"), model).alias("score"))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
