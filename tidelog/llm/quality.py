"""Quality by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its text. Weights are learned from preference pairs: a
document labelled good beats one labelled bad with probability ``sigmoid(score difference)``, and the
logistic loss over all pairs, on feature differences, is minimised. The threshold is a quantile of the
scores: the share of bad labels among all training labels. A score is reported on a scale from 0 to 1 on
which the threshold lies at ``CUT``.

Training takes a bounded sample, ``sample`` labelled documents of either class, and every pair of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import held_out, map_batches

CUT = 0.3
_GOOD, _BAD = 1, 0


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the ASCII bytes (letters by case, digits as one) and of longer characters;
    then lengths, repetition of words and lines, and the share of words that carry marks."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = np.concatenate([counts[:48], counts[58:65], counts[91:97], counts[123:128]])
    shares = np.sqrt(np.array([upper, lower, digit, counts[128:].sum(), *marks]) / max(len(data), 1))
    words, lines = data.split(), data.split(b"\n")
    n = max(len(words), 1)
    plain = sum(map(bytes.isalpha, words))
    rest = [
        np.log1p(len(data)) / 10,
        np.log1p(len(data) / n),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)) / 5,
        plain / n,
    ]
    return np.concatenate([shares, rest])


@dataclass(frozen=True)
class Ranking:
    """A document's margin is its standardised features times ``weights``; ``threshold`` splits margins."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = ((rows - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, penalty: float = 1e-3, rounds: int = 300) -> Ranking:
    """Weights from all pairs of a good and a bad row. Without one of the classes every row scores alike,
    at the threshold if all are good and below it if all are bad."""
    both = np.concatenate([good, bad])
    mean, scale = (both.mean(axis=0), both.std(axis=0) + 1e-3) if len(both) else (np.zeros(both.shape[1]), np.ones(both.shape[1]))
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(both.shape[1]), 1.0 if len(bad) else -1.0)
    x, y = (good - mean) / scale, (bad - mean) / scale
    # Nesterov steps on the mean loss; its curvature is at most a quarter of the largest squared difference.
    step = 4 / (((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + x.var(axis=0).sum() + y.var(axis=0).sum() + penalty)
    w = ahead = np.zeros(x.shape[1])
    for i in range(rounds):
        lost = 1 / (1 + np.exp(np.clip((x @ ahead)[:, None] - (y @ ahead)[None, :], -50, 50)))
        gradient = (lost.sum(axis=0) @ y - lost.sum(axis=1) @ x) / lost.size + penalty * ahead
        new = ahead - step * gradient
        ahead = new + i / (i + 3) * (new - w)
        w = new
    # The classes are sampled apart, so each margin stands for its class's share of all labels.
    margins = np.concatenate([x @ w, y @ w])
    weight = np.concatenate([np.full(len(x), (1 - bad_share) / len(x)), np.full(len(y), bad_share / len(y))])
    order = np.argsort(margins, kind="stable")
    k = int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-9))
    k = min(k, len(order) - 2) if len(order) > 1 else 0
    threshold = (margins[order[k]] + margins[order[min(k + 1, len(order) - 1)]]) / 2
    return Ranking(mean, scale, w, float(threshold))


def _labelled_features():
    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(text).tolist() for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({"quality": batch.column(0), "x": pa.array(rows, pa.list_(pa.float64()))})

    return apply


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    sample: int = 1500,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Ranking:
    """A ranking learned from the ``usable`` rows of ``labels`` (a condition on the id) with label 0 or 1."""
    known = labels.where(usable & F.col(label_col).isin(_GOOD, _BAD)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality")
    )
    counts = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    # Spark keeps the first rows of every task only; the result has 2 * sample rows at most.
    first = lambda label: known.where(F.col("quality") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = F.broadcast(first(_GOOD).union(first(_BAD)).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = map_batches(texts.select("quality", "text"), _labelled_features, "quality int, x array<double>").toArrow()
    label = rows.column("quality").to_numpy()
    x = np.array(rows.column("x").to_pylist()).reshape(-1, len(features("")))
    # Rows come in any order; sums of floating-point numbers should not.
    order = np.lexsort(np.round(x, 12).T[::-1]) if len(x) else np.empty(0, np.int64)
    x, label = x[order], label[order]
    total = sum(counts.values())
    return fit(x[label == _GOOD], x[label == _BAD], counts.get(_BAD, 0) / total if total else 0.0)


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)``, one row per row of ``docs``; the id keeps its name. NULL texts score as
    empty ones do. Only the text is looked at; ids may be NULL or repeated."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([features(text) for text in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(ranking.scores(rows))})

        return apply

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(texts, start, f"id {kind}, score double").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labelled rows that are not held out, score all: :func:`score` and ``held_out``."""
    ranking = train(docs, labels, ~held_out(id_col), id_col=id_col, text_col=text_col)
    return score(docs, ranking, id_col, text_col).withColumn("held_out", held_out(id_col))
