"""Quality by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other rows to learn from are unlabelled, whatever their label. A linear model
on text features minimises the non-negative unbiased risk with logistic loss,

    prior * R+(positives as positive) + max(0, R-(unlabelled as negative) - prior * R-(positives as negative)).

The class prior is estimated from the same two samples: where only positives live, the density ratio of positives to
unlabelled is 1 / prior, so the prior is the median inverse ratio, by a held-out part of the positives, of a classifier
of positives against unlabelled.

Features, over the whole text: square roots of the shares of 1- to 3-grams of character classes (hashed), and shape
numbers: length, share of letters, capitals, digits, spaces and symbols, word length, repeated lines, distinct words,
words said twice.

The model is fitted on at most ``MAX_SAMPLE`` positives and as many unlabelled rows, chosen by the hash of their ids;
scoring reads all texts whole. Defined cases: null and empty texts have zero features and a score like any other;
several labels of an id count as its largest; without positives every score is 0.5; rows that repeat an id are scored
one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import gathered

#: Rows of each kind that the model is fitted on.
MAX_SAMPLE = 4000
HASHED = 512
SHAPE = 13
WIDTH = HASHED + SHAPE

_PIECE = 1 << 20
_SPACES = re.compile(r"\s+")


def _class_table() -> np.ndarray:
    """Classes of Latin-1: 0 letter, 1 capital, 2 digit, 3 space, 4 line end, from 6 each sign; what is beyond: letter."""
    table = np.zeros(256, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if c == "\n":
            table[i] = 4
        elif c.isspace():
            table[i] = 3
        elif c.isdigit():
            table[i] = 2
        elif c.isalpha():
            table[i] = 1 if c.isupper() else 0
        else:
            table[i] = 6 + i % 128
    return table


_TABLE = _class_table()


def features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.float32)
    text = text or ""
    if not text:
        return out
    grams = np.zeros(HASHED, dtype=np.int64)
    kinds = np.zeros(256, dtype=np.int64)
    for start in range(0, len(text), _PIECE):
        cps = np.frombuffer(text[start : start + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.where(cps < 256, _TABLE[np.minimum(cps, 255)], 0).astype(np.uint32)
        kinds += np.bincount(c, minlength=256)
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(3):
            h = (np.concatenate(([0], h[:-1])).astype(np.uint32) if n else h) * np.uint32(0x27D4EB2F) + (
                (c + np.uint32(1 + 256 * n)) * np.uint32(0x9E3779B1)
            )
            ends = h[n:]
            grams += np.bincount(((ends ^ (ends >> 15)) * np.uint32(0x85EBCA77)) >> 23, minlength=HASHED)
    out[:HASHED] = np.sqrt(grams / max(1, grams.sum()))
    words = _SPACES.split(text.lower().strip())
    lines = [x for x in text.split("\n") if x]
    total = len(text)
    signs = int(kinds[5:].sum())
    out[HASHED:] = [
        1.0,
        np.log1p(total) / 10,
        kinds[0] / total,
        kinds[1] / total,
        kinds[2] / total,
        kinds[3] / total,
        min(1.0, 5 * signs / total),
        min(1.0, kinds[4] * 20 / total),
        min(2.0, sum(map(len, words)) / max(1, len(words)) / 8),
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / max(1, len(words)),
        np.log1p(len(words)) / 10,
        sum(map(str.__eq__, words, words[1:])) / max(1, len(words)),
    ]
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def _descend(gradient, width: int, steps: int, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias)."""
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, l2: float = 1e-3) -> float:
    """Share of positives among the unlabelled rows."""
    cut = max(1, len(positive) * 2 // 3)
    x = np.vstack([positive[:cut], unlabelled])
    y = np.append(np.ones(cut), np.zeros(len(unlabelled)))
    weight = np.append(np.full(cut, 0.5 / cut), np.full(len(unlabelled), 0.5 / len(unlabelled)))

    def gradient(w: np.ndarray) -> np.ndarray:
        d = (_sigmoid(x @ w[:-1] + w[-1]) - y) * weight
        return np.append(x.T @ d + l2 * w[:-1], d.sum())

    w, b = _descend(gradient, x.shape[1], steps)
    held = positive[cut:] if len(positive) > cut else positive
    ratio = np.exp(np.clip(held @ w + b, -20, 20))
    return float(np.clip(np.median(1 / ratio), 0.05, 0.95))


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, l2: float = 1e-4
) -> QualityModel:
    width = positive.shape[1]

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        negative_part = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        dp, du = _sigmoid(sp) / len(sp), _sigmoid(su) / len(su)
        if negative_part >= 0:
            gp, gu = prior * (_sigmoid(sp) - 1) / len(sp) - prior * dp, du
        else:
            # The risk of negatives cannot be below zero: step back out of the overfit.
            gp, gu = prior * dp, -du
        return np.append(positive.T @ gp + unlabelled.T @ gu + l2 * w[:-1], gp.sum() + gu.sum())

    w, b = _descend(gradient, width, steps)
    return QualityModel(w, b, prior)


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> QualityModel:
    """Learn from documents (doc_id, text) and the labels (doc_id, quality) that are 1."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    trusted = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1 AND doc_id IS NOT NULL")
    positive = trusted.orderBy(order, "doc_id").limit(max_sample).select("doc_id", F.lit(1).alias("positive"))
    other = F.xxhash64(F.col("doc_id").cast("string"), F.lit("unlabelled"))
    unlabelled = (
        docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(other, "doc_id").limit(max_sample)
    ).select("doc_id", F.lit(0).alias("positive"))
    sample = docs.select("doc_id", "text").join(F.broadcast(positive.union(unlabelled)), "doc_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "positive": batch["positive"], "x": rows})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = gathered(batches)
        if rows.empty:
            return
        rows = rows.sort_values(["h", "positive", "x"], kind="stable")
        kinds = [
            np.array([np.frombuffer(b, np.float32) for b in rows.loc[rows["positive"] == k, "x"][:max_sample]])
            for k in (1, 0)
        ]
        if not len(kinds[0]) or not len(kinds[1]):
            return
        # Columns of equal spread, so that steps suit all of them.
        mean, spread = kinds[1].mean(axis=0), kinds[1].std(axis=0) + 1e-3
        scaled = [(k - mean) / spread for k in kinds]
        model = fit_nnpu(*scaled, estimate_prior(*scaled))
        weights = model.weights / spread
        model = QualityModel(weights, model.bias - float(mean @ weights), model.prior)
        yield pd.DataFrame({"w": [model.weights.tolist()], "b": [model.bias], "prior": [model.prior]})

    got = (
        sample.select(order.alias("h"), "positive", "text")
        .mapInPandas(featurise, "h long, positive int, x binary")
        .repartition(1)
        .mapInPandas(learn, "w array<double>, b double, prior double")
        .collect()
    )
    if not got:
        return QualityModel(np.zeros(WIDTH), 0.0, 0.5)
    return QualityModel(np.array(got[0]["w"]), got[0]["b"], got[0]["prior"])


def score(model: QualityModel, text: Column) -> Column:
    """P(good) of a text column."""

    @F.pandas_udf("double")
    def tell(texts: pd.Series) -> pd.Series:
        return pd.Series([float(model.scores(features(t))) for t in texts], dtype="float64")

    return tell.asNondeterministic()(text)
