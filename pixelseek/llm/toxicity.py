"""Toxicity: cumulative-link ordinal regression on sparse text features.

Labels say toxic or not. Features are the words, and beginnings of words, that go with the label beyond chance. Severity
grades 1 to 3 of the toxic texts come from the labelled sample itself: those features are weighed by log odds, and the
toxic texts that hold any are cut into thirds by their share. Then P(grade > k) = sigmoid(w x - t_k) with one weight
vector for all ordered thresholds t_0 < t_1 < t_2, fitted by proximal gradient steps with an L1 penalty. A feature's
value is 1 + log(1 + 100 x its share of the text's words).

The model is fitted on at most ``MAX_SAMPLE`` labelled rows, chosen by the hash of their ids; scoring reads all texts
whole.

Defined cases: null and empty texts have no words and get what the thresholds alone say; rows that repeat an id are
scored one by one; of several labels of an id the largest counts; without labelled rows every score is 0; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import gathered

#: Labelled rows that the model is fitted on, and features it may use.
MAX_SAMPLE = 8000
MAX_FEATURES = 20_000
#: Lengths of word beginnings.
BEGINNINGS = (4, 9)
GRADES = 4
#: A feature must stand in so many texts of the sample, and go with the label by a G statistic of so much.
MIN_TEXTS = 4
MIN_G = 25.0

_WORD = re.compile(r"[^\W\d_]+")


def feature_counts(text: str | None, known: Set[str] | None = None) -> tuple[Counter, int]:
    """Words and word beginnings (marked by a dash) with their counts, and the number of words."""
    words = _WORD.findall((text or "").lower())
    out: Counter = Counter()
    for w, c in Counter(words).items():
        if known is None:
            out[w] += c
            for k in range(*BEGINNINGS):
                if len(w) > k:
                    out[w[:k] + "-"] += c
        else:
            if w in known:
                out[w] += c
            for k in range(*BEGINNINGS):
                if len(w) > k and w[:k] + "-" in known:
                    out[w[:k] + "-"] += c
    return out, len(words)


def _value(count: int, n: int) -> float:
    return 1.0 + np.log1p(100.0 * count / n)


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str | None) -> tuple[float, float, int]:
        """P(grade > 0), expected severity 0 to 3, likeliest grade."""
        if not len(self.thresholds):
            return 0.0, 0.0, 0
        hits, n = feature_counts(text, self.weights.keys())
        s = sum(self.weights[w] * _value(c, n) for w, c in hits.items())
        above = 1.0 / (1.0 + np.exp(np.clip(self.thresholds - s, -50, 50)))
        p = np.append(1.0, above) - np.append(above, 0.0)
        return float(above[0]), float(above.sum()), int(p.argmax())


def telling_features(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Features whose presence goes with the label beyond chance (G test), with their log odds."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    seen = {0: Counter(), 1: Counter()}
    for text, t in zip(texts, toxic):
        seen[int(t)].update(feature_counts(text)[0].keys())
    out = {}
    for w in seen[0].keys() | seen[1].keys():
        a, b = seen[1][w], seen[0][w]
        if a + b < MIN_TEXTS:
            continue
        g = 2 * sum(x * np.log(x * (n1 + n0) / ((a + b) * n)) for x, n in ((a, n1), (b, n0)) if x)
        if g > MIN_G:
            out[w] = float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    return out


def severity_grades(counts: list[tuple[Counter, int]], toxic: np.ndarray, odds: dict[str, float]) -> np.ndarray:
    """0 for texts not toxic, 1 to 3 by the share of words that speak for the label."""
    share = np.array(
        [sum(max(0.0, odds.get(w, 0.0)) * c for w, c in words.items()) / max(n, 1) for words, n in counts]
    )
    telling = share[(toxic == 1) & (share > 0)]
    cuts = np.quantile(telling, [1 / 3, 2 / 3]) if len(telling) else [np.inf, np.inf]
    return np.where(toxic == 1, 1 + (share > cuts[0]).astype(int) + (share > cuts[1]), 0)


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, steps: int = 800, l1: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, from coordinates of a sparse matrix."""
    n = len(y)
    # Thresholds are a first value and positive gaps.
    w, first, gaps = np.zeros(width), 1.0, np.zeros(GRADES - 2)
    # Steps scaled by each column's weight in the data.
    scale = np.bincount(cols, weights=x * x, minlength=width) / n + 1e-3
    h = {"w": np.zeros(width), "t": np.zeros(GRADES - 1)}
    for _ in range(steps):
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        s = np.bincount(rows, weights=w[cols] * x, minlength=n)
        above = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -50, 50)))
        bounds = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        p = np.maximum(bounds[np.arange(n), y] - bounds[np.arange(n), y + 1], 1e-9)
        slope = bounds * (1 - bounds)
        # d -log p / ds, and through each threshold.
        ds = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / p / n
        dt = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            dt[k] = (slope[y == k + 1, k + 1] / p[y == k + 1]).sum() / n - (slope[y == k, k + 1] / p[y == k]).sum() / n
        gw = np.bincount(cols, weights=x * ds[rows], minlength=width) / np.sqrt(scale)
        h["w"] = 0.9 * h["w"] + gw
        w = w - 0.5 * h["w"] / np.sqrt(scale)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * l1 / scale, 0)
        g = np.append(dt.sum(), [dt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)])
        h["t"] = 0.9 * h["t"] + g
        first, gaps = first - 0.5 * h["t"][0], np.clip(gaps - 0.5 * h["t"][1:], -5, 5)
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def _learn(sample: pd.DataFrame) -> ToxicityModel:
    toxic = sample["toxic"].to_numpy().astype(int)
    odds = telling_features(list(sample["text"]), toxic)
    best = sorted(odds, key=lambda w: (-abs(odds[w]), w))[:MAX_FEATURES]
    vocabulary = {w: i for i, w in enumerate(best)}
    counts = [feature_counts(t, vocabulary.keys()) for t in sample["text"]]
    y = severity_grades(counts, toxic, odds)
    at = [
        (r, vocabulary[w], _value(c, n))
        for r, (words, n) in enumerate(counts)
        for w, c in words.items()
    ]
    if not at:
        at = [(0, 0, 0.0)]
    rows, cols, x = (np.array(a) for a in zip(*at))
    w, t = fit_ordinal(rows.astype(int), cols.astype(int), x, y, max(1, len(vocabulary)))
    return ToxicityModel({word: float(w[i]) for word, i in vocabulary.items() if w[i] != 0}, t)


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> ToxicityModel:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic 0 or 1)."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    chosen = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(order, "doc_id")
        .limit(max_sample)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = gathered(batches)
        if rows.empty:
            return
        model = _learn(rows.sort_values(["h", "text"], kind="stable").head(max_sample))
        yield pd.DataFrame(
            {
                "words": [list(model.weights)],
                "weights": [list(model.weights.values())],
                "thresholds": [model.thresholds.tolist()],
            }
        )

    got = (
        sample.select(order.alias("h"), F.coalesce("text", F.lit("")).alias("text"), "toxic")
        .repartition(1)
        .mapInPandas(learn, "words array<string>, weights array<double>, thresholds array<double>")
        .collect()
    )
    if not got:
        return ToxicityModel({}, np.zeros(0))
    return ToxicityModel(dict(zip(got[0]["words"], got[0]["weights"])), np.array(got[0]["thresholds"]))


def score(model: ToxicityModel, text: Column) -> Column:
    """struct<p_toxic, severity, grade> of a text column."""

    @F.pandas_udf("p_toxic double, severity double, grade int")
    def tell(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in texts], columns=["p_toxic", "severity", "grade"])

    return tell.asNondeterministic()(text)
