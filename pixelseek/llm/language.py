"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are counts of character 1- to ``ORDER``-grams of the lower-cased text (with a space before and after it),
hashed to ``DIM`` columns, weighted (1 + log tf) x idf and scaled to length one. Document frequencies come from all
rows to learn from. Weights are learned by follow-the-regularised-leader with elastic-net penalties on at most
``MAX_SAMPLE`` rows, chosen by the hash of their ids; the last fifth of them is left out of training and sets the
temperature that divides the scores.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null lang is not learned from; without
any row to learn from every text is ``und``; whole texts count, long ones piece by piece; rows that repeat an id are
scored one by one; an empty table gives an empty table; columns of other names are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.llm.common import gathered

DIM = 1 << 15
ORDER = 3
#: Rows that weights are fitted on.
MAX_SAMPLE = 6000
UNKNOWN = "und"

_PIECE = 1 << 20
# A character of a Unicode category L; the re module's classes also take numbers such as ½ and ① for letters.
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and their counts; memory is bounded by pieces."""
    text = f" {text.lower()} "
    total = np.zeros(DIM, dtype=np.int64)
    for start in range(0, len(text), _PIECE):
        # Neighbouring pieces share ORDER - 1 characters, of which only longer n-grams are counted again: none twice.
        piece = text[max(0, start - ORDER + 1) : start + _PIECE]
        cps = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = min(start, ORDER - 1)
        h = np.zeros(len(cps), dtype=np.uint32)
        for n in range(ORDER):
            # h[i] covers the n + 1 characters that end at i.
            h = (np.concatenate(([0], h[:-1])).astype(np.uint32) if n else h) * _MULTIPLIERS[3] + (
                cps * _MULTIPLIERS[0] + np.uint32(n)
            )
            ends = h[max(first, n) :]
            total += np.bincount((ends ^ (ends >> 15)) * _MULTIPLIERS[1] >> 17, minlength=DIM)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx]


def _weighted(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(counts)) * idf[idx]
    return v / max(np.sqrt(v @ v), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed n-gram stands: added up in the tasks, then over the columns."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df[gram_counts(text)[0]] += 1
                n += 1
        df[DIM] = n
        yield pd.DataFrame({"df": [df.tolist()]})

    parts = texts.select("text").mapInPandas(count, "df array<long>")
    summed = parts.select(F.posexplode("df").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, dtype=np.int64)
    for r in summed:
        df[r["i"]] = r["n"]
    return df[:DIM], int(df[DIM])


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        idx, counts = gram_counts(text)
        scores = (self.weights[:, idx] @ _weighted(idx, counts, self.idf) + self.bias) / self.temperature
        p = np.exp(scores - scores.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    classes: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x DIM) and biases by per-coordinate FTRL-proximal steps; column DIM is the bias."""
    z, n = np.zeros((classes, DIM + 1)), np.zeros((classes, DIM + 1))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for (idx, v), label in zip(rows, y):
            at, x = np.append(idx, DIM), np.append(v, 1.0)
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = p[:, None] * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[:, at] = zi + g - sigma * w
            n[:, at] = ni + g * g
    w = weights(z, n)
    return w[:, :DIM], w[:, DIM]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss."""

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.02, 10.0, 120), key=loss) if len(y) else 1.0


def fit(train: DataFrame, max_sample: int = MAX_SAMPLE) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows without text or lang are left out (for the weights, also those without id)."""
    train = train.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequencies(train)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    chosen = train.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(order, "doc_id").limit(max_sample)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [gram_counts(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "h": batch["h"],
                    "lang": batch["lang"],
                    "idx": [i.tobytes() for i, _ in grams],
                    "v": [_weighted(i, c, idf).astype(np.float32).tobytes() for i, c in grams],
                }
            )

    features = (
        train.join(F.broadcast(chosen), "doc_id", "left_semi")
        .select("text", "lang", order.alias("h"))
        .mapInPandas(featurise, "h long, lang string, idx binary, v binary")
    )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = gathered(batches)
        if sample.empty:
            return
        sample = sample.sort_values(["h", "lang"], kind="stable").head(max_sample)
        langs = sorted(sample["lang"].unique())
        y = sample["lang"].map(langs.index).to_numpy()
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(sample["idx"], sample["v"])]
        cut = max(1, len(rows) * 4 // 5)
        w, b = fit_ftrl(rows[:cut], y[:cut], len(langs))
        scores = np.array([w[:, i] @ v + b for i, v in rows[cut:]]).reshape(-1, len(langs))
        yield pd.DataFrame(
            {
                "lang": langs,
                "w": [x.astype(np.float32).tobytes() for x in w],
                "b": b,
                "t": temperature(scores, y[cut:]),
            }
        )

    rows = features.repartition(1).mapInPandas(learn, "lang string, w binary, b double, t double").collect()
    rows.sort(key=lambda r: r["lang"])
    return LanguageModel(
        [r["lang"] for r in rows],
        np.array([np.frombuffer(r["w"], np.float32) for r in rows]),
        np.array([r["b"] for r in rows]),
        idf,
        rows[0]["t"] if rows else 1.0,
    )


def predict(model: LanguageModel, text: Column) -> Column:
    """struct<lang, score> of a text column."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    # Not deterministic only in name: so that a filter on it doesn't run it twice.
    return tell.asNondeterministic()(text)


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.4) -> DataFrame:
    """Rows whose language is known: not ``und``, and not all languages in doubt by the calibrated score."""
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_t"))
    told = told.select("row", predict(model, F.col("_t")).alias("p"))
    return told.filter((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= min_score)).select("row.*")
