"""Classifiers: their parts by hand, and held-out accuracy on planted tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.llm import language, quality, toxicity
from pixelseek.llm.common import id_remainder
from tests.llm.helpers import clash, docs, rows

STEMS = {"en": "the and ing tion er of".split(), "de": "der und ung sch ein über".split(), "es": "el ción que ado ñ la".split()}


#: No letters, though some are numbers that look like them.
NO_LETTERS = [(1010 + i, t, "en", "s") for i, t in enumerate(["½ ½", "①", "Ⅷ", "²", "٣"])]


def words(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, words(rng, lang, rng.randint(1, 60)), lang, f"s{i % 3}") for i in range(n) for lang in [rng.choice(list(STEMS))]]


AWKWARD = [(1000, None, "en", "s"), (1001, "", None, None), (1002, "123 !? _", "en", "s"), (None, "der und", "de", "s")]


def test_gram_counts_by_pieces(monkeypatch):
    text = "Über den Wolken 日本 " * 30
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_PIECE", 7)
    pieces = language.gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, pieces))
    n = len(text) + 2
    assert whole[1].sum() == n + (n - 1) + (n - 2)


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows_, y = [], rng.integers(0, 3, 300)
    for label in y:
        rows_.append((np.array([label, 10 + rng.integers(0, 500)], dtype=np.int32), np.array([1.0, 1.0])))
    w, b = language.fit_ftrl(rows_, y, 3, l1=1.0)
    assert (w == 0).mean() > 0.97
    assert all((w[:, i] @ v + b).argmax() == label for (i, v), label in zip(rows_, y))


def test_temperature():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1], 4000)
    y = (rng.random(4000) < p[:, 1]).astype(int)
    assert abs(language.temperature(5 * np.log(p), y) - 5) < 1


def test_language(spark):
    d = clash(docs(spark, corpus() + AWKWARD + NO_LETTERS + corpus()[:1]), F)
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = language.fit(d.filter(~held))
    told = d.select("doc_id", "lang", held.alias("held"), language.predict(model, F.col("text")).alias("p")).collect()
    mine = [r for r in told if r["held"] and r["lang"] and (r["doc_id"] or 0) < 1000]
    assert np.mean([r["p"]["lang"] == r["lang"] for r in mine]) > 0.95
    assert all(0 <= r["p"]["score"] <= 1 for r in told)
    odd = {r["doc_id"]: tuple(r["p"]) for r in told if (r["doc_id"] or 0) >= 1000}
    assert len(odd) == 8 and set(odd.values()) == {("und", 0.0)}
    assert len([r for r in told if r["doc_id"] == 0]) == 2
    kept = language.keep_known(d, model)
    assert kept.columns == d.columns and not set(odd) & {r["doc_id"] for r in kept.collect()}
    assert kept.count() > 230


def test_language_without_rows(spark):
    model = language.fit(docs(spark, []))
    assert rows(docs(spark, [(1, "text", "en", "s")]).select(language.predict(model, F.col("text")).alias("p")), "p.lang") == [("und",)]
    assert language.keep_known(docs(spark, []), model).count() == 0


def toxic_corpus(n=400):
    rng = random.Random(2)
    table, labels = [], []
    for i in range(n):
        w = words(rng, "en", 40).split()
        bad = rng.choice([0, 0, 0, 1, 4, 12])
        for _ in range(bad):
            w[rng.randrange(len(w))] = rng.choice(["scum", "vermin", "filth"])
        table.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(rng.random() < 0.9), int(bad > 0)))
    return table, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    table, labels = toxic_corpus()
    d = clash(docs(spark, table + AWKWARD[:3] + [(None, "scum", "en", "s")] + table[:1]), F)
    lab = spark.createDataFrame(labels + labels[:2] + [(None, 1, 1), (1, None, None)], LABELS)
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(d, lab.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    told = d.select("doc_id", held.alias("held"), toxicity.score(model, F.col("text")).alias("p")).collect()
    truth = {i: t for i, _, t in labels}
    mine = [r for r in told if r["held"] and r["doc_id"] in truth]
    assert np.mean([(r["p"]["severity"] >= 0.5) == truth[r["doc_id"]] for r in mine]) > 0.95
    assert all(0 <= r["p"]["severity"] <= 3 and 0 <= r["p"]["p_toxic"] <= 1 for r in told)
    one, many = model.score("word " * 39 + "scum")[1], model.score("scum vermin filth " * 4 + "word " * 28)[1]
    assert many > one
    assert {r["p"]["grade"] for r in told if r["doc_id"] in (1000, 1001)} == {0}
    none = toxicity.fit(d, spark.createDataFrame([], LABELS))
    assert none.score("scum") == (0.0, 0.0, 0)


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = np.digitize(x[:, 0] * 4 + rng.logistic(size=600), [0, 2, 4])
    r, c = np.nonzero(x)
    w, t = toxicity.fit_ordinal(r, c, x[r, c], y, 2, l1=0.0)
    assert abs(w[0] - 4) < 1 and abs(w[1]) < 0.5 and np.allclose(t, [0, 2, 4], atol=0.8)


def test_quality(spark):
    rng = random.Random(4)
    table, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        w = words(rng, "en", rng.randint(20, 80)).split()
        if not good:
            w = [x + rng.choice(["***", "$$$", "%%%"]) for x in w]
        table.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(good), 0))
    d = clash(docs(spark, table + AWKWARD + table[:1]), F)
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(d.filter(~held), spark.createDataFrame(labels + [(None, 1, 0)], LABELS).filter(~held))
    assert abs(model.prior - 0.7) < 0.15
    told = d.select("doc_id", held.alias("held"), quality.score(model, F.col("text")).alias("s")).collect()
    truth = {i: q for i, q, _ in labels}
    mine = [r for r in told if r["held"] and r["doc_id"] in truth]
    assert np.mean([(r["s"] >= 0.3) == truth[r["doc_id"]] for r in mine]) > 0.95
    assert all(0 <= r["s"] <= 1 for r in told) and len(told) == len(table) + 5
    none = quality.fit(docs(spark, []), spark.createDataFrame([], LABELS))
    assert none.scores(np.zeros((1, quality.WIDTH))).tolist() == [0.5]


def test_nnpu_risk_is_not_negative():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (200, 30)), np.vstack([rng.normal(1, 1, (120, 30)), rng.normal(-1, 1, (80, 30))])
    prior = quality.estimate_prior(p, u)
    assert abs(prior - 0.6) < 0.15
    model = quality.fit_nnpu(p, u, prior)
    fresh = np.vstack([rng.normal(1, 1, (200, 30)), rng.normal(-1, 1, (200, 30))])
    assert np.mean((model.scores(fresh) > 0.5) == (np.arange(400) < 200)) > 0.95


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "é" * 100_000])
def test_quality_features(text):
    x = quality.features(text)
    assert x.shape == (quality.WIDTH,) and np.isfinite(x).all()
