"""The fitted models against plain forms of their own."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def plain_em(votes, prior, rounds, smooth):
    """EM row by row: one weight for every document, no patterns, no logarithms."""
    votes = np.asarray(votes)
    like = np.array([[[0.03, 0.17, 0.8], [0.4, 0.2, 0.4]]] * votes.shape[1])
    cols = np.arange(votes.shape[1])
    for _ in range(rounds):
        good = np.full(len(votes), prior)
        bad = np.full(len(votes), 1 - prior)
        for r in cols:
            cast = votes[:, r] != 0
            good[cast] *= like[r, 0, votes[cast, r] + 1]
            bad[cast] *= like[r, 1, votes[cast, r] + 1]
        p = good / (good + bad)
        for r in cols:
            for side, w in ((0, p), (1, 1 - p)):
                seen = np.array([smooth + w[votes[:, r] == v].sum() for v in (-1, 0, 1)])
                like[r, side] = seen / seen.sum()
    return like


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.8
    rows = []
    for g in good:
        p = [0.05, 0.15, 0.8] if g else [0.7, 0.15, 0.15]
        rows.append(tuple(int(v) for v in rng.choice([-1, 0, 1], size=5, p=p)))
    return good, rows


def test_fit_equals_plain_em(planted):
    _, rows = planted
    counted = [(k, len(list(g))) for k, g in itertools.groupby(sorted(rows))]
    model = quality.fit(counted, 5, rounds=30)
    like = plain_em(rows, 0.8, 30, 1.0)
    for r, (bad, absent, good) in enumerate(model.weights):
        assert absent == 0.0
        assert bad == pytest.approx(min(0.0, np.log(like[r, 0, 0] / like[r, 1, 0])), abs=1e-6)
        assert good == pytest.approx(max(0.0, np.log(like[r, 0, 2] / like[r, 1, 2])), abs=1e-6)


def test_posterior_finds_the_planted_class(spark, planted):
    good, rows = planted
    counted = [(k, len(list(g))) for k, g in itertools.groupby(sorted(rows))]
    model = quality.fit(counted, 5)
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(rows)], "i int, v array<int>")
    got = {r["i"]: r["p"] for r in df.select("i", model.posterior(F.col("v")).alias("p")).collect()}
    right = np.mean([(got[i] >= 0.5) == g for i, g in enumerate(good)])
    assert right > 0.95
    for i in range(50):
        odds = np.log(0.8 / 0.2) + sum(model.weights[r][v + 1] for r, v in enumerate(rows[i]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_no_documents():
    assert quality.fit([], 3).weights == ((0.0, 0.0, 0.0),) * 3
