"""Outlier rules: groups of which a third is bad, and the estimate against its definition."""

import math
import random

import numpy as np
import pytest

from sparktrace.llm import outliers


@pytest.mark.parametrize("bad", [lambda w: w + "###", lambda w: w.upper()])
def test_a_third_of_a_group_is_bad_copies(spark, bad):
    draw = random.Random(4)
    word = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(draw.choice(word) for _ in range(draw.randrange(60, 200))), "en", "s") for i in range(400)]
    copy = " ".join(bad(draw.choice(word)) for _ in range(100))
    rows += [(1000 + i, copy, "en", "s") for i in range(200)]
    found = {r["doc_id"]: r["kept"] for r in outliers.outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sum(found[i] for i in range(400)) >= 396 and not any(found[1000 + i] for i in range(200))


def plain_estimate(x):
    """Concentration steps by the definition: the nearest rows of a group until the determinant stands still, then one reweighting step."""
    dim, n = x.shape[1], len(x)
    floors = np.diag(np.square(outliers.FLOORS))

    def quantile(values, share):
        return np.sort(values)[max(0, math.ceil(share * len(values) - 1e-9) - 1)]

    def distance(centre, covariance):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(covariance), x - centre)

    centre = np.array([quantile(c, 0.5) for c in x.T])
    covariance = np.diag([(1.4826 * quantile(np.abs(c - m), 0.5)) ** 2 for c, m in zip(x.T, centre, strict=True)]) + floors
    share = (max(0, min(50, math.ceil(50 * (n + dim + 1) / n) - 50)) + 50) / 100
    old = None
    while True:
        d = distance(centre, covariance)
        near = x[d <= quantile(d, share)]
        centre, covariance = near.mean(axis=0), outliers.consistency_of(share) * np.cov(near.T, bias=True) + floors
        volume = np.linalg.slogdet(covariance)[1]
        if old is not None and volume >= old - outliers.LEAST_FALL * abs(old):
            break
        old = volume
    near = x[distance(centre, covariance) <= outliers.chi_square_quantile(outliers.REWEIGHT, dim)]
    return near.mean(axis=0), outliers.consistency_of(outliers.REWEIGHT) * np.cov(near.T, bias=True) + floors


def test_estimate_equals_the_definition(spark):
    """Groups that need different numbers of steps, one with two fifths of bad rows, do not disturb each other."""
    draw = np.random.default_rng(3)
    groups = {}
    for name, n, bad in (("a", 60, 0), ("b", 151, 60), ("c", 400, 90), ("d", 53, 5)):
        x = draw.normal(size=(n, 5)) * np.array([2, 0.5, 1, 0.3, 0.2]) + draw.normal(size=5)
        x[:bad] = x[:bad] * 0.3 + np.array([9, 4, 0, 3, 2])
        groups[name] = x.round(3)
    rows = [(name, *map(float, r)) for name, x in groups.items() for r in x]
    made = outliers.estimates(spark.createDataFrame(rows, "judged string, x0 double, x1 double, x2 double, x3 double, x4 double")).collect()
    assert len(made) == len(groups)
    for row in made:
        centre, covariance = plain_estimate(groups[row["judged"]])
        assert row["centre"] == pytest.approx(centre.tolist(), abs=1e-8)
        factor = np.array(row["factor"]).reshape(5, 5)
        assert np.linalg.inv(factor.T @ factor) == pytest.approx(covariance, abs=1e-8)
