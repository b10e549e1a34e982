"""Boosted trees with monotone constraints, and PDs pooled between segments."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boosting, decide, models, pooled, shapley


def auc(pairs):
    good, bad = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    ranks = np.argsort(np.argsort(np.array(good + bad)))
    return (ranks[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def curved(spark):
    """Defaults rise with x in a step, fall with z, and swing with w; some values are missing."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        x, z, w = rng.random(), rng.random(), rng.random()
        p = 0.05 + 0.35 * (x > 0.6) + 0.2 * (1 - z) + 0.25 * (abs(w - 0.5) < 0.2)
        rows.append((i, None if i % 50 == 0 else x, float("nan") if i % 75 == 1 else z, w, int(rng.random() < p)))
    return spark.createDataFrame(rows, "id int, x double, z double, w double, y int").cache()


SIGNS = {"x": 1, "z": -1}


@pytest.fixture(scope="module")
def boosted(curved):
    return boosting.fit(curved, ["x", "z", "w"], "y", SIGNS, trees=12)


def test_boosted_trees_are_monotone(boosted):
    rng = np.random.default_rng(1)
    for j, sign in ((0, 1), (1, -1)):
        for point in rng.random((30, 3)):
            grid = np.repeat(point[None], 60, axis=0)
            grid[:, j] = np.linspace(-0.2, 1.2, 60)
            assert (sign * np.diff(boosted.margin(boosted.bins(grid))) >= 0).all()
    line = np.full((60, 3), 0.5)
    line[:, 2] = np.linspace(0, 1, 60)
    steps = np.diff(boosted.margin(boosted.bins(line)))
    assert (steps > 0).any() and (steps < 0).any(), "a free feature may go both ways"


def test_boosting_beats_the_signed_logistic(curved, boosted):
    labels = {r.id: r.y for r in curved.collect()}
    trees = [(r.score, labels[r.id]) for r in boosting.score(boosted, curved, "id").collect()]
    line = models.probability(models.monotone_pd(curved, ["x", "z", "w"], "y", SIGNS), curved, ["x", "z", "w"], "score").select("id", "score")
    assert len(trees) == 3000 and auc(trees) > auc([(r.score, labels[r.id]) for r in line.collect()]) + 0.02
    assert sum(p for p, _ in trees) == pytest.approx(sum(labels.values()), rel=0.03)


def test_boosting_does_not_depend_on_partitions(curved, boosted):
    again = boosting.fit(curved.repartition(5), ["x", "z", "w"], "y", SIGNS, trees=3)
    for a, b in zip(again.trees, boosted.trees, strict=False):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_boosting_without_rows_or_splits(spark):
    empty = spark.createDataFrame([], "id int, x double, y int")
    assert boosting.score(boosting.fit(empty, ["x"], "y", {}), empty, "id").count() == 0
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(60)], "id int, x double, y int")
    assert [round(r.score, 6) for r in boosting.score(boosting.fit(same, ["x"], "y", {"x": 1}), same, "id").collect()] == [0.5] * 60


@pytest.fixture(scope="module")
def segments(spark):
    """Eight segments with rates of their own, one of four rows that all defaulted, and a null one."""
    rng = random.Random(9)
    rows = []
    for s in range(8):
        for _ in range(500):
            x = rng.gauss(0, 1)
            rows.append((len(rows), s if s < 7 else None, x, int(rng.random() < 1 / (1 + math.exp(-(-2 + 0.3 * (s - 3.5) + 0.8 * x))))))
    rows += [(len(rows) + i, 99, 0.0, 1) for i in range(4)]
    return spark.createDataFrame(rows, "id int, s int, x double, y int").cache()


@pytest.fixture(scope="module")
def fitted(segments):
    return pooled.fit(segments, ["x"], "s", "y")


def test_pooled_mode_is_that_of_a_plain_loop(segments, fitted):
    rows = segments.collect()
    place = {k: i for i, k in enumerate(fitted.segments)}
    g, x, y = np.array([place[r.s] for r in rows]), np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    p = 1 / (1 + np.exp(-(fitted.intercepts[g] + fitted.shared[0] * x)))
    away = fitted.intercepts - fitted.shared[1]
    assert np.abs(np.bincount(g, y - p) - away / fitted.sigma**2).max() < 1e-3
    assert abs(((y - p) * x).sum() - fitted.shared[0]) < 1e-3 and abs(away.sum() / fitted.sigma**2 - fitted.shared[1] / 25) < 1e-3
    assert fitted.shared[0] == pytest.approx(0.8, abs=0.12) and 0.3 < fitted.sigma < 1.5


def test_sparse_segments_shrink(segments, fitted):
    a = dict(zip(fitted.segments, fitted.intercepts, strict=True))
    # alone, four defaults of four would have no finite intercept
    assert fitted.shared[1] < a[99] < fitted.shared[1] + 3 * fitted.sigma
    pd = {r.id: r.pd for r in pooled.predict(fitted, segments, "id", "s").collect()}
    for s in (0, 6, None):
        own = [r for r in segments.collect() if r.s == s]
        assert sum(pd[r.id] for r in own) / len(own) == pytest.approx(sum(r.y for r in own) / len(own), abs=0.03)


def test_draws_have_the_hessian_as_precision(fitted):
    a, b = fitted.draws(20000)
    s, d = len(fitted.segments), 1
    full = np.zeros((s + d + 1, s + d + 1))
    full[:s, :s] = np.diag(fitted.own)
    full[:s, s:], full[s:, :s] = fitted.cross, fitted.cross.T
    full[s:, s:] = fitted.schur + fitted.cross.T @ (fitted.cross / fitted.own[:, None])
    want = np.linalg.inv(full)
    got = np.cov(np.vstack([a[:s], b]))
    assert np.abs(got - want[: s + d, : s + d]).max() < 0.05 * want.diagonal()[: s + d].max()


def test_intervals_and_losses_by_draw(segments, fitted):
    few = segments.where("id % 97 = 0 or s = 99").withColumn("ead", F.lit(100.0))
    got = {r.id: r for r in pooled.intervals(fitted, few, "id", "s").collect()}
    a, b = fitted.draws(1000)
    place, total = {k: i for i, k in enumerate(fitted.segments)}, np.zeros(1000)
    for r in few.collect():
        p = 1 / (1 + np.exp(-(a[place[r.s]] + r.x * b[0])))
        total += 80 * p
        low, mid, high = np.quantile(p, [0.025, 0.5, 0.975])
        assert [got[r.id].mean, got[r.id].median, got[r.id].sd, got[r.id].low, got[r.id].high] == pytest.approx([p.mean(), mid, p.std(), low, high])
    wide, narrow = got[max(got)], got[0]
    assert wide.high - wide.low > narrow.high - narrow.low
    losses = {r.draw: r.loss for r in pooled.portfolio_losses(fitted, few, "s", "ead", 0.8).collect()}
    assert len(losses) == 1000 and np.allclose([losses[i] for i in range(1000)], total)
    other = few.withColumn("s", F.lit(1234))
    assert pooled.intervals(fitted, other, "id", "s").count() == few.count() == pooled.predict(fitted, other, "id", "s").count()


def plain_shapley(score, x, base):
    """Shapley values by the definition, over all coalitions."""
    d = len(x)
    v = lambda s: score([x[j] if j in s else base[j] for j in range(d)])
    out = []
    for j in range(d):
        rest, total = [i for i in range(d) if i != j], 0.0
        for bits in range(1 << (d - 1)):
            s = {rest[i] for i in range(d - 1) if bits >> i & 1}
            total += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (v(s | {j}) - v(s))
        out.append(total)
    return out


@pytest.mark.parametrize("exact", [10, 3])
def test_shapley_values(spark, exact):
    """Four features: exact by all coalitions; by the drawn design they still add up."""
    rng = random.Random(2)
    names, base = ["a", "b", "c", "d"], [0.5, 0.0, 1.0, 2.0]
    rows = [(i, *[rng.random() if rng.random() > 0.1 else None for _ in names]) for i in range(20)]
    plain = lambda v: v[0] * v[1] + 3 * v[2] - v[3] ** 2 + v[0] * v[2] * v[3]
    score = lambda d: d.withColumn("profit", F.col("a") * F.col("b") + 3 * F.col("c") - F.col("d") * F.col("d") + F.col("a") * F.col("c") * F.col("d"))
    got = {r.i: r for r in shapley.attributions(spark.createDataFrame(rows, "i int, a double, b double, c double, d double"), "i", names, score, dict(zip(names, base, strict=True)), exact=exact, drawn=64).collect()}
    assert len(got) == 20
    for i, *x in rows:
        x = [b if v is None else v for v, b in zip(x, base, strict=True)]
        phi = [got[i][f"phi_{n}"] for n in names]
        assert sum(phi) == pytest.approx(plain(x) - plain(base)) == pytest.approx(got[i].profit - got[i].base)
        assert phi == pytest.approx(plain_shapley(plain, x, base), abs=1e-9 if exact == 10 else 0.15)


def test_drawn_coalitions_of_many_features():
    masks, matrix = shapley.design(14, drawn=600)
    x = np.random.default_rng(3).normal(size=14)
    scores = np.array([sum(x[j] for j in range(14) if m >> j & 1) + 5.0 for m in masks])
    assert len(masks) <= 602 + 28 and matrix @ scores == pytest.approx(x), "a sum's attributions are its terms"


def test_thompson_draws_have_the_posterior(spark):
    rng = random.Random(12)
    log = spark.createDataFrame([(rng.randrange(2), rng.gauss(1, 1), rng.random()) for _ in range(200)], "arm int, r double, u double")
    statistics = decide.arm_statistics(log, "arm", "r", ["u"])
    got = decide.thompson_scores(spark.range(20000).withColumn("u", F.lit(0.5)), statistics, ["u"], "id").select(*[F.col("scores")[k]["score"].alias(f"s{k}") for k in (0, 1)], "arm").toPandas()
    for k in (0, 1):
        rows = [(r.r, r.u) for r in log.collect() if r.arm == k]
        x, y = np.array([(1.0, u) for _, u in rows]), np.array([v for v, _ in rows])
        covariance = np.linalg.inv(np.eye(2) + x.T @ x)
        at = np.array([1.0, 0.5])
        assert got[f"s{k}"].mean() == pytest.approx(at @ covariance @ x.T @ y, abs=0.004)
        assert got[f"s{k}"].var() == pytest.approx(at @ covariance @ at, rel=0.05)
    assert abs(got[["s0", "s1"]].corr().iloc[0, 1]) < 0.03 and set(got.arm) == {0, 1}


def test_softmax_draws_follow_the_means(spark):
    means = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "arm int, mean double")
    got = decide.softmax_arms(spark.range(20000), "id", means, temperature=0.8)
    want = np.exp(np.array([1.0, 3.0, 2.0]) / 0.8)
    want /= want.sum()
    counts = {r.arm: r["count"] / 20000 for r in got.groupBy("arm").count().collect()}
    assert [counts[k] for k in range(3)] == pytest.approx(list(want), abs=0.01) and list(got.first().probabilities) == pytest.approx(list(want))
