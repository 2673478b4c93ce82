"""Forecast models on arrays: trees against a recursive learner, ARIMA against
a plain least-squares search, the unrolled factorisation against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import arima, trees


def grown_by_force(x, y, w, depth, least, rate=1.0):
    """Recursive tree over distinct values: (lag, cut, left, right) or a leaf."""
    total, whole = int(w.sum()), int((w * y).sum())
    best, found = float(whole) * whole / total, None
    for j in range(x.shape[1] if depth else 0):
        values = sorted({int(v) for v, n in zip(x[:, j], w, strict=True) if n})
        for a, b in zip(values, values[1:], strict=False):
            left = np.where(x[:, j] <= a, w, 0)
            nl, sl = int(left.sum()), int((left * y).sum())
            if nl >= least and total - nl >= least:
                score = float(sl) * sl / nl + float(whole - sl) * (whole - sl) / (total - nl)
                if score > best:
                    best, found = score, (j, a + b)
    if found is None:
        return int(np.rint(rate * whole / total))
    j, cut = found
    goes_right = 2 * x[:, j] > cut
    return j, cut, grown_by_force(x, y, np.where(goes_right, 0, w), depth - 1, least, rate), grown_by_force(x, y, np.where(goes_right, w, 0), depth - 1, least, rate)


def value_by_force(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if 2 * row[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize("depth, least", [(6, 1), (4, 3), (2, 8)])
def test_trees_equal_a_recursive_learner(depth, least):
    r = np.random.default_rng(depth)
    x, y = r.integers(0, 9, (3, 30, 6)), r.integers(-50, 50, (3, 30))
    w = trees.draws(7, 30)
    how = trees.Settings(7, depth, least)
    grown, of_rows = trees.grow(x, y, np.broadcast_to(w, (3, 7, 30)), how)
    probe = r.integers(-1, 10, (3, 6))
    got = grown.values(probe)
    for s in range(3):
        for t in range(7):
            want = grown_by_force(x[s], y[s], w[t], depth, least)
            assert got[s, t] == value_by_force(want, probe[s])
            assert all(of_rows[s, t, i] == value_by_force(want, x[s, i]) for i in range(30) if w[t, i])


def test_bootstrap_draws_as_many_rows():
    w = trees.draws(80, 24)
    assert (w.sum(1) == 24).all() and 0.55 < (w > 0).mean() < 0.72 and len({tuple(x) for x in w}) > 70


def test_boosting_needs_room_for_two_leaves():
    y = np.random.default_rng(0).integers(0, 10_000, (4, 36)) * trees.UNIT
    ahead, held = trees.paths(y, 3, 3, trees.HGB)  # 30 rows, leaves of 20
    assert (ahead == np.rint(y[:, 6:].sum(1) / 30)[:, None]).all()
    assert (held == np.rint(y[:, 6:-3].sum(1) / 27)[:, None]).all()
    step = np.where(np.arange(120) % 12 < 6, 100, 400) * trees.UNIT
    ahead, held = trees.paths(step[None, :], 12, 3, trees.HGB)
    assert (np.abs(ahead[0] / trees.UNIT - np.where(np.arange(120, 132) % 12 < 6, 100, 400)) < 30).mean() > 0.7


def test_boosted_steps_follow_the_residuals():
    r = np.random.default_rng(5)
    y = r.integers(0, 1000, (2, 40)) * trees.UNIT
    how = trees.Settings(6, 3, 4, 0.3, boosted=True)
    x, target = trees._windows(y, 6)[:, :-1], y[:, 6:]
    model = trees.Model(x, target, how)
    for s in range(2):
        now = np.full(34, int(np.rint(target[s].sum() / 34)))
        probe, total = y[s, -6:], int(np.rint(target[s].sum() / 34))
        for _ in range(6):
            res, best = target[s] - now, None
            tree = boosted_by_force(x[s], res, x[s], np.ones(34, int), 3, 4, 0.3)
            now = now + np.array([value_by_force(tree, v) for v in x[s]])
            total += value_by_force(tree, probe)
        assert model.predict(y[:, -6:])[s] == total and best is None


def boosted_by_force(x, y, every, w, depth, least, rate):
    """As ``grown_by_force``, with cuts half way to the next value of the fit."""
    tree = grown_by_force(x, y, w, 1 if depth else 0, least, rate)
    if not isinstance(tree, tuple):
        return tree
    j, cut = tree[:2]
    a = max(int(v) for v, n in zip(x[:, j], w, strict=True) if n and 2 * v <= cut)
    cut = a + min(int(v) for v in every[:, j] if v > a)
    right = 2 * x[:, j] > cut
    return j, cut, boosted_by_force(x, y, every, np.where(right, 0, w), depth - 1, least, rate), boosted_by_force(x, y, every, np.where(right, w, 0), depth - 1, least, rate)


# --- ARIMA -------------------------------------------------------------------------

def squares(w, p, q, s):
    e, total = 0.0, 0.0
    at = lambda i: w[i] if i >= 0 else 0.0
    for t in range(1, len(w)):
        e = at(t) - s * at(t - 12) - p * (at(t - 1) - s * at(t - 13)) - q * e
        total += e * e
    return total


def fitted(spark, series, seasonal):
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(series)], "i int, y array<double>")
    df = df.withColumn("w", F.expr(arima.differences("y"))).withColumn("est", F.expr(arima.estimated("w", seasonal)))
    df = df.withColumn("path", arima.forecasts([("y", "14"), ("y", "2")], seasonal)[0])
    return [x for x in df.orderBy("i").collect()]


def test_arima_is_the_least_squares_fit(spark):
    r = np.random.default_rng(9)
    series = []
    for p, q in ((0.6, 0.3), (-0.5, 0.2), (0.2, -0.6)):
        e, w = r.normal(0, 1, 80), [0.0]
        for t in range(1, 80):
            w.append(p * w[-1] + e[t] + q * e[t - 1])
        series.append(100 + np.cumsum(w))
    got = fitted(spark, series, False)
    grid = np.linspace(-0.98, 0.98, 50)
    for y, x in zip(series, got, strict=True):
        w = np.diff(y)
        least = min(squares(w, p, q, 0.0) for p in grid for q in grid)
        assert x.est.css == pytest.approx(squares(w, x.est.p, x.est.q, 0.0), rel=1e-9)
        assert x.est.css <= least * 1.02
        d = x.est.p * w[-1] + x.est.q * x.est.e
        assert x.path[0] == pytest.approx(y[-1] + d) and x.path[1] == pytest.approx(y[-1] + d + x.est.p * d)


def test_sarima_finds_the_season(spark):
    r = np.random.default_rng(2)
    season = r.normal(0, 10, 12)
    y = [50 + season[t % 12] + 0.2 * r.normal() for t in range(72)]
    a, b = fitted(spark, [y], False)[0], fitted(spark, [y], True)[0]
    want = [50 + season[t % 12] for t in range(72, 84)]
    assert b.est.s > 0.8 and b.est.css < 0.3 * a.est.css
    assert np.mean(np.abs(np.array(b.path[:12]) - want)) < 2 < np.mean(np.abs(np.array(a.path[:12]) - want))


def test_short_and_constant_series(spark):
    short, flat = fitted(spark, [[3, 5, 4, 6, 5, 7, 6, 8], [4.0] * 20], True)
    assert short.est.s == 0 and np.isfinite(short.path).all()
    assert flat.path == [4.0] * 14


def test_unrolled_factorisation(spark):
    r = np.random.default_rng(1)
    systems = []
    for _ in range(5):
        m = r.normal(size=(9, 6))
        systems.append((m.T @ m + np.eye(6) * 0.1, r.normal(size=6)))
    names = [f"a{i}{j}" for i in range(6) for j in range(i + 1)] + [f"b{i}" for i in range(6)]
    rows = [(k, *[float(a[i, j]) for i in range(6) for j in range(i + 1)], *map(float, b)) for k, (a, b) in enumerate(systems)]
    got = arima.solved(spark.createDataFrame(rows, ["k", *names]), 6, ["k"]).orderBy("k").collect()
    for x, (a, b) in zip(got, systems, strict=True):
        assert np.allclose(x[1:], np.linalg.solve(a, b))
