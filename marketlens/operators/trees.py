"""Regression trees on lagged values, one model per series (I7 ``rf``, I8
``hgb``): bagged deep trees, and boosted shallow ones.

The unit of work is one series, which is never longer than the training
window. Spark deals series to tasks by key; a task grows the trees of all its
series of one length together, level by level, with array operations over
(series, tree, row). No model is pooled, nothing is fitted in a driver loop and
a forecast is one Spark stage, however many trees there are.

Everything that decides a tree is whole numbers: values are millionths, sums of
values and counts are exact, a cut between two values is kept as their sum. A
score is one fixed formula of such sums, ties go to the oldest lag and then the
smallest cut, and a tree's bootstrap comes from hashes of (tree, draw). So the
same series gives the same trees on any partitioning, and in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNIT = 1_000_000
#: Larger values have no room in exact sums; such a series is an error row.
LARGEST = 1e11
#: Series whose trees are grown at once in a task.
BATCH = 32
SEED = 42


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least: int        # rows on either side of a cut (counted with their weights)
    rate: float = 1.0
    boosted: bool = False


# The model parameters (trees, depth, smallest leaf, rate).
RF = Settings(trees=80, depth=6, least=1)
HGB = Settings(trees=80, depth=4, least=20, rate=0.08, boosted=True)


def draws(trees: int, rows: int, seed: int = SEED) -> np.ndarray:
    """How often each tree draws each row: ``rows`` draws with replacement."""
    out = np.zeros((trees, rows), np.int64)
    for tree in range(trees):
        for k in range(rows):
            out[tree, int(hashlib.sha256(f"{seed}:{tree}:{k}".encode()).hexdigest()[:8], 16) % rows] += 1
    return out


@dataclass
class Trees:
    """Nodes in heap order, for (series, tree): the lag and the cut of a node
    that is split (lag -1: a leaf), and the value of a leaf."""

    lag: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """Leaf values (series, trees) for one row of lags per series."""
        at = np.zeros(self.lag.shape[:2], np.int64)
        while True:
            pick = lambda a: np.take_along_axis(a, at[..., None], 2)[..., 0]  # noqa: E731, B023
            lag, cut = pick(self.lag), pick(self.cut)
            inner = lag >= 0
            if not inner.any():
                return pick(self.leaf)
            right = 2 * np.take_along_axis(x, np.maximum(lag, 0), 1) > cut
            at = np.where(inner, 2 * at + 1 + right, at)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, how: Settings, apart: list | None = None) -> tuple[Trees, np.ndarray]:
    """Trees for lags x (series, rows, lags), values y (series, rows) and
    weights w (series, trees, rows), and the leaf of each row. Rows of weight 0
    take no part."""
    series, rows, lags = x.shape
    trees = w.shape[1]
    orders = [np.argsort(x[:, :, j], axis=1, kind="stable") for j in range(lags)]
    nodes = 2 ** (how.depth + 1) - 1
    lag = np.full((series, trees, nodes), -1, np.int64)
    cut, leaf = np.zeros((series, trees, nodes), np.int64), np.zeros((series, trees, nodes), np.int64)
    node = np.zeros((series, trees, rows), np.int64)
    active = w > 0
    one = np.arange(series * trees).reshape(series, trees, 1)
    for depth in range(how.depth + 1):
        first, k = 2**depth - 1, 2**depth
        local = np.where(active, node - first, k)
        key = (one * (k + 1) + local).ravel()
        cells = series * trees * (k + 1)
        total_w, total_y = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        np.add.at(total_w, key, w.ravel())
        np.add.at(total_y, key, (w * y[:, None, :]).ravel())
        here = (total_w > 0).reshape(series, trees, k + 1)
        here[..., k] = False
        mean = how.rate * total_y / np.maximum(total_w, 1)
        spot = leaf[..., first:first + k]
        spot[here[..., :k]] = np.rint(mean).astype(np.int64).reshape(series, trees, k + 1)[..., :k][here[..., :k]]
        if depth == how.depth or not here.any():
            break
        best = total_y.astype(float) * total_y / np.maximum(total_w, 1)  # a cut must beat the uncut node
        best_lag, best_cut = np.full(cells, -1, np.int64), np.zeros(cells, np.int64)
        for j in range(lags):
            by_value = np.broadcast_to(orders[j][:, None, :], local.shape)
            in_order = np.take_along_axis(local, by_value, 2)
            place = np.take_along_axis(by_value, np.argsort(in_order, axis=2, kind="stable"), 2)  # by node, then value
            at = (one * (k + 1) + np.take_along_axis(local, place, 2)).ravel()
            v = np.take_along_axis(np.broadcast_to(x[:, None, :, j], local.shape), place, 2).ravel()
            wv = np.take_along_axis(w, place, 2).ravel()
            yv = wv * np.take_along_axis(np.broadcast_to(y[:, None, :], local.shape), place, 2).ravel()
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            size = np.diff(np.append(starts, len(at)))
            cw, cy = np.cumsum(wv), np.cumsum(yv)
            wl = cw - np.repeat(cw[starts] - wv[starts], size)
            yl = cy - np.repeat(cy[starts] - yv[starts], size)
            wr, yr = total_w[at] - wl, total_y[at] - yl
            ok = np.zeros(len(at), bool)
            ok[:-1] = (at[:-1] == at[1:]) & (v[1:] > v[:-1])
            ok &= (at % (k + 1) < k) & (wl >= how.least) & (wr >= how.least)
            score = np.where(ok, yl.astype(float) * yl / np.maximum(wl, 1) + yr.astype(float) * yr / np.maximum(wr, 1), -np.inf)
            top = np.maximum.reduceat(score, starts)
            place_of = np.minimum.reduceat(np.where(score == np.repeat(top, size), np.arange(len(at)), len(at)), starts)
            cell = at[starts]
            better = top > best[cell]
            cell, place_of = cell[better], place_of[better]
            best[cell], best_lag[cell] = top[better], j
            if apart is None:
                best_cut[cell] = v[place_of] + v[place_of + 1]
            else:  # the next value of the whole fit, as histogram bins have it
                owner = cell // (k + 1) // trees
                best_cut[cell] = v[place_of] + np.array([apart[s][j][np.searchsorted(apart[s][j], a, side="right")] for s, a in zip(owner.tolist(), v[place_of].tolist(), strict=True)], np.int64)
        best_lag, best_cut = best_lag.reshape(series, trees, k + 1), best_cut.reshape(series, trees, k + 1)
        lag[..., first:first + k], cut[..., first:first + k] = best_lag[..., :k], best_cut[..., :k]
        row_lag = np.take_along_axis(best_lag, local, 2)
        row_cut = np.take_along_axis(best_cut, local, 2)
        split = active & (row_lag >= 0)
        chosen = np.take_along_axis(np.broadcast_to(x[:, None], (series, trees, rows, lags)), np.maximum(row_lag, 0)[..., None], 3)[..., 0]
        node = np.where(split, 2 * node + 1 + (2 * chosen > row_cut), node)
        active = split
    return Trees(lag, cut, leaf), np.take_along_axis(leaf, node, 2)


class Model:
    """Trees of some series with as many rows each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Settings):
        self.how, (series, rows) = how, y.shape
        self.base, self.parts = np.zeros(series, np.int64), []
        if not how.boosted:
            w = np.broadcast_to(draws(how.trees, rows), (series, how.trees, rows))
            self.parts = [grow(x, y, w, how)[0]]
            return
        self.base = np.rint(y.sum(1) / rows).astype(np.int64)
        if rows < 2 * how.least:
            return  # no cut leaves enough rows on both sides: the mean stands
        w = np.ones((series, 1, rows), np.int64)
        apart = [[np.unique(x[s, :, j]) for j in range(x.shape[2])] for s in range(series)]
        now = np.broadcast_to(self.base[:, None], y.shape)
        for _ in range(how.trees):
            tree, step = grow(x, y - now, w, how, apart)
            now = now + step[:, 0]
            self.parts.append(tree)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = sum((t.values(x).sum(1) for t in self.parts), np.zeros(len(x), np.int64))
        return self.base + total if self.how.boosted else np.rint(total / self.how.trees).astype(np.int64)


def _windows(y: np.ndarray, lags: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(y, lags, axis=1)


def paths(y: np.ndarray, horizon: int, hold: int, how: Settings, lags: int = 6) -> tuple[np.ndarray, np.ndarray | None]:
    """For series of one length (series, months) in whole millionths: the
    forecast, each step fed back as the newest lag and never below 0, and the
    one-step predictions of the last ``hold`` months of a fit without them
    (None if it would have two rows or fewer)."""
    x, target = _windows(y, lags)[:, :-1], y[:, lags:]
    held = None
    if target.shape[1] > hold + 2:
        part = Model(x[:, :-hold], target[:, :-hold], how)
        held = np.stack([part.predict(x[:, -hold + k]) for k in range(hold)], 1)
    model, last, out = Model(x, target, how), y[:, -lags:], []
    for _ in range(horizon):
        p = np.maximum(model.predict(last), 0)
        out.append(p)
        last = np.concatenate([last[:, 1:], p[:, None]], 1)
    return np.stack(out, 1), held


def forecast(series: DataFrame, horizon: int, how: Settings, lags: int = 6) -> DataFrame:
    """``series`` has one row per series: ``ys`` (values in time order), ``hold``
    and other columns, which stay. Adds ``path_f``, ``path_h`` and ``has_ho``."""
    names = series.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in series.schema)}, path_f array<double>, path_h array<double>, has_ho boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            full, held = [None] * len(frame), [None] * len(frame)
            kinds: dict[tuple[int, int], list[int]] = {}
            for i, (ys, hold) in enumerate(zip(frame["ys"], frame["hold"], strict=True)):
                kinds.setdefault((len(ys), int(hold)), []).append(i)
            for (_, hold), every in kinds.items():
                for lo in range(0, len(every), BATCH):
                    some = every[lo:lo + BATCH]
                    values = np.stack([np.asarray(frame["ys"].iloc[i], float) for i in some])
                    fits = (np.abs(values) <= LARGEST).all(1)
                    ahead, tail = paths(np.rint(np.where(fits[:, None], values, 0) * UNIT).astype(np.int64), horizon, hold, how, lags)
                    for k, i in enumerate(some):
                        full[i] = (ahead[k] / UNIT).tolist() if fits[k] else [float("nan")] * horizon
                        held[i] = None if tail is None or not fits[k] else (tail[k] / UNIT).tolist()
            yield frame[names].assign(path_f=full, path_h=held, has_ho=[h is not None for h in held])

    return series.mapInPandas(run, schema)
