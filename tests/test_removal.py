"""Backward removal against refits of every model from the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.plans import forecasts as fc

NAMES = ["a", "b", "c", "d", "e"]


def refit(x, y, fit, cols):
    design = np.column_stack([np.ones(len(y)), *[x[:, i] for i in cols]])
    beta = np.linalg.lstsq(design[fit], y[fit], rcond=None)[0]
    return float(np.sqrt(np.mean((y - design @ beta)[~fit] ** 2)))


def brute(x, y, fit, least):
    cols, rounds = list(range(x.shape[1])), []
    best = refit(x, y, fit, cols)
    rounds.append((0, None, best, [NAMES[i] for i in cols]))
    while len(cols) > least:
        score, i = min((refit(x, y, fit, [k for k in cols if k != i]), i) for i in cols)
        if not score < best:
            break
        cols.remove(i)
        best = score
        rounds.append((len(rounds), NAMES[i], score, [NAMES[k] for k in cols]))
    return rounds


def frame_of(frame, groups):
    rows = [(g, *map(float, x), float(y), bool(f)) for g, (xs, ys, fit) in groups.items() for x, y, f in zip(xs, ys, fit)]
    return frame(rows + [("g0", 1.0, None, 1.0, 1.0, 1.0, 1.0, True), ("g0", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None)], "g string, a double, b double, c double, d double, e double, y double, fit boolean")


@pytest.mark.parametrize("least", [1, 3])
def test_against_refits(frame, least):
    rnd, groups = np.random.default_rng(8), {}
    for k in range(6):
        x = rnd.normal(size=(60, 5)) * [1, 10, 100, 1, 1] + [0, 5, 1000, 0, 0]
        y = x[:, 0] * (k % 3) + x[:, 1] * 0.3 + rnd.normal(size=60) * 2
        groups[f"g{k}"] = (x, y, np.arange(60) < 35)
    got = {}
    for r in fc.backward_removal(frame_of(frame, groups), ["g"], "y", NAMES, F.col("fit"), least).orderBy("g", "round").collect():
        got.setdefault(r["g"], []).append(tuple(r)[1:])
    for g, data in groups.items():
        want = brute(*data, least)
        assert [(r[0], r[1], r[3]) for r in got[g]] == [(w[0], w[1], w[3]) for w in want]
        assert [r[2] for r in got[g]] == pytest.approx([w[2] for w in want], rel=1e-7)
    assert any(len(v) > 2 for v in got.values())


def test_dependent_and_unscored(frame):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(40, 5))
    x[:, 1] = 2 * x[:, 0]
    y = x[:, 0] + rnd.normal(size=40)
    fit = np.arange(40) < 25
    rounds = fc.backward_removal(frame_of(frame, {"dep": (x, y, fit), "all": (x, y, fit | True)}), ["g"], "y", NAMES, F.col("fit")).orderBy("round")
    dep = [tuple(r)[1:] for r in rounds.where("g = 'dep'").collect()]
    assert dep[0][2] is None and dep[1][1] in ("a", "b")
    left = [NAMES.index(n) for n in dep[1][3]]
    assert dep[1][2] == pytest.approx(refit(x, y, fit, left))
    assert [tuple(r)[1:] for r in rounds.where("g = 'all'").collect()] == [(0, None, None, NAMES)]
    last = {r["g"]: r for r in fc.kept_variables(rounds, ["g"]).collect()}
    assert last["dep"]["removals"] == len(dep) - 1 and last["all"]["kept"] == NAMES


def test_options(frame):
    empty = frame([], "g string, a double, y double, fit boolean")
    assert fc.backward_removal(empty, ["g"], "y", ["a"], F.col("fit")).count() == 0
    with pytest.raises(ValueError):
        fc.backward_removal(empty, ["g"], "y", [], F.col("fit"))
