"""Warping over tiles and alignments against a plain cost matrix."""

from datetime import date

import numpy as np
import pytest

from periodica.plans import warping as wp

SER, PAIRS = "series string, ts date, value double", "target string, candidate string"


def brute(a, b, radius):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if radius is None or abs(i - j) <= radius:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return np.sqrt(d[-1, -1])


def test_tiles_by_hand():
    rnd = np.random.default_rng(0)
    for n, m, tile, radius in ((7, 9, 3, None), (9, 7, 4, 3), (6, 6, 2, 1), (1, 5, 2, None), (5, 1, 1, None), (8, 8, 8, 2)):
        a, b = rnd.normal(size=n), rnd.normal(size=m)
        above, left = {}, {}
        for p in range(0, n, tile):
            for q in range(0, m, tile):
                x, y = a[p : p + tile], b[q : q + tile]
                corner = 0.0 if p == q == 0 else np.inf
                edge = lambda k: np.concatenate([[corner], np.full(k, np.inf)])
                below, right = wp.fill(x, y, above.get((p, q), edge(len(y))), left.get((p, q), edge(len(x))), (p, q), radius)
                above[p + tile, q], left[p, q + tile] = below, right
        assert np.sqrt(below[-1]) == pytest.approx(brute(a, b, radius))


@pytest.mark.parametrize("strict,radius", [(True, None), (False, 4)])
def test_pairs(frame, strict, radius):
    rnd, values = np.random.default_rng(3), {}
    for k, (first, step, n) in enumerate(((0, 1, 40), (5, 1, 33), (10, 2, 18), (0, 1, 6), (100, 1, 30), (8, 1, 31))):
        values[f"s{k}"] = {first + step * i: float(rnd.normal()) for i in range(n)}
    values["flat"] = {i: 2.0 for i in range(30)}
    rows = [(k, date.fromordinal(738000 + t), v) for k, s in values.items() for t, v in s.items()] + [("s0", date.fromordinal(739999), None)]
    pairs = [(a, b) for a in ("s0", "s1", "flat") for b in (*values, "none") if a != b]
    found = lambda **o: {(r["target"], r["candidate"]): tuple(r)[2:] for r in wp.dtw_distances(frame(rows, SER), frame(pairs, PAIRS), radius=radius, strict=strict, **o).collect()}
    want = {}
    for a, b in pairs:
        x, y = values[a], values.get(b, {})
        times = sorted(set(x) & set(y))
        if strict:
            x, y = [x[t] for t in times], [y[t] for t in times]
        else:
            low, high = max(min(x), min(y, default=0)), min(max(x), max(y, default=-1))
            x, y = [v for t, v in sorted(x.items()) if low <= t <= high], [v for t, v in sorted(y.items()) if low <= t <= high]
        n, m, distance, reason = len(x), len(y), None, None
        if min(n, m) < 10:
            reason = "insufficient_data"
        elif radius and abs(n - m) > radius:
            reason = "band_too_narrow"
        else:
            scaled = [(np.array(v) - np.mean(v)) / np.std(v, ddof=1) if np.std(v) > 0 else np.array(v) for v in (x, y)]
            distance = pytest.approx(brute(*scaled, radius))
        want[a, b] = (n, m, distance, reason)
    assert found() == want
    assert found(longest=20, tile=7) == want
    assert {w[3] for w in want.values()} >= {None, "insufficient_data"}


def test_nothing(frame):
    assert wp.dtw_distances(frame([], SER), frame([], PAIRS)).count() == 0
