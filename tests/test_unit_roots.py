"""Unit-root statistics against plain matrix algebra."""

from datetime import date, timedelta

import numpy as np
import pytest

from periodica.plans import series_tests as st

SER = "series string, ts date, value double"


def terms(n, trend):
    t = np.arange(1, n + 1, dtype=float)
    return np.column_stack([t**k for k in range({"n": 0, "c": 1, "ct": 2, "ctt": 3}[trend])]) if trend != "n" else np.empty((n, 0))


def fit(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    u = y - x @ beta
    s2 = u @ u / (len(y) - x.shape[1])
    return beta, u, s2, np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))


def long_run(u, lags):
    n = len(u)
    return (u @ u + 2 * sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1) if k < n)) / n


def brute(y, test, trend, lags=0):
    n = len(y)
    l = int(np.ceil(12 * (n / 100) ** 0.25))
    if test == "df":
        dy = np.diff(y)
        x = np.column_stack([y[lags:-1], *[dy[lags - k : len(dy) - k] for k in range(1, lags + 1)], terms(n - 1 - lags, trend)])
        beta, _, _, se = fit(dy[lags:], x)
        return beta[0] / se[0]
    if test == "kpss":
        u = fit(y, terms(n, trend))[1]
        return (np.cumsum(u) ** 2).sum() / n**2 / long_run(u, l)
    m = n - 1
    beta, u, s2, se = fit(y[1:], np.column_stack([y[:-1], terms(m, trend)]))
    own, lr = u @ u / m, long_run(u, l)
    return np.sqrt(own / lr) * (beta[0] - 1) / se[0] - 0.5 * (lr - own) / np.sqrt(lr) * m * se[0] / np.sqrt(s2)


@pytest.fixture(scope="module")
def values():
    rnd = np.random.default_rng(4)
    noise = rnd.normal(size=(4, 160))
    return {
        "walk": np.cumsum(noise[0]), "noise": noise[1][:60], "line": 3 + 0.4 * np.arange(160) + noise[2],
        "curve": 0.01 * np.arange(90.0) ** 2 + np.cumsum(noise[3][:90]), "short": rnd.normal(size=9)}


def frame_of(frame, values):
    return frame([(k, date(2000, 1, 1) + timedelta(i), float(x)) for k, v in values.items() for i, x in enumerate(v)] + [("walk", date(1999, 1, 1), None)], SER)


@pytest.mark.parametrize("test,trend,lags", [("df", d, l) for d in ("n", "c", "ct", "ctt") for l in (0, 2)] + [(x, d, 0) for x in ("kpss", "pp") for d in ("c", "ct")])
def test_against_matrices(frame, values, test, trend, lags):
    got = {r["series"]: r for r in st.stationarity_battery(frame_of(frame, values), [test], lags=lags, trend=trend).collect()}
    for name, y in values.items():
        if test == "df" and len(y) - 1 - lags < len(trend) + 1 + lags + 2:
            continue
        assert got[name]["statistic"] == pytest.approx(brute(y, test, trend, lags), rel=1e-6), name
        assert got[name]["nobs"] == {"df": len(y) - 1 - lags, "kpss": len(y), "pp": len(y) - 1}[test]


def test_decisions(frame, values):
    s = frame_of(frame, values)
    got = {(r["series"], r["test"], r["trend"]): r["decision"] for r in st.stationarity_battery(s, ["df", "kpss", "pp"], trends={"df": "ctt"}, trend="ct").collect()}
    assert {(t, d) for _, t, d in got} == {("df", "ctt"), ("kpss", "ct"), ("pp", "ct")}
    assert got["line", "pp", "ct"] == "stationary" and got["line", "kpss", "ct"] == "stationary" and got["walk", "pp", "ct"] == "non_stationary"


def test_constant_and_tiny_series(frame):
    s = frame([("flat", date(2000, 1, 1 + i), 2.0) for i in range(12)] + [("one", date(2000, 1, 1), 1.0)], SER)
    for r in st.stationarity_battery(s, ["df", "kpss", "pp"]).collect():
        assert r["statistic"] is None and r["decision"] == "undetermined"


def test_options(frame):
    s = frame([], SER)
    assert st.stationarity_battery(s, ["pp"]).count() == 0
    for bad in (dict(tests=["pp"], trend="n"), dict(tests=["kpss"], trend="ctt"), dict(tests=["zz"]), dict(tests=[]), dict(tests=["df", "pp"], trends={"pp": "ctt"})):
        with pytest.raises(ValueError):
            st.stationarity_battery(s, **bad)
