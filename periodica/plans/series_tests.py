"""Unit-root statistics, least squares per group and the Hurst exponent."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: asymptotic critical values by deterministic terms and level
KPSS_CRITICAL = {
    "c": {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739},
    "ct": {0.10: 0.119, 0.05: 0.146, 0.025: 0.176, 0.01: 0.216},
}
DF_CRITICAL = {
    "n": {0.10: -1.62, 0.05: -1.94, 0.01: -2.57},
    "c": {0.10: -2.57, 0.05: -2.86, 0.01: -3.43},
    "ct": {0.10: -3.13, 0.05: -3.41, 0.01: -3.96},
    "ctt": {0.10: -3.55, 0.05: -3.83, 0.01: -4.37},
}
#: Deterministic terms each test can have: none, a constant, a line, a parabola.
TERMS = {"df": ("n", "c", "ct", "ctt"), "kpss": ("c", "ct"), "pp": ("c", "ct")}


def _check_terms(test: str, trend: str) -> None:
    if trend not in TERMS[test]:
        raise ValueError(f"terms of {test} must be one of {TERMS[test]}")


def _decision(statistic: Column, critical: float, rejects: Column, if_rejected: str, else_: str) -> list[Column]:
    return [F.lit(critical).alias("critical"), F.when(statistic.isNull(), "undetermined").when(rejects, if_rejected).otherwise(else_).alias("decision")]


def numbered(series: DataFrame) -> DataFrame:
    """(series, i, n, value) of the valid values, i from 1."""
    whole = Window.partitionBy("series")
    return series.where("value is not null").select(
        "series", F.row_number().over(whole.orderBy("ts")).alias("i"), F.count(F.lit(1)).over(whole).alias("n"), F.col("value").cast("double").alias("value"))


def without_terms(rows: DataFrame, columns: list[str], trend: str, i: str = "i", n: str = "n") -> DataFrame:
    """Residuals of ``columns`` on the deterministic terms of positions 1 to n.

    Over equally spaced positions the centred line and the centred square are
    orthogonal to each other and to the constant, so each coefficient is a
    quotient of two sums.
    """
    if trend == "n":
        return rows
    whole = Window.partitionBy("series")
    line = F.col(i) - (F.col(n) + 1) / 2
    square = line * line - (F.col(n) * F.col(n) - 1) / 12
    parts = {"c": [], "ct": [line], "ctt": [line, square]}[trend]
    out = {}
    for c in columns:
        e = F.col(c) - F.avg(c).over(whole)
        for x in parts:
            xx = F.sum(x * x).over(whole)
            e = e - x * F.coalesce(F.sum(F.col(c) * x).over(whole) / F.when(xx > 0, xx), F.lit(0.0))
        out[c] = e
    return rows.withColumns(out)


def long_run_sums(rows: DataFrame) -> DataFrame:
    """(series, n, l, g0, g) of residuals (series, i, n, l, e): sum of squares, and twice the Bartlett-weighted sum of lagged products.

    The weighted sum of the ``l`` residuals before a row is a difference of running
    sums of e and i * e, looked up once ``l + 1`` rows before; no row is repeated
    for each lag.
    """
    run = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({"p": F.sum("e").over(run), "q": F.sum(F.col("i") * F.col("e")).over(run)})
    far = sums.select("series", (F.col("i") + F.col("l") + 1).alias("i"), F.col("p").alias("pf"), F.col("q").alias("qf"))
    j = sums.join(far, ["series", "i"], "left")
    near = F.col("p") - F.col("e") - F.coalesce("pf", F.lit(0.0))
    distance = F.col("i") * near - (F.col("q") - F.col("i") * F.col("e") - F.coalesce("qf", F.lit(0.0)))
    weighted = F.col("e") * (near - distance / (F.col("l") + 1))
    return j.groupBy("series", "n", "l").agg(F.sum(F.col("e") * F.col("e")).alias("g0"), (2 * F.sum(weighted)).alias("g"))


def _bartlett_lags(n: Column) -> Column:
    return F.ceil(12 * F.pow(n / 100, 0.25)).cast("int")


def kpss_statistic(series: DataFrame, alpha: float = 0.05, trend: str = "c") -> DataFrame:
    """Stationarity statistic around a level or a line, with Bartlett weights, as grouped sums of products."""
    _check_terms("kpss", trend)
    r = without_terms(numbered(series), ["value"], trend).withColumnRenamed("value", "e").withColumn("l", _bartlett_lags(F.col("n")))
    path = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    squares = r.withColumn("s", F.sum("e").over(path)).groupBy("series").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    out = squares.join(long_run_sums(r), "series")
    variance = (F.col("g0") + F.col("g")) / F.col("n")
    # What rounding leaves of a constant series, or of one on a line, is no variance.
    out = out.withColumn("statistic", F.when(F.col("g0") > 0, F.col("ss") / (F.col("n") * F.col("n")) / F.when(variance > 0, variance)))
    cv = KPSS_CRITICAL[trend][alpha]
    return out.select("series", F.lit("kpss").alias("test"), F.lit(trend).alias("trend"), "statistic", F.col("l").alias("lags"), F.col("n").alias("nobs"),
                      *_decision(F.col("statistic"), cv, F.col("statistic") > cv, "non_stationary", "stationary"))


def dickey_fuller(series: DataFrame, lags: int = 0, alpha: float = 0.05, trend: str = "c") -> DataFrame:
    """t-statistic of the lagged level in a fixed-lag regression with deterministic terms."""
    _check_terms("df", trend)
    w = Window.partitionBy("series").orderBy("ts")
    d = series.where("value is not null").select("series", "ts", "value", (F.col("value") - F.lag("value").over(w)).alias("dy"), F.lag("value").over(w).alias("y1"))
    xs = ["y1"]
    for k in range(1, lags + 1):
        d = d.withColumn(f"d{k}", F.lag("dy", k).over(w))
        xs.append(f"d{k}")
    for x in ["dy", *xs]:
        d = d.where(F.col(x).isNotNull())
    if trend in ("ct", "ctt"):  # a line from -1/2 to 1/2 keeps the normal equations well scaled
        d = d.withColumn("line", (F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("series")) - 0.5)
        xs.append("line")
    if trend == "ctt":
        d = d.withColumn("square", F.col("line") * F.col("line"))
        xs.append("square")
    fit = least_squares(d, ["series"], "dy", xs, constant=trend != "n")
    cv = DF_CRITICAL[trend][alpha]
    return fit.where("term = 'y1'").select("series", F.lit("df").alias("test"), F.lit(trend).alias("trend"), F.col("t").alias("statistic"), F.lit(lags).alias("lags"), F.col("n").alias("nobs"),
                                           *_decision(F.col("t"), cv, F.col("t") < cv, "stationary", "non_stationary"))


def phillips_perron(series: DataFrame, alpha: float = 0.05, trend: str = "c") -> DataFrame:
    """t-statistic of the lagged level, corrected by the long-run variance of the residuals.

    The deterministic terms are taken out of the level and its lag first, so the
    regression is one quotient of sums per series.
    """
    _check_terms("pp", trend)
    w = Window.partitionBy("series").orderBy("i")
    r = numbered(series)
    r = r.withColumns({"x": F.lag("value").over(w), "l": _bartlett_lags(F.col("n"))}).where("x is not null")
    r = without_terms(r.withColumns({"i": F.col("i") - 1, "n": F.col("n") - 1}), ["value", "x"], trend)
    whole = Window.partitionBy("series")
    xx = F.sum(F.col("x") * F.col("x")).over(whole)
    r = r.withColumn("xx", xx).withColumn("rho", F.sum(F.col("x") * F.col("value")).over(whole) / F.when(F.col("xx") > 0, F.col("xx")))
    r = r.where("rho is not null").withColumn("e", F.col("value") - F.col("rho") * F.col("x"))
    fit = r.groupBy("series").agg(F.max("rho").alias("rho"), F.max("xx").alias("xx"))
    s = long_run_sums(r.select("series", "i", "n", "l", "e")).join(fit, "series")
    n, free = F.col("n"), F.col("n") - (len(trend) + 1)
    s2 = F.col("g0") / F.when(free > 0, free)
    own, long = F.col("g0") / n, (F.col("g0") + F.col("g")) / n
    long = F.when(long > 0, long)
    error = F.sqrt(s2 / F.col("xx"))
    plain = (F.col("rho") - 1) / F.when(error > 0, error)
    s = s.withColumn("statistic", F.sqrt(own / long) * plain - 0.5 * (long - own) / F.sqrt(long) * n * error / F.sqrt(s2))
    cv = DF_CRITICAL[trend][alpha]
    return s.select("series", F.lit("pp").alias("test"), F.lit(trend).alias("trend"), "statistic", F.col("l").alias("lags"), n.alias("nobs"),
                    *_decision(F.col("statistic"), cv, F.col("statistic") < cv, "stationary", "non_stationary"))


def stationarity_battery(series: DataFrame, tests: list[str], alpha: float = 0.05, lags: int = 0, trend: str = "c", trends: dict[str, str] | None = None) -> DataFrame:
    """Chosen tests over all series as one long table; ``trends`` sets the deterministic terms of single tests."""
    build = {
        "kpss": lambda d: kpss_statistic(series, alpha, d), "df": lambda d: dickey_fuller(series, lags, alpha, d),
        "pp": lambda d: phillips_perron(series, alpha, d)}
    unknown = [x for x in tests if x not in build]
    if unknown or not tests:
        raise ValueError(f"unknown tests {unknown}" if unknown else "no test chosen")
    chosen = {name: (trends or {}).get(name, trend) for name in dict.fromkeys(tests)}
    for name, terms in chosen.items():
        _check_terms(name, terms)
    return reduce(DataFrame.unionByName, [build[name](terms) for name, terms in chosen.items()])


def least_squares(df: DataFrame, keys: list[str], y: str, xs: list[str], constant: bool = False, minimum: int | None = None) -> DataFrame:
    """Ordinary least squares per group from sums of products.

    The data is read once by a partial aggregate; only the small normal
    equations of each group reach Python. Groups with fewer than ``minimum``
    rows (terms + 2 unless given) have NULL estimates.
    """
    cols = (["_one"] if constant else []) + xs
    names = (["const"] if constant else []) + xs
    k = len(cols)
    need = k + 2 if minimum is None else minimum
    valid = df.withColumn("_one", F.lit(1.0))
    for c in [y, *xs]:
        valid = valid.where(F.col(c).isNotNull())
    xx = [F.sum(F.col(a).cast("double") * F.col(b)) for a in cols for b in cols]
    xy = [F.sum(F.col(a).cast("double") * F.col(y)) for a in cols]
    s = valid.groupBy(*keys).agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col(y).cast("double") * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n"))

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, v = np.stack(pdf["xx"].map(np.asarray)).reshape(-1, k, k).astype(float), np.stack(pdf["xy"].map(np.asarray)).astype(float)
            n, yy = pdf["n"].to_numpy(), pdf["yy"].to_numpy(float)
            scale = 1 / np.sqrt(np.where((own := np.einsum("gii->gi", m)) > 0, own, 1.0))
            scaled = m * scale[:, :, None] * scale[:, None, :]
            good = (n >= need) & np.isfinite(scaled).all(axis=(1, 2))
            good[good] = np.linalg.matrix_rank(scaled[good], tol=1e-13, hermitian=True) == k
            beta, t = np.full((len(n), k), np.nan), np.full((len(n), k), np.nan)
            inv = np.linalg.inv(scaled[good]) * scale[good][:, :, None] * scale[good][:, None, :]
            beta[good] = np.einsum("gij,gj->gi", inv, v[good])
            sse = np.maximum(0.0, yy[good] - np.einsum("gi,gi->g", beta[good], v[good]))
            se = np.sqrt(np.einsum("gii->gi", inv) * (sse / np.maximum(1, n[good] - k))[:, None])
            t[good] = np.divide(beta[good], se, out=np.full_like(se, np.nan), where=se > 0)
            out = pdf.loc[pdf.index.repeat(k), keys].reset_index(drop=True)
            blank = lambda x: pd.Series(x.ravel(), dtype="float64").astype(object).where(~np.isnan(x.ravel()), None)
            yield out.assign(term=names * len(n), coefficient=blank(beta), t=blank(t), n=np.repeat(n, k))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return s.mapInPandas(solve, f"{kinds}, term string, coefficient double, t double, n long")


def hurst_exponent(series: DataFrame, minimum: int = 20, smallest: int = 8) -> DataFrame:
    """Rescaled-range exponent: slope of the mean range on the block size, in logs."""
    valid = series.where("value is not null")
    whole = Window.partitionBy("series")
    ix = valid.select("series", "value", (F.row_number().over(whole.orderBy("ts")) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    top = F.floor(F.log2(F.col("n") / 2)).cast("int")
    low = int(np.log2(smallest))
    sizes = F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), top)), lambda p: F.pow(F.lit(2.0), p).cast("long"))
    rows = ix.where(F.col("n") >= minimum).withColumn("size", F.explode(sizes)).where(F.col("size") * 2 <= F.col("n"))
    rows = rows.withColumn("block", F.floor(F.col("i") / F.col("size"))).where((F.col("block") + 1) * F.col("size") <= F.col("n"))
    key = ["series", "n", "size", "block"]
    b = Window.partitionBy(*key)
    dev = rows.withColumn("d", F.col("value") - F.avg("value").over(b)).withColumn("sd", F.stddev_pop("value").over(b))
    dev = dev.withColumn("c", F.sum("d").over(b.orderBy("i")))
    rs = dev.groupBy(*key).agg(((F.max("c") - F.min("c")) / F.when(F.max("sd") > 0, F.max("sd"))).alias("rs")).where("rs > 0")
    mean = rs.groupBy("series", "n", "size").agg(F.avg("rs").alias("rs"))
    return mean.groupBy("series", F.col("n").alias("valid")).agg(F.round(F.regr_slope(F.ln("rs"), F.ln("size")), 4).alias("hurst"))
