"""Forecast frames, baselines, scoring and candidate choice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.measures import finite
from periodica.plans.series_pairs import indexed


def origins(series: DataFrame, first_train: int, horizon: int) -> DataFrame:
    """Every expanding-window origin crossed with every horizon that has an actual.

    Rows are (series, origin, horizon, ts, actual, reference); reference is the
    value at the origin. Built by exploding horizons, then an equality join.
    """
    ix = indexed(series)
    o = ix.where(F.col("i") >= first_train).select(
        "series", F.col("i").alias("origin"), F.col("ts").alias("origin_ts"), F.col("value").alias("reference"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).withColumn("i", F.col("origin") + F.col("horizon"))
    return o.join(ix.select("series", "i", "ts", F.col("value").alias("actual")), ["series", "i"])


def naive(frame: DataFrame, series: DataFrame, lag: int, name: str) -> DataFrame:
    """(Seasonal) naive forecast in closed form: it never reads past the origin."""
    src = F.col("origin") - lag + 1 + (F.col("horizon") - 1) % lag
    past = indexed(series).select("series", F.col("i").alias("_s"), F.col("value").alias(name))
    return frame.withColumn("_s", src).join(past, ["series", "_s"], "left").drop("_s")


def drift(frame: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """Last value plus the mean step since the first one."""
    first = series.groupBy("series").agg(F.min_by("value", "ts").alias("_f"))
    step = (F.col("reference") - F.col("_f")) / F.when(F.col("origin") > 1, F.col("origin") - 1)
    return frame.join(first, "series").withColumn(name, F.col("reference") + F.col("horizon") * step).drop("_f")


def autoregression(frame: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """First-order autoregression fitted by running sums on the rows up to each origin."""
    w = Window.partitionBy("series").orderBy("i")
    ix = indexed(series).select("series", "i", "value", F.lag("value").over(w).alias("l"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    slope = F.covar_samp("value", "l").over(run) / F.when(F.var_samp(F.when(F.col("l").isNotNull(), F.col("l"))).over(run) != 0, F.var_samp(F.when(F.col("l").isNotNull(), F.col("l"))).over(run))
    fit = ix.withColumn("_b", slope).withColumn("_my", F.avg(F.when(F.col("l").isNotNull(), F.col("value"))).over(run)).withColumn("_mx", F.avg("l").over(run))
    fit = fit.select("series", F.col("i").alias("origin"), "_b", (F.col("_my") - F.col("_b") * F.col("_mx")).alias("_a"))
    b, h = F.col("_b"), F.col("horizon")
    geometric = F.when(b == 1, h.cast("double")).otherwise((1 - F.pow(b, h)) / (1 - b))
    return frame.join(fit, ["series", "origin"]).withColumn(name, F.col("_a") * geometric + F.pow(b, h) * F.col("reference")).drop("_a", "_b")


def backtest(series: DataFrame, first_train: int, horizon: int, season: int) -> DataFrame:
    """Long rolling-origin frame of all built-in models beside the naive baseline."""
    base = naive(origins(series, first_train, horizon), series, 1, "baseline")
    wide = autoregression(drift(naive(base, series, season, "seasonal_naive"), series, "drift"), series, "ar1")
    ids = ["series", "origin", "horizon", "ts", "actual", "reference", "baseline"]
    models = ["seasonal_naive", "drift", "ar1"]
    return wide.select(*ids, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])))


def adapter_backtest(frame: DataFrame, series: DataFrame, fit_forecast: Callable[[pd.DataFrame, int], list[float]], model: str) -> DataFrame:
    """Predictions of a user's model: it sees one series up to one origin.

    History rows are paired with each origin by a range of the index, and one
    group is one (series, origin), so origins of a long series spread out.
    """
    cut = frame.groupBy("series", "origin").agg(F.max("horizon").alias("steps"))
    hist = indexed(series).join(cut, "series").where(F.col("i") <= F.col("origin"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        steps = int(pdf["steps"].iloc[0])
        out = list(fit_forecast(pdf[["ts", "value"]], steps))
        return pd.DataFrame({"series": [key[0]] * steps, "origin": [key[1]] * steps, "horizon": range(1, steps + 1), "predicted": out[:steps]})

    kind = series.schema["series"].dataType.simpleString()
    pred = hist.groupBy("series", "origin").applyInPandas(one, f"series {kind}, origin int, horizon int, predicted double")
    return frame.join(pred, ["series", "origin", "horizon"], "left").withColumn("model", F.lit(model))


def score(df: DataFrame, by: list[str], baseline: str = "baseline") -> DataFrame:
    """Error and direction scores over the finite pairs of each group."""
    a, p, b, r = finite("actual"), finite("predicted"), finite(baseline), finite("reference")
    ok = a.isNotNull() & p.isNotNull()
    e = F.when(ok, a - p)
    pct = F.when(ok & (a != 0), (a - p) / F.when(a != 0, a) * 100)
    sm = F.abs(a) + F.abs(p)
    directed = ok & r.isNotNull()
    against = ok & b.isNotNull()
    pair = lambda c: F.when(ok, c)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(pct).alias("mpe"), F.avg(F.abs(pct)).alias("mape"),
        F.avg(F.when(ok & (sm != 0), 200 * F.abs(a - p) / F.when(sm != 0, sm))).alias("smape"),
        F.count(e).alias("valid"), F.count(pct).alias("percent_valid"), (F.count(e) / F.count(F.lit(1))).alias("coverage"),
        F.avg(F.when(directed, (F.signum(a - r) == F.signum(p - r)).cast("double"))).alias("direction_hit"), F.count(F.when(directed, 1)).alias("direction_valid"),
        F.avg(F.when(against, (F.abs(a - p) < F.abs(a - b)).cast("double"))).alias("win_rate"),
        F.corr(pair(a), pair(p)).alias("correlation"))


def better(a: Column, b: Column) -> Column:
    """1 when score ``a`` is the smaller, -1 when larger, 0 otherwise; non-finite loses."""
    x, y = finite(a), finite(b)
    return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, 1).when(x > y, -1).otherwise(0)


def pick_best(scores: DataFrame, by: list[str], criterion: str, order: str) -> DataFrame:
    """Best finite candidate per group; the first in candidate order wins ties."""
    v = finite(criterion)
    cols = [c for c in scores.columns if c not in by]
    return scores.where(v.isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(v, F.col(order))).alias("_r")).select(*by, "_r.*")


def removal_scores(scores: Callable[[list[str]], DataFrame], variables: list[str]) -> DataFrame:
    """One score per left-out variable; ``scores`` returns one row with column ``score``."""
    out = None
    for name in variables:
        one = scores([v for v in variables if v != name]).select(F.lit(name).alias("removed"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def backward_select(scores: Callable[[list[str]], DataFrame], variables: list[str], keep_at_least: int = 2) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop one variable per round while the score falls; each round is one job."""
    current, history = list(variables), []
    best = scores(current).first()["score"]
    while len(current) > keep_at_least:
        row = removal_scores(scores, current).where(finite("score").isNotNull()).orderBy("score", "removed").first()
        if row is None or (best is not None and not row["score"] < best):
            break
        current.remove(row["removed"])
        best = row["score"]
        history.append((row["removed"], best))
    return current, history


def _removal_rounds(train: np.ndarray, check: np.ndarray, rows: tuple[int, int], names: list[str], least: int) -> list[tuple[int, str | None, float | None, list[str]]]:
    """(round, removed, score, kept) from the moments of (constant, variables, target) of training and checking rows.

    All models that lack one more variable follow from the inverse Gram matrix of
    the present one: their coefficients are shifted along its columns, and it
    shrinks by the removed row and column.
    """
    kept = list(range(1, len(names) + 1))
    target = len(names) + 1

    def error(beta: np.ndarray, at: list[int]) -> float:
        """Root of the mean squared error on the checking rows."""
        sse = check[target, target] - 2 * beta @ check[at, target] + beta @ check[np.ix_(at, at)] @ beta
        return float(np.sqrt(max(0.0, sse) / rows[1]))

    def solved(at: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        gram = train[np.ix_(at, at)]
        scale = 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        scaled = gram * np.outer(scale, scale)
        if rows[0] <= len(at) or np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True) < len(at):
            return None
        inverse = np.linalg.inv(scaled) * np.outer(scale, scale)
        return inverse, inverse @ train[at, target]

    if not rows[1]:
        return [(0, None, None, names)]
    now = solved([0, *kept])
    best = error(now[1], [0, *kept]) if now else None
    out = [(0, None, best, list(names))]
    while len(kept) > least:
        at = [0, *kept]
        if now:
            inverse, beta = now
            tried = []
            for place, variable in enumerate(kept, 1):
                shifted = beta - inverse[:, place] * (beta[place] / inverse[place, place])
                shifted[place] = 0.0
                tried.append((error(shifted, at), names[variable - 1], variable))
        else:  # dependent variables: each smaller model on its own, until one can be solved
            alone = {v: solved([0, *[k for k in kept if k != v]]) for v in kept}
            tried = [(error(fit[1], [0, *[k for k in kept if k != v]]), names[v - 1], v) for v, fit in alone.items() if fit]
        score, name, variable = min(tried, default=(np.inf, None, 0))
        if not np.isfinite(score) or best is not None and not score < best:
            break
        if now:
            place = kept.index(variable) + 1
            left = [i for i in range(len(at)) if i != place]
            inverse = inverse - np.outer(inverse[:, place], inverse[place]) / inverse[place, place]
            inverse = inverse[np.ix_(left, left)]
            kept.remove(variable)
            now = inverse, inverse @ train[[0, *kept], target]
        else:
            kept.remove(variable)
            now = solved([0, *kept])
        best = score
        out.append((len(out), name, score, [names[v - 1] for v in kept]))
    return out


def backward_removal(df: DataFrame, keys: list[str], y: str, xs: list[str], train: Column, keep_at_least: int = 1) -> DataFrame:
    """Rounds of dropping the variable whose absence lowers the error most: (keys, round, removed, score, kept).

    Linear models with a constant are fitted on the ``train`` rows and scored by
    the root mean squared error on the others. Round 0 is the full model; ties go
    to the first name; a group ends where no removal helps or ``keep_at_least``
    variables are left. The rows are read once, for the sums of products of each
    group; a group's rounds then work on these alone. Rows with a null in ``y`` or
    ``xs`` are left out; a group without rows to score has no score.
    """
    if keep_at_least < 1 or not xs:
        raise ValueError("at least one variable must be kept")
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    valid = df.withColumn("_train", train)
    for c in [y, *xs, "_train"]:
        valid = valid.where(F.col(c).isNotNull())
    part = lambda flag: F.array(*[F.sum(F.when(flag, cols[i] * cols[j]).otherwise(0.0)) for i, j in pairs])
    sums = valid.groupBy(*keys).agg(part(F.col("_train")).alias("_fit"), part(~F.col("_train")).alias("_check"))
    size, names = len(cols), list(xs)

    def square(flat) -> np.ndarray:
        m = np.zeros((size, size))
        for (i, j), v in zip(pairs, flat):
            m[i, j] = m[j, i] = v
        return m

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                fit, check = square(row[-2]), square(row[-1])
                rounds = _removal_rounds(fit, check, (int(fit[0, 0]), int(check[0, 0])), names, keep_at_least)
                out += [(*row[:-2], *r) for r in rounds]
            yield pd.DataFrame(out, columns=[*keys, "round", "removed", "score", "kept"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    return sums.mapInPandas(run, f"{kinds}round int, removed string, score double, kept array<string>")


def kept_variables(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """The last round of each group."""
    return rounds.groupBy(*keys).agg(F.max_by(F.struct("score", "kept"), "round").alias("_l"), F.max("round").alias("removals")).select(*keys, "_l.*", "removals")
