"""Factor loadings, factor counts, news impacts and reconstruction errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.operators.joins import backward_asof
from periodica.operators.quality import QualityError
from periodica.plans.series_tests import least_squares
from periodica.session import cut_lineage


def train_standardise(df: DataFrame, key: str, value: str, train: Column) -> DataFrame:
    """Centre and scale by the training rows only; no spread scales by one, missing becomes 0."""
    stats = df.groupBy(key).agg(F.avg(F.when(train, F.col(value))).alias("_m"), F.stddev_samp(F.when(train, F.col(value))).alias("_s"))
    out = df.join(stats, key).withColumn("centred", F.col(value) - F.col("_m"))
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    return out.withColumn("standardised", F.coalesce(F.col("centred") / sd, F.lit(0.0))).drop("_m", "_s")


def loadings(observed: DataFrame, factors: DataFrame, period: str, variable: str, value: str, names: list[str]) -> DataFrame:
    """Loading of every variable on every factor by least squares without constant."""
    rows = observed.join(factors.select(period, *names), period)
    fit = least_squares(rows, [variable], value, names)
    return fit.select(variable, F.col("term").alias("factor"), F.col("coefficient").alias("loading"), "n")


def moment_cells(vectors: DataFrame, column: str) -> DataFrame:
    """(size, i, j, value) of the summed outer product of (1, vector), for i <= j.

    Each task adds up its own rows and sends one cell per pair of variables, so
    what meets does not grow with the rows. Null vectors are left out; vectors of
    different lengths are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = [r for r in batch.column(0).to_pylist() if r is not None]
            if rows:
                if len({len(r) for r in rows} | ({len(total) - 1} if total is not None else set())) > 1:
                    raise ValueError("vectors differ in length")
                x = np.column_stack([np.ones(len(rows)), np.asarray(rows, dtype=np.float64)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            size = pa.array(np.full(len(i), len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([size, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["size", "i", "j", "value"])

    cells = vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "size int, i int, j int, value double")
    return cells.groupBy("size", "i", "j").agg(F.sum("value").alias("value"))


def component_variance(vectors: DataFrame, column: str, train: Column) -> DataFrame:
    """(component, eigenvalue, share) of the standardised training rows, largest first.

    The correlation matrix comes from summed outer products; its eigenvalues are
    found in one task that holds one number per pair of variables. A variable
    without spread has no part; without two training rows there are no components.
    """
    cells = moment_cells(vectors.where(train), column).groupBy().agg(F.collect_list(F.struct("size", "i", "j", "value")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for listed in pdf["cells"]:
                sizes = {c["size"] for c in listed}
                if len(sizes) > 1:
                    raise ValueError("vectors differ in length")
                if not sizes:
                    continue
                size = sizes.pop()
                m = np.zeros((size, size))
                for c in listed:
                    m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["value"]
                n = m[0, 0]
                if n < 2:
                    continue
                mean = m[0, 1:] / n
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                own = np.diag(cov)
                spread = own > 1e-12 * (np.diag(m)[1:] / n)
                sd = np.sqrt(np.where(spread, own, 1.0))
                corr = np.where(np.outer(spread, spread), cov / np.outer(sd, sd), 0.0)
                values = np.linalg.eigvalsh(corr)[::-1]
                total = values.sum()
                yield pd.DataFrame({"component": np.arange(1, size, dtype="int32"), "eigenvalue": values, "share": values / total if total > 0 else np.full(size - 1, np.nan)})

    return cells.mapInPandas(run, "component int, eigenvalue double, share double")


def factor_counts(variance: DataFrame, fixed: int = 2, cumulative: float = 0.9, elbow: float = 0.1, kaiser: float = 1.0) -> DataFrame:
    """(method, factors) by the four rules, as columns over the components; null where a rule finds none.

    ``fixed`` needs that many components; ``cumulative`` takes the first components
    that reach the share; ``elbow`` stops where a share rises by less than the bound
    on the one before; ``kaiser`` counts large eigenvalues. All but the fixed count
    leave one component out at least and one in.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("component")
    size = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    v = variance.select("component", "eigenvalue", size.alias("size"), F.sum("share").over(order).alias("reached"), (F.col("share") - F.lag("share").over(order)).alias("step"))
    rules = v.agg(
        F.max("size").alias("size"), F.min(F.when(F.col("reached") >= cumulative, F.col("component"))).alias("cumulative"),
        F.min(F.when(F.col("step") < elbow, F.col("component") - 1)).alias("elbow"), F.count_if(F.col("eigenvalue") > kaiser).cast("int").alias("kaiser"))
    kept = lambda c: F.greatest(F.lit(1), F.least(c, F.col("size").cast("int") - 1))
    found = {
        "fixed": F.when(F.col("size") >= fixed, F.lit(fixed)), "cumulative": F.when(F.col("cumulative").isNotNull(), kept(F.col("cumulative"))),
        "elbow": F.when(F.col("elbow").isNotNull(), kept(F.col("elbow"))), "kaiser": F.when(F.col("kaiser") > 0, kept(F.col("kaiser")))}
    return rules.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), k.cast("int").alias("factors")) for m, k in found.items()])))


def news_impacts(releases: DataFrame, predictions: DataFrame, gains: DataFrame, target: DataFrame, target_sd: Column) -> DataFrame:
    """Impact of each release on the target.

    ``releases`` (release_id, variable, ts, observed); ``predictions``
    (variable, ts, expected); ``gains`` (variable, ts, factor, gain);
    ``target`` (factor, loading). Prediction and gain are the latest ones not
    after the release; a release before the first of them has no impact row. All
    but the target grow with the variables and meet by sorting.
    """
    known = backward_asof(releases, predictions, ["variable"], "ts", "ts", "expected", "expected", long_right=True)
    stamps = gains.select("variable", "ts").distinct().withColumn("gain_ts", F.col("ts"))
    at = backward_asof(known, stamps, ["variable"], "ts", "ts", "gain_ts", "gain_ts", long_right=True)
    g = gains.select("variable", F.col("ts").alias("gain_ts"), "factor", "gain").hint("merge")
    out = at.where("expected is not null").join(g, ["variable", "gain_ts"]).join(target, "factor")
    innovation = F.col("observed") - F.col("expected")
    return out.groupBy("release_id", "variable", "ts", "observed", "expected").agg(
        (F.sum(F.col("loading") * F.col("gain") * innovation) * target_sd).alias("impact"), F.sqrt(F.sum(F.col("gain") * F.col("gain"))).alias("gain_size"))


def impact_shares(impacts: DataFrame) -> DataFrame:
    """Share of the absolute total; the impacts are staged, as both the total and the rows read them."""
    impacts = cut_lineage(impacts, "impacts")
    whole = impacts.agg(F.sum(F.abs("impact")).alias("a")).scalar()
    return impacts.withColumn("share_pct", F.when(whole > 0, F.abs("impact") / whole * 100).otherwise(0.0)).withColumn("is_positive", F.col("impact") > 0)


def normalise_impacts(impacts: DataFrame, change: Column, tiny: float = 1e-10) -> DataFrame:
    """Impacts scaled so that they add up to the actual change.

    A vanishing total or change has no scale; the rows then hold NULL, and
    ``require_scale`` turns that into an error.
    """
    impacts = cut_lineage(impacts, "impacts")
    raw = impacts.agg(F.sum("impact").alias("t")).scalar()
    scale = F.when((F.abs(raw) > tiny) & (F.abs(change) > tiny), change / F.when(F.abs(raw) > tiny, raw))
    return impacts.withColumn("scaled_impact", F.col("impact") * scale)


def require_scale(scaled: DataFrame) -> None:
    if scaled.where("scaled_impact is null").limit(1).count():
        raise QualityError("impacts cannot be scaled to the change")


def reconstruction_errors(observed: DataFrame, factors: DataFrame, weights: DataFrame, variable: str, period: str, value: str, phase: Column) -> DataFrame:
    """RMSE and MAE of each variable by phase; factors are long (period, factor, f).

    Only observed periods are fitted, and a variable's weights meet it by sorting:
    by the factor alone all variables would meet in one task.
    """
    pairs = observed.select(variable, period).distinct()
    weighted = pairs.join(weights.select(variable, "factor", "loading").hint("merge"), variable)
    fit = weighted.join(factors.select(period, "factor", "f"), [period, "factor"]).groupBy(variable, period).agg(F.sum(F.col("loading") * F.col("f")).alias("fitted"))
    r = F.col(value) - F.col("fitted")
    return observed.join(fit.hint("merge"), [variable, period]).groupBy(variable, phase.alias("phase")).agg(
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.count(r).alias("n"))


def weighted_score(errors: DataFrame, variable: str, train_weight: float) -> DataFrame:
    """Training and validation RMSE in one number; a lone phase counts alone."""
    pick = lambda p: F.max(F.when(F.col("phase") == p, F.col("rmse")))
    s = errors.groupBy(variable).agg(pick("training").alias("train_rmse"), pick("validation").alias("validation_rmse"))
    mixed = F.col("train_rmse") * train_weight + F.col("validation_rmse") * (1 - train_weight)
    return s.withColumn("score", F.coalesce(mixed, "train_rmse", "validation_rmse"))
