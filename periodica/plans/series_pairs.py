"""Pairs of series at many lags: histograms, divergence, lead-lag scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.measures import zscore

PAIR = ["target", "candidate"]
MIN_SAMPLES = 10  # fixed value
SMOOTHING = 1e-9  # fixed value


def indexed(series: DataFrame) -> DataFrame:
    """Row index and length per series; one row per (series, ts)."""
    w = Window.partitionBy("series").orderBy("ts")
    return series.select(
        "series", "ts", "value", F.row_number().over(w).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy("series")).alias("n"),
    )


def target_pairs(series: DataFrame, target: str) -> DataFrame:
    """The target beside every other series, one row each."""
    names = series.select("series").where(F.col("series") != target).distinct()
    return names.select(F.lit(target).alias("target"), F.col("series").alias("candidate"))


def lagged_pairs(series: DataFrame, pairs: DataFrame, max_lag: int) -> DataFrame:
    """Aligned values at each lag; a positive lag means the candidate leads.

    Lags are rows, so all of them share one shuffle on (candidate, index).
    """
    ix = indexed(series)
    left = (
        pairs.join(ix.select(F.col("series").alias("target"), F.col("value").alias("x"), "i", F.col("n").alias("n1")), "target")
        .withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
        .withColumn("j", F.col("i") - F.col("lag"))
    )
    right = ix.select(F.col("series").alias("candidate"), F.col("value").alias("y"), F.col("i").alias("j"), F.col("n").alias("n2"))
    return left.join(right, ["candidate", "j"]).where(F.abs("lag") < F.least("n1", "n2")).select(
        "target", "candidate", "lag", "i", "x", "y"
    )


def pair_frame(series: DataFrame, pairs: DataFrame, standardise: bool = True) -> DataFrame:
    """Both series of a pair on the union of their times, with a common position."""
    s = series.select("series", "ts", "value")
    x = pairs.join(s.withColumnsRenamed({"series": "target", "value": "x"}), "target").withColumn("y", F.lit(None).cast("double"))
    y = pairs.join(s.withColumnsRenamed({"series": "candidate", "value": "y"}), "candidate").withColumn("x", F.lit(None).cast("double"))
    both = x.unionByName(y).groupBy(*PAIR, "ts").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    whole, w = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR).orderBy("ts")
    out = both.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(whole))
    if standardise:
        for c in ("x", "y"):
            out = out.withColumn(c, zscore(F.col(c), F.avg(c).over(whole), F.stddev_samp(c).over(whole)))
    return out


def pair_lags(frame: DataFrame, max_lag: int) -> DataFrame:
    """Valid value pairs of each lag from a pair frame."""
    left = frame.where("x is not null").select(*PAIR, "i", "n", "x", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    left = left.where(F.abs("lag") < F.col("n")).withColumn("j", F.col("i") - F.col("lag"))
    right = frame.where("y is not null").select(*PAIR, F.col("i").alias("j"), "y")
    return left.join(right, [*PAIR, "j"]).select(*PAIR, "lag", "x", "y")


def bin_count(n: Column) -> Column:
    """Bins for n samples: the smaller of the root and the log rule, at least two."""
    return F.greatest(F.lit(2), F.ceil(F.least(F.sqrt(n), 10 * F.log10(n))).cast("int"))


def shared_histogram(pairs: DataFrame, keys: list[str], minimum: int = MIN_SAMPLES) -> DataFrame:
    """Share of both samples in common bins, one row per occupied bin."""
    whole = Window.partitionBy(*keys)
    lo = F.least(F.min("x").over(whole), F.min("y").over(whole))
    hi = F.greatest(F.max("x").over(whole), F.max("y").over(whole))
    rows = pairs.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_n") >= minimum)
    b = bin_count(F.col("_n"))
    span = F.col("_hi") - F.col("_lo")
    place = lambda v: F.when(span == 0, 0).otherwise(F.least(F.floor((v - F.col("_lo")) / F.when(span != 0, span) * b), b - 1)).cast("int")
    sides = F.array(F.struct(place(F.col("x")).alias("bin"), F.lit(1).alias("p"), F.lit(0).alias("q")), F.struct(place(F.col("y")).alias("bin"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    flat = rows.select(*keys, "_n", F.when(span == 0, 1).otherwise(b).alias("bins"), F.inline(sides))
    return flat.groupBy(*keys, "_n", "bins", "bin").agg((F.sum("p") / F.col("_n")).alias("p"), (F.sum("q") / F.col("_n")).alias("q")).withColumnRenamed("_n", "samples")


def kl_divergence(hist: DataFrame, keys: list[str], smoothing: float = SMOOTHING) -> DataFrame:
    """Smoothed divergence per key; bins empty on both sides add nothing and need no rows."""
    norm = 1.0 + F.col("bins") * smoothing
    p, q = (F.col("p") + smoothing) / norm, (F.col("q") + smoothing) / norm
    return hist.groupBy(*keys, "samples").agg(F.greatest(F.lit(0.0), F.sum(p * (F.ln(p) - F.ln(q)))).alias("kl"))


def lead_lag_scan(series: DataFrame, pairs: DataFrame, max_lag: int, best_within: int = 5, standardise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Divergence at every lag, and the best lag of each pair near zero (smallest on ties)."""
    keys = [*PAIR, "lag"]
    scan = kl_divergence(shared_histogram(pair_lags(pair_frame(series, pairs, standardise), max_lag), keys), keys)
    near = scan.where(F.abs("lag") <= best_within)
    best = near.groupBy(*PAIR).agg(F.min_by(F.struct("lag", "kl"), F.struct("kl", "lag")).alias("_b")).select(*PAIR, "_b.*")
    return scan, best


def autocorrelation(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """Autocorrelation of each series up to its own largest lag, n // 2 - 1."""
    valid = series.where("value is not null")
    ix = indexed(valid).withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy("series")))
    var = ix.groupBy("series").agg(F.sum(F.col("d") * F.col("d")).alias("_v"))
    top = F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int") - 1)
    left = ix.where("n >= 4").select("series", "i", "d", F.explode(F.sequence(F.lit(1), top)).alias("lag")).withColumn("j", F.col("i") - F.col("lag"))
    right = ix.select("series", F.col("i").alias("j"), F.col("d").alias("e"))
    cov = left.join(right, ["series", "j"]).groupBy("series", "lag").agg(F.sum(F.col("d") * F.col("e")).alias("_c"))
    return cov.join(var, "series").select("series", "lag", (F.col("_c") / F.when(F.col("_v") != 0, F.col("_v"))).alias("acf"))
