"""Rules added after the first review."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from periodica.functions import text as tx
from periodica.operators import joins as jn, windows as win
from periodica.plans import preview as pv, series_pairs as spairs
from periodica.session import shared_dir, shared_root


def test_brackets_at_any_depth(frame):
    rows = [("a(1(2(3(4(5)))))", "a"), ("b" + "（1(2" * 3 + ")）" * 3, "b"), ("c(open", "c(open"), ("(all)", ""), (None, None), ("d)e(", "d)e("), ("x" + "(" * 40 + "y" + ")" * 40, "x")]
    df = frame(rows, "s string, want string").select(tx.strip_parentheses("s").alias("got"), "want")
    assert [r["got"] for r in df.collect()] == [w for _, w in rows]


def test_logs_refuse_values_that_are_not_positive(frame):
    df = frame([("a", 1, 2.0), ("a", 2, 0.0)], "k string, p int, v double")
    with pytest.raises(PySparkException, match="logs need positive values"):
        df.select(win.transform_series(["k"], "p", "v", "log")).collect()
    good = frame([("a", 1, 1.0), ("a", 2, None)], "k string, p int, v double")
    assert [r[0] for r in good.select(win.transform_series(["k"], "p", "v", "log")).collect()] == [0.0, None]


def test_shared_folder_is_stable_and_fresh(spark):
    assert shared_root(spark) == shared_root(spark)
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert shared_dir(spark, "x").startswith(shared_root(spark))


def test_cluster_without_a_shared_folder_is_an_error():
    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

        def getConf(self):
            return {}

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(session)


def test_quarterly_season(frame):
    rows = [("a", f"{y}-{m:02d}-28", float(y + m)) for y in range(1995, 2002) for m in (3, 6, 9, 12)]
    df = frame(rows, "k string, d string, v double").withColumn("d", F.col("d").cast("date"))
    band = {r["season"]: r for r in pv.seasonal_band(df, "k", "d", "v", "quarterly", 2001).collect()}
    assert sorted(band) == [1, 2, 3, 4] and band[2]["current"] == 2007.0 and band[2]["hist_min"] == 2001.0


def test_backward_asof_edges(frame):
    left = frame([("a", "2020-01-01"), ("a", "2020-01-02"), ("a", "2020-03-15"), ("a", "2021-09-01"), ("b", "2020-01-05"), (None, "2020-02-01")], "k string, at string").withColumn("at", F.col("at").cast("date"))
    right = frame([("a", "2020-01-02", 1.0), ("a", "2020-03-20", 2.0), (None, "2020-01-31", 9.0), ("a", "2020-02-01", None)], "k string, p string, v double").withColumn("p", F.col("p").cast("date"))
    got = [(r["k"], str(r["at"]), r["x"]) for r in jn.backward_asof(left, right, ["k"], "at", "p", "v", "x").collect()]
    assert sorted(got, key=str) == sorted([("a", "2020-01-01", None), ("a", "2020-01-02", 1.0), ("a", "2020-03-15", 1.0), ("a", "2021-09-01", 2.0), ("b", "2020-01-05", None), (None, "2020-02-01", 9.0)], key=str)


def test_target_pairs(frame):
    pairs = spairs.target_pairs(frame([("a",), ("b",), ("b",), ("c",)], "series string"), "a")
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("a", "c")]
