from datetime import date

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import rows
from periodica.functions import calendar as cal
from periodica.functions import text as tx
from periodica.operators import spine as sp
from periodica.operators import windows as win


def test_month_end_from_text(frame):
    df = frame([("2024-02",), ("2025-02",), ("2026-12",), ("2026-13",)], "t string").select("t", cal.month_end_from_text("t").alias("d"))
    assert rows(df, "t", "d")[:3] == [("2024-02", date(2024, 2, 29)), ("2025-02", date(2025, 2, 28)), ("2026-12", date(2026, 12, 31))]
    assert df.where("t = '2026-13'").first()["d"] is None


def test_window_start_clamps(frame):
    df = frame([(date(2024, 2, 29), 12), (date(2026, 3, 31), 1)], "d date, k int")
    got = {r["d"]: r["s"] for k in (12, 1) for r in df.where(f"k = {k}").select("d", cal.window_start("d", k).alias("s")).collect()}
    assert got == {date(2024, 2, 29): date(2023, 3, 1), date(2026, 3, 31): date(2026, 3, 1)}


def test_calendar_lag_over_gap(frame):
    df = frame([(date(2024, 4, 30), 50.0), (date(2024, 5, 31), 100.0), (date(2025, 5, 31), 110.0)], "p date, v double").withColumn("k", F.lit(1))
    got = df.select("p", F.round(sp.calendar_growth(["k"], "p", "v", 12), 6).alias("g")).collect()
    assert {r["p"]: r["g"] for r in got}[date(2025, 5, 31)] == 10.0


def test_ytd_to_month(frame):
    data = [(date(2025, 11, 30), 110.0), (date(2026, 1, 31), 10.0), (date(2026, 2, 28), 25.0), (date(2026, 4, 30), 60.0), (date(2026, 5, 31), 80.0)]
    df = frame(data, "p date, v double").withColumn("k", F.lit(1))
    got = {r["p"].month: r["m"] for r in df.select("p", win.ytd_to_month(["k"], "p", "v").alias("m")).collect()}
    assert got == {11: None, 1: 10.0, 2: 15.0, 4: None, 5: 20.0}
    assert sp.duplicate_periods(df.unionByName(df.limit(1)), ["k"], "p", "month").count() == 1


def test_friday_rules_every_day(spark):
    days = spark.sql("select explode(sequence(date'2018-01-01', date'2025-12-31')) as d")
    for unit in ("month", "quarter", "year"):
        got = days.select("d", cal.period_friday("d", unit).alias("f"), cal.bucket_start("d", unit).alias("s"))
        assert got.where((F.weekday("f") != 4) | (F.col("f") < F.col("s")) | (F.col("f") > cal.bucket_end("s", unit))).count() == 0
    got = days.select("d", cal.dekad_friday("d").alias("f"))
    assert got.where((F.weekday("f") != 4) | (F.month("f") != F.month("d"))).count() == 0
    assert days.where(F.weekday("d") < 5).where(cal.nearest_friday("d") < F.col("d")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40))
def test_intervals_cover_days(spark, days):
    df = spark.createDataFrame([(date.fromordinal(730000 + d),) for d in days], "day date").withColumn("k", F.lit(1))
    got = rows(win.date_intervals(df, ["k"], "day"), "first_day", "last_day", "days")
    rebuilt = {a.toordinal() - 730000 + i for a, b, n in got for i in range(n)}
    assert rebuilt == days
    assert all((c[0] - a[1]).days > 1 for a, c in zip(got, got[1:]))


def test_parse_month_forms(frame):
    cases = {"1704067200": 2024, "1704067200000": 2024, "20240105": 2024, "2024-01-05T10:00": 2024, "5/1/2024": 2024, "05-01-2024": 2024, "5.1.2024": 2024}
    df = frame([(k,) for k in [*cases, "junk", "20241399"]], "t string").select("t", tx.parse_month("t").alias("m"))
    got = {r["t"]: r["m"] for r in df.collect()}
    assert all(got[k] == date(2024, 1, 1) for k in cases) and got["junk"] is None and got["20241399"] is None


def test_names_and_periods(frame):
    df = frame([("指标：（甲）  乙",)], "t string")
    assert df.select(tx.normalise_name("t").alias("x")).first()["x"] == "指标: (甲) 乙"
    p = frame([("2023年第三季度平均",), ("2022年下半年日均",), ("2021年5月平均",), ("2020年平均",), ("2020-03-04",), ("?",)], "t string").select("t", tx.observation_period(F.col("t")).alias("p"))
    got = {r["t"]: (r["p"]["code"], r["p"]["end"]) for r in p.collect()}
    assert got["2023年第三季度平均"] == ("2023-Q3", date(2023, 9, 30)) and got["2022年下半年日均"] == ("2022-H2", date(2022, 12, 31))
    assert got["2021年5月平均"] == ("2021-05", date(2021, 5, 31)) and got["2020-03-04"] == (None, date(2020, 3, 4)) and got["?"] == (None, None)
