from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from periodica.functions.measures import exact_median
from periodica.operators import aggregates as ag
from periodica.operators import chunked, windows as win
from periodica.operators import filters as fl
from periodica.plans import growth as gr
from periodica.plans import industrial as ind
from periodica.plans import prices as pr
from periodica.plans import preview as pv
from periodica.operators.joins import unpivot_weights


def test_complete_daily_totals(frame):
    d = lambda n: date(2024, 1, n)
    data = [("a", d(1), 0.0), ("b", d(1), 0.0), ("a", d(2), 5.0), ("a", d(4), 7.0), ("b", d(4), -1.0), ("a", d(5), 2.0), ("b", d(5), 4.0)]
    got = {r["day"].day: r["v"] for r in ag.daily_totals(frame(data, "node string, day date, v double"), "day", ["v"], 2).collect()}
    assert got == {1: 0.0, 2: None, 4: None, 5: 6.0}


def test_clipped_buckets(frame):
    data = [(date.fromordinal(date(2025, 12, 29).toordinal() + i), 1.0) for i in range(8)]
    df = frame(data, "day date, v double").withColumn("k", F.lit(1))
    values = lambda unit, x=df: [r["v"] for r in ag.bucket_sums(x, ["k"], "day", ["v"], unit).orderBy("bucket").collect()]
    assert values("week") == [7.0, 1.0] and values("month") == [3.0, 5.0] and values("year") == [3.0, 5.0]
    assert values("month", df.where(F.col("day") != date(2026, 1, 2))) == [3.0, None]


def test_quarter_needs_three_months(frame):
    df = frame([(date(2024, 1, 31), 1000.0), (date(2024, 2, 29), 2000.0), (date(2024, 3, 31), 3000.0), (date(2024, 4, 30), 4000.0)], "p date, v double").withColumn("k", F.lit(1))
    got = ag.quarterly_day_weighted(df, ["k"], "p", "v").collect()
    assert len(got) == 1 and got[0]["quarter"] == date(2024, 3, 31)
    assert got[0]["value"] == pytest.approx((31 * 1000 + 29 * 2000 + 31 * 3000) / 91)


def test_first_appearance(frame):
    data = [("7", "m1"), ("7", "m2"), ("0", "m1"), (None, "m1"), ("9", "m3"), ("", "m2")]
    got = rows(ag.first_appearance(frame(data, "id string, m string"), F.col("id"), F.col("m")), "month", "new_ids")
    assert got == [("m1", 1), ("m3", 1)]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_median(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 104729).cast("double").alias("v"))
    want = sorted((i * 7919) % 104729 for i in range(n))
    mid = (want[(n - 1) // 2] + want[n // 2]) / 2
    assert exact_median(df, ["g"], "v", "m").first()["m"] == mid


def test_chunked_equals_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(400).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 37).alias("c"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    out = chunked.last_before(chunked.running_sum(df, ["k"], "c", ["id"], F.col("id"), "run"), ["k"], "c", ["id"], F.col("v"), "last")
    w = Window.partitionBy("k").orderBy("id")
    want = df.select("id", F.sum("id").over(w).alias("run"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    assert sorted(map(str, out.select("id", "run", "last").collect())) == sorted(map(str, want.collect()))


def parts(frame):
    data = [(q, n, v) for q, a, b in ((1, 20.0, 80.0), (2, 40.0, 80.0)) for n, v in (("a", a), ("b", b))]
    return frame(data, "q int, n string, v double"), frame([(1, 100.0), (2, 120.0)], "q int, total double")


def test_contributions_use_level_change(frame):
    p, t = parts(frame)
    got = rows(gr.growth_contributions(p, t, "n", "q", "v", 1).where("q = 2"), "n", "contribution")
    assert got == [("a", 20.0), ("b", 0.0)]
    r = gr.additivity(frame([(1, "a", 42.0), (1, "b", 51.0)], "q int, n string, v double"), frame([(1, 105.0)], "q int, total double"), "q", "v").first()
    assert r["residual"] == 12.0 and not r["within_tolerance"]
    zero = gr.growth_contributions(p, frame([(1, 0.0), (2, 100.0)], "q int, total double"), "n", "q", "v", 1)
    with pytest.raises(ValueError):
        gr.check_positive_base(zero)


def test_sector_uses_overall_growth(frame):
    w = unpivot_weights(frame([("x", 0.2)], "i string, weight_2020 double"), "i")
    period = date(2024, 5, 31)
    out = ind.sector_contributions(frame([(period, "s", 10.0)], "p date, sector string, growth double"), w, frame([("x", "s")], "i string, sector string"), "i", "p", "sector")
    assert out.first()["contribution"] == 2.0
    g = ind.weighted_contributions(frame([("x", period, 100.0)], "i string, p date, g double"), w, "i", "p", "g")
    assert g.first()["contribution"] == 20.0
    with pytest.raises(ValueError):
        ind.sector_contributions(frame([(period, "s", 10.0)], "p date, sector string, growth double"), w, frame([("x", "other")], "i string, sector string"), "i", "p", "sector")


def test_year_reference_never_borrows(frame):
    df = frame([("i", date(2023, 12, 31), 100.0, "yearly", "AED", "flow"), ("i", date(2025, 12, 31), 120.0, "yearly", "AED", "flow")], "k string, p date, v double, f string, u string, t string")
    r = pv.summary(df, "k", "p", "v", "f", "u", "t").first()
    assert r["previous"] is None and r["two_years_ago"] == 100.0


def test_smoothing_keeps_quadratics(spark):
    df = spark.range(12).select(F.lit("k").alias("k"), "id", (F.col("id") * F.col("id") - 3 * F.col("id") + 2).cast("double").alias("v"))
    out = pr.smooth(df, ["k"], "id", "v", "s")
    assert out.where(F.abs(F.col("s") - F.col("v")) > 1e-9).count() == 0
    assert pr.smooth(df.where("id < 2"), ["k"], "id", "v", "s").where("s <> v").count() == 0


def test_streak_breaks_on_missing(frame):
    df = frame([(i, v) for i, v in enumerate([1.0, 2.0, None, 3.0, -1.0, 4.0])], "i int, v double").withColumn("k", F.lit(1))
    assert [r["s"] for r in win.positive_streak(df, ["k"], "i", "v", "s").orderBy("i").collect()] == [1, 2, None, 1, 0, 1]


def test_gap_fill_stays_inside(frame):
    df = frame([(i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "i int, v double").withColumn("k", F.lit(1))
    got = lambda m: [r["x"] for r in win.fill_gaps(df, ["k"], "i", "v", m, "x").orderBy("i").collect()]
    assert got("linear") == [None, 1.0, 2.0, 3.0, 4.0, None] and got("ffill") == [None, 1.0, 1.0, 1.0, 4.0, None] and got("bfill") == [None, 1.0, 4.0, 4.0, 4.0, None]


def test_condition_rules_see_nulls(frame):
    df = frame([("a", date(2024, 1, 1), None), ("a", date(2024, 1, 2), 3.0)], "k string, p date, v double")
    rules = [fl.ReplacementRule("a", "condition", condition="isnull", replace_with=9.0), fl.ReplacementRule("a", "condition", condition="lt", value=5.0)]
    assert rows(fl.apply_rules(df, rules, "k", "p", "v"), "p", "v") == [(date(2024, 1, 1), 9.0), (date(2024, 1, 2), None)]


def test_last_sample_stock(frame):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    data = [("1", t(6), "a", 1), ("2", t(9), "a", 2), ("2", t(10), "b", 3), ("3", t(10, 30), "a", 4)]
    df = frame(data, "mmsi string, observed timestamp, region string, event_id int")
    assert rows(ag.last_sample_stock(df, "day"), "region", "vessels") == [("a", 1), ("b", 1)]
