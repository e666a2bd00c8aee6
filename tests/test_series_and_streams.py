import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from periodica.functions import geo
from periodica.plans import factors as fa
from periodica.plans import forecasts as fc
from periodica.plans import series_pairs as sp
from periodica.plans import series_tests as st
from periodica.plans import warping as wp
from periodica.streaming import entries as en
from periodica.streaming import pipelines as pl
from periodica.streaming.processors import advance

DAY = lambda i: date.fromordinal(738000 + i)
SER = "series string, ts date, value double"


def series(frame, name, values):
    return frame([(name, DAY(i), None if v is None else float(v)) for i, v in enumerate(values)], SER)


PAIRS = "target string, candidate string"


def test_constant_against_varying(frame):
    s = series(frame, "a", [0] * 20).unionByName(series(frame, "b", [i % 6 for i in range(20)]))
    scan, best = sp.lead_lag_scan(s, frame([("a", "b")], PAIRS), 2)
    assert scan.count() == 5 and best.first()["kl"] > 0


def test_warp_distance_brute():
    rnd = np.random.default_rng(1)
    for n, m, radius in ((5, 7, None), (9, 9, 2), (6, 4, 3)):
        a, b = rnd.normal(size=n), rnd.normal(size=m)
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                if radius is None or abs(i - j) <= radius:
                    d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert wp.warp_distance(a, b, radius) == pytest.approx(np.sqrt(d[n, m]))


def test_dtw_reasons(frame):
    s = series(frame, "a", range(12)).unionByName(series(frame, "b", range(12))).unionByName(series(frame, "c", range(3)))
    got = {r["candidate"]: (r["distance"], r["reason"]) for r in wp.dtw_distances(s, frame([("a", "b"), ("a", "c")], PAIRS)).collect()}
    assert got == {"b": (0.0, None), "c": (None, "insufficient_data")}
    with pytest.raises(ValueError):
        wp.dtw_distances(s, frame([("a", "b")], PAIRS), radius=0)


def test_least_squares_matches_numpy(frame):
    rnd = np.random.default_rng(2)
    x, z = rnd.normal(size=30), rnd.normal(size=30)
    y = 2 * x - 3 * z + 1 + rnd.normal(size=30) * 0.01
    df = frame([("g", float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "g string, x double, z double, y double")
    got = {r["term"]: r["coefficient"] for r in st.least_squares(df, ["g"], "y", ["x", "z"], constant=True).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(30), x, z]), y, rcond=None)[0]
    assert [got[k] for k in ("const", "x", "z")] == pytest.approx(want.tolist())


def test_scoring(frame):
    data = [("fit", 10.0, 11.0, 9.0, 9.0), ("fit", 12.0, 12.5, 10.0, 10.0), ("out", None, 13.0, 12.0, 12.0)]
    k = fc.score(frame(data, "phase string, actual double, predicted double, baseline double, reference double"), ["phase"])
    r = {x["phase"]: x for x in k.collect()}
    assert r["fit"]["valid"] == 2 and r["fit"]["win_rate"] == 0.5 and r["fit"]["direction_hit"] == 1.0
    assert r["out"]["valid"] == 0 and r["out"]["rmse"] is None and r["out"]["coverage"] == 0.0


def test_candidates(frame):
    s = frame([("a", "m1", float("inf"), 1), ("a", "m2", 2.0, 2), ("a", "m3", 2.0, 3)], "series string, model string, rmse double, ord int")
    assert fc.pick_best(s, ["series"], "rmse", "ord").first()["model"] == "m2"
    spark = s.sparkSession
    cost = {"x": 5.0, "y": 0.0, "z": 1.0}
    scores = lambda names: spark.range(1).select(F.lit(float(sum(cost[n] for n in names))).alias("score"))
    kept, history = fc.backward_select(scores, ["x", "y", "z"], keep_at_least=1)
    assert kept == ["y"] and [n for n, _ in history] == ["x", "z"]


def test_factor_rules(frame):
    v = frame([(i, e, s) for i, (s, e) in enumerate([(0.6, 3.0), (0.25, 1.2), (0.1, 0.5), (0.05, 0.3)], 1)], "component int, eigenvalue double, share double")
    pick = lambda **k: {r["method"]: r["factors"] for r in fa.factor_counts(v, **k).collect()}
    assert pick(elbow=0.0) == {"fixed": 2, "cumulative": 3, "kaiser": 2, "elbow": 1}
    assert pick(fixed=9, cumulative=2.0, kaiser=9.0, elbow=-0.2) == {"fixed": None, "cumulative": None, "kaiser": None, "elbow": 1}


def test_components_match_numpy(frame):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 5)) @ rnd.normal(size=(5, 5)) * [1, 10, 100, 0.1, 1] + [0, 5, 1000, 1, 0]
    x[:, 4] = 7.0
    data = [([float(v) for v in row], i % 3 > 0) for i, row in enumerate(x)] + [(None, True)]
    df = frame(data, "v array<double>, fit boolean").repartition(5)
    got = fa.component_variance(df, "v", F.col("fit")).orderBy("component").collect()
    train = x[[i for i in range(300) if i % 3 > 0]][:, :4]
    want = [*np.linalg.eigvalsh(np.corrcoef(train.T))[::-1], 0.0]
    assert [r["eigenvalue"] for r in got] == pytest.approx(want, abs=1e-8)
    assert [r["share"] for r in got] == pytest.approx([w / 4 for w in want], abs=1e-8)
    assert fa.component_variance(df.where("v is null"), "v", F.col("fit")).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        fa.component_variance(frame([([1.0], True), ([1.0, 2.0], True)], "v array<double>, fit boolean").repartition(1), "v", F.col("fit")).collect()


AREAS = {"a": (geo.inset_box(10, 20, 10, 20, 0.05), geo.inset_box(10, 20, 10, 20, -0.05))}
SIDE = {"o": 9.80, "?": 10.0, "i": 10.10}
START = datetime(2024, 1, 1)


def track(pattern, minutes=None):
    """'oii' with '_' as a 40 minute pause before the next report."""
    out, at = [], START
    for ch in pattern:
        if ch == "_":
            at += timedelta(minutes=40)
            continue
        at += timedelta(minutes=25)
        out.append((at, SIDE[ch], 15.0, "s"))
    return out


CASES = {"oii": [1], "oio": [], "o?ii": [2], "oi?ii": [3], "o_ii": [], "ii": [], "oiiooii": [1, 5], "oiii": [1], "?oii": [2], "_?iioii": []}
POINT = "mmsi string, observed timestamp, lat double, lon double, source string"


def test_entry_table(frame):
    pts = [(p, *x) for p in CASES for x in track(p)]
    got = en.detect_entries(frame(pts, POINT), AREAS, "hour")
    seen = {(r["mmsi"], r["entered"]) for r in got.collect()}
    assert seen == {(p, track(p)[i][0]) for p, hits in CASES.items() for i in hits}


def random_tracks(seed, n=6, length=120):
    rnd = random.Random(seed)
    rows_ = []
    for v in range(n):
        at = START
        for _ in range(length):
            at += timedelta(minutes=rnd.choice([10, 20, 25, 29, 45]))
            rows_.append((str(v), at, SIDE[rnd.choice("ooii?")] + rnd.random() * 0.001, 15.0, "s"))
    return rows_


def by_machine(rows_):
    out, memory = set(), {}
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 10**6)
    for m, at, lat, lon, src in sorted(rows_):
        memory[m], events = advance(memory.get(m, {}), (us(at), lat, lon, src), AREAS)
        out |= {(m, e[1], e[3]) for e in events}
    return out


def micros(df):
    return {(r["mmsi"], r["e"], r["c"]) for r in df.select("mmsi", F.unix_micros("entered").alias("e"), F.unix_micros("confirmed").alias("c")).collect()}


@pytest.mark.parametrize("seed", [5, 6])
def test_columns_equal_state_machine(frame, seed):
    data = random_tracks(seed)
    want = by_machine(data)
    assert want
    assert micros(en.detect_entries(frame(data, POINT), AREAS, "day")) == want
    late = [r for i, r in enumerate(data) if i % 17 == 3]
    early = frame([r for r in data if r not in late], POINT)
    stored = en.detect_entries(early, AREAS, "day")
    assert micros(en.replay(stored, frame(data, POINT), frame(late, POINT), AREAS, "day")) == want


def test_stream_equals_batch_on_shuffled_files(spark, frame, tmp_path):
    data = random_tracks(7, n=3, length=60)
    mixed = list(data)
    random.Random(3).shuffle(mixed)
    closing = [("end", max(r[1] for r in data) + timedelta(days=3), 0.0, 0.0, "s")]
    folder = str(tmp_path / "in")
    # Reports arrive out of order over two triggers; the lag covers the disorder.
    for part in (mixed[:-40], mixed[-40:], closing):
        frame(part, POINT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame(data, POINT).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = pl.run_to_parquet(pl.entries(stream, AREAS, "2 days"), "t")
    assert micros(got) == by_machine(data)


def test_closed_stream_gives_the_last_entries_and_days(spark, frame, tmp_path):
    data = sorted(random_tracks(7, n=3, length=60), key=lambda r: r[1])
    folder = str(tmp_path / "in")
    for part in (data[:-40], data[-40:]):
        frame(part, POINT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame(data, POINT).schema).parquet(folder)
    got = pl.run_closed(stream, lambda s: pl.entries(s, AREAS), "observed", timedelta(minutes=30), "t")
    assert micros(got) == by_machine(data)
    days = pl.run_closed(stream, lambda s: pl.daily_counts(s, "observed", F.lit("a")), "observed", timedelta(days=1, hours=1), "t")
    want = frame(data, POINT).groupBy(F.to_date("observed").alias("day")).count()
    assert rows(days, "day", "events") == rows(want, "day", "count")
    assert pl.run_closed(stream.where("mmsi = 'no such'"), lambda s: pl.entries(s, AREAS), "observed", timedelta(minutes=30), "t").count() == 0


def test_snapshot_fallback(frame):
    now = datetime(2024, 1, 11)
    data = [("1", now - timedelta(days=1)), ("2", now - timedelta(days=1, minutes=30)), ("3", now - timedelta(days=10))]
    r = frame([(m, at, at, "s", 1.0, 1.0) for m, at in data], "mmsi string, observed timestamp, received timestamp, source string, lat double, lon double")
    lit = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    assert pl.recent_snapshot(r, lit, 120).count() == 0
    assert rows(pl.recent_snapshot(r, lit, 120, fallback=True), "mmsi") == [("1",), ("2",)]


def test_flag_patch_and_idempotent_append(frame):
    schema = "mmsi string, observed timestamp, source string, flag string, flag_country string, received timestamp"
    t = datetime(2024, 1, 1)
    stored = frame([("1", t, "s", None, None, t)], schema)
    incoming = frame([("1", t, "s", "AE", "UAE", t), ("2", t, "s", None, None, t), ("2", t, "s", None, None, t)], schema)
    assert pl.append_new(stored, incoming).count() == 2
    assert rows(pl.enrich_flags(stored, incoming), "mmsi", "flag") == [("1", "AE")]
