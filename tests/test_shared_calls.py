"""Python calls whose cost must not grow with the number of keys or the length of rows."""

import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from periodica.session import ARROW_BYTES, prepare_session
from periodica.streaming import pipelines as pl
from periodica.streaming import processors as pr


def test_arrow_batches_are_bounded_in_bytes(spark):
    prepare_session(spark)

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert texts.select(F.max(held("t"))).first()[0] <= ARROW_BYTES + 20_000


class State:
    """A group state whose timers fire as Spark's do."""

    def __init__(self):
        self.body, self.due, self.mark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.body is not None)
    get = property(lambda self: (self.body,))

    def update(self, value):
        self.body, self.due = value[0], None

    def remove(self):
        self.body = self.due = None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, due):
        assert due > self.mark
        self.due = due


def test_a_bucket_runs_each_vessel_by_its_own_timer():
    calls = []

    def function(key, batches, state):
        rows = sum(len(b) for b in batches)
        calls.append((key[0], rows, state.hasTimedOut, state.get[0] if state.exists else None))
        if state.hasTimedOut:
            state.remove()
        else:
            total = rows + (int(state.get[0]) if state.exists else 0)
            state.update((str(total),))
            state.setTimeoutTimestamp({"a": 100, "b": 200}.get(key[0], 300))
            yield pd.DataFrame({"mmsi": [key[0]], "total": [total]})

    state, bucket = State(), pr.Vessels(function, newest=True)
    batch = lambda *ids: pd.DataFrame({"mmsi": list(ids)})
    out = pd.concat(bucket((7,), iter([batch("a", "b", None), batch("a")]), state))
    assert sorted(out.itertuples(index=False, name=None), key=str) == sorted([("a", 2), ("b", 1), (None, 1)], key=str)
    assert state.due == 100 and len(json.loads(state.body)) == 3
    calls.clear()
    state.mark = 150  # b reports while a's timer has run out
    list(bucket((7,), iter([batch("b")]), state))
    assert calls == [("b", 1, False, "1"), ("a", 0, True, "2")] and state.due == 200
    state.mark, state.hasTimedOut = 301, True
    assert list(bucket((7,), iter([]), state)) == [] and not state.exists


def test_newest_rows_and_missing_values():
    t = datetime(2024, 1, 1)
    at = lambda m: None if m is None else t + timedelta(minutes=m)
    data = [(0, 0, "position", 1.0, None, None), (5, 1, "position", 2.0, 3.0, None), (5, 1, "position", 4.0, None, None), (1, 2, "static", None, None, "x"), (1, 2, "static", None, None, "y"), (9, 9, "static", None, None, None)]
    pdf = pd.DataFrame({
        "observed": pd.to_datetime([at(r[0]) for r in data]), "received": pd.to_datetime([at(r[1]) for r in data]), "kind": [r[2] for r in data],
        "lat": [r[3] for r in data], "lon": 9.0, "sog": pd.Series([r[4] for r in data], dtype="float64"), "name": [r[5] for r in data], "call_sign": None, "destination": None, "category": None})
    (out,) = pr.latest_vessel(("v",), iter([pdf]), State())
    row = out.iloc[0]
    assert (row["observed"], row["received"], row["lat"], row["sog"], row["static"]) == (at(5), at(1), 4.0, None, '{"name": "y"}')


def test_vessels_share_calls(spark, frame, tmp_path):
    rows = [(f"v{i}", datetime(2024, 1, 1) + timedelta(minutes=m)) for i in range(40) for m in (0, 1)]
    frame(rows, "mmsi string, observed timestamp").write.parquet(str(tmp_path / "in"))
    r = spark.readStream.schema("mmsi string, observed timestamp").parquet(str(tmp_path / "in"))
    no = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    vessels = r.select("mmsi", "observed", F.col("observed").alias("received"), F.lit("position").alias("kind"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), no("sog", "double"), *[no(n) for n in pr.STATIC_FIELDS])
    stream = pl.latest_vessels(vessels)
    assert "bucket" in stream._jdf.queryExecution().analyzed().toString()
    got = pl.run_to_parquet(stream, "t").select("mmsi", F.minute("observed")).collect()
    assert sorted(map(tuple, got)) == sorted((f"v{i}", 1) for i in range(40))
