"""Late reports beside a stream, a table that streams merge into, counters of running streams."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import rows
from periodica.session import shared_dir
from periodica.streaming import entries as en
from periodica.streaming import pipelines as pl
from periodica.streaming.versions import DayTable, replace_keys
from test_series_and_streams import AREAS, POINT, by_machine, micros, random_tracks

FLAGS = "mmsi string, observed timestamp, source string, flag string, flag_country string, received timestamp, day date"
KEYS = ["mmsi", "observed", "source"]


def landed(frame, parts, schema, folder):
    for part in parts:
        frame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("seed", [11])
def test_late_reports_go_to_the_replay(spark, frame, tmp_path, seed):
    data = random_tracks(seed, n=4, length=80)
    mixed = sorted(data, key=lambda r: r[1])
    held = random.Random(seed).sample(mixed, 30)
    folder = landed(frame, [[r for r in mixed if r not in held]], POINT, str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(data, POINT).schema).parquet(folder)
    found = pl.run_closed(
        stream, lambda s: pl.entries_and_late(s, AREAS), "observed", timedelta(minutes=30), "late", later=[frame(held[:20], POINT), frame(held[20:], POINT)])
    mark = max(r[1] for r in mixed if r not in held) - timedelta(minutes=30)
    late = [r for r in held if r[1] < mark]
    assert len(late) > 20
    got = pl.late_rows(found)
    assert rows(got, "mmsi", "observed", "lat") == sorted((r[0], r[1], r[2]) for r in late)
    want = by_machine(data)
    assert micros(pl.entry_rows(found)) != want
    assert micros(en.replay(pl.entry_rows(found), frame(data, POINT), got, AREAS, "day")) == want


def report(m, hour, flag=None, received=0, day=1):
    at = datetime(2024, 1, day) + timedelta(hours=hour)
    return (m, at, "s", flag, flag, at + timedelta(hours=received), at.date())


class Stopping(DayTable):
    """Fails before the list of a chosen batch, once."""

    stop_at = None

    def _write_list(self, days, batch):
        if batch == self.stop_at:
            self.stop_at = None
            raise RuntimeError("stopped")
        super()._write_list(days, batch)


@pytest.mark.parametrize("stop_at", [0, 2])
def test_flags_merge_over_batches(spark, frame, tmp_path, stop_at):
    batches = [
        [report("1", 1), report("1", 2, "CN"), report("2", 1, day=2), report("2", 1, day=2)],
        [report("1", 1, "AE", 1), report("1", 1, "US", 2), report("1", 2, None, 3), report("3", 5, "FR")],
        [report("2", 1, "DE", day=2), report("2", 1, "DE", day=2), report("3", 5, "FR", 9), report("4", 1, day=3)],
    ]
    table = Stopping(spark, str(tmp_path / "t"), FLAGS)
    table.stop_at = stop_at
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    failed = 0
    for part in batches:
        landed(frame, [part], FLAGS, folder)
        stream = spark.readStream.schema(FLAGS).parquet(folder)
        for _ in range(2):
            try:
                pl.run_each_batch(stream, run, lambda b, i: table.merge(b, i, pl.deliver_flags))
                break
            except StreamingQueryException:
                failed += 1
    assert failed == (stop_at is not None)
    assert table.batches() == [0, 1, 2]
    assert rows(table.read(), "mmsi", "day", "flag") == [
        ("1", date(2024, 1, 1), "CN"), ("1", date(2024, 1, 1), "US"), ("2", date(2024, 1, 2), "DE"), ("3", date(2024, 1, 1), "FR"), ("4", date(2024, 1, 3), None)]
    # Days that a batch does not touch stay where they were written.
    assert {d: v for d, v in table._versions().items()} == {date(2024, 1, 1): 2, date(2024, 1, 2): 2, date(2024, 1, 3): 2}
    table.merge(frame(batches[1], FLAGS), 1, lambda a, b: a.limit(0))
    assert table.read().count() == 5


def test_table_without_rows(spark, frame, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "k string")
    assert table.read().count() == 0 and table.batches() == []
    table.merge(frame([], "k string, day date"), 0, replace_keys(["k"]))
    assert table.read().count() == 0 and table.batches() == [0]
    with pytest.raises(ValueError):
        table.merge(frame([("a", None)], "k string, day date"), 1, replace_keys(["k"]))
    assert table.batches() == [0]


def test_counts_are_replaced_as_they_grow(spark, frame, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "area string, events long")
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    parts = [[(datetime(2024, 1, 1, h), "a") for h in range(5)], [(datetime(2024, 1, 1, 7), "a"), (datetime(2024, 1, 1, 8), "b"), (datetime(2024, 1, 2), "a")]]
    for part in parts:
        landed(frame, [part], "ts timestamp, area string", folder)
        stream = spark.readStream.schema("ts timestamp, area string").parquet(folder)
        counts = pl.daily_counts(stream, "ts", F.col("area"))
        pl.run_each_batch(counts, run, lambda b, i: table.merge(b, i, replace_keys(["day", "area"])), mode="update")
    assert rows(table.read(), "day", "area", "events") == [(date(2024, 1, 1), "a", 6), (date(2024, 1, 1), "b", 1), (date(2024, 1, 2), "a", 1)]


def test_counters_of_a_running_stream(spark, frame, tmp_path):
    folder = landed(frame, [[(1, None), (2, "bad"), (3, "old")], [(4, None)], [(6, None), (5, "late")]], "event_id long, reason string", str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, reason string").option("maxFilesPerTrigger", 1).parquet(folder)
    table = pl.counted_run(stream, "reason", "counted")
    assert table.count() == 3
    assert [tuple(r) for r in pl.total_counters(table).collect()] == [(6, 3, "late")]
    nothing = pl.counted_run(stream.where("event_id > 9"), "reason", "nothing")
    assert [tuple(r) for r in pl.total_counters(nothing).collect()] == [(None, None, None)]


def test_counters_of_a_batch(spark, frame):
    from pyspark.sql import Observation

    seen = Observation("b")
    pl.observed_counts(frame([(1, "x"), (2, None)], "event_id long, reason string"), "reason", seen).collect()
    assert seen.get == {"raw": 2, "rejected": 1, "last_order": 1, "last_reason": "x"}
    assert shared_dir(spark, "a") != shared_dir(spark, "a")
