"""Stream assembly: sources, deduplication, windows, sinks and counters."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructField, StructType

from periodica.operators.latest import latest_by
from periodica.session import shared_dir
from periodica.streaming.processors import BUCKETS, ENTRY_SCHEMA, LATEST_SCHEMA, STATE_SCHEMA, EntryDetector, Vessels, latest_vessel

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of many vessels belongs in the disk-backed store, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def deduplicated(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Repeated (vessel, instant, source) reports within the watermark are dropped."""
    return stream.withWatermark("observed", delay).dropDuplicatesWithinWatermark(["mmsi", "observed", "source"])


def enrich_flags(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored reports with flag fields filled from later deliveries that carry a flag.

    Meant for ``foreachBatch``; keys are (mmsi, observed, source).
    """
    keys = ["mmsi", "observed", "source"]
    # Several deliveries of one report: the last one by arrival wins.
    new = incoming.where("flag is not null").groupBy(*keys).agg(F.max_by(F.struct("flag", "flag_country"), "received").alias("_n"))
    j = stored.join(new, keys, "left")
    changed = F.col("_n").isNotNull() & (~F.col("flag").eqNullSafe(F.col("_n.flag")) | ~F.col("flag_country").eqNullSafe(F.col("_n.flag_country")))
    return j.withColumns({
        "flag": F.when(changed, F.col("_n.flag")).otherwise(F.col("flag")),
        "flag_country": F.when(changed, F.col("_n.flag_country")).otherwise(F.col("flag_country"))}).drop("_n")


def append_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows plus incoming ones with a key not stored yet, one per key."""
    keys = ["mmsi", "observed", "source"]
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    return stored.unionByName(once.join(stored.select(*keys), keys, "left_anti"))


def by_vessel(stream: DataFrame, function: Callable, schema: str, newest: bool) -> DataFrame:
    """A stateful function of one vessel over a stream with a watermark; vessels share calls by a hash of their id."""
    rows = stream.withColumn("bucket", F.pmod(F.xxhash64("mmsi"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(Vessels(function, newest).__call__, schema, STATE_SCHEMA, "append", "EventTimeTimeout")


def entries_and_late(stream: DataFrame, areas: dict, delay: str = "30 minutes") -> DataFrame:
    """Area entries of a position stream, and the reports that came too late for it (rows without an area).

    Spark itself drops rows older than the watermark before a state function sees
    them. So each report is two rows: its instant, which moves the watermark, and
    its content, which has no event time of its own and always arrives.
    """
    content = ["observed", "lat", "lon", "source"]
    nothing = [F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in content]
    instant = F.struct("mmsi", F.col("observed").alias("clock"), *nothing)
    report = F.struct("mmsi", F.lit(None).cast("timestamp").alias("clock"), *content)
    both = stream.select(F.inline(F.array(instant, report)))
    return by_vessel(both.withWatermark("clock", delay), EntryDetector(areas), ENTRY_SCHEMA, newest=False)


def entry_rows(found: DataFrame) -> DataFrame:
    return found.where("area is not null").select("mmsi", "area", "entered", "before", "confirmed", "source")


def late_rows(found: DataFrame) -> DataFrame:
    return found.where("area is null").select("mmsi", "observed", "lat", "lon", "source")


def entries(stream: DataFrame, areas: dict, delay: str = "30 minutes") -> DataFrame:
    """Area entries of a position stream."""
    return entry_rows(entries_and_late(stream, areas, delay))


def latest_vessels(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Latest enriched state of each vessel that reported in the trigger."""
    return by_vessel(stream.withWatermark("observed", delay), latest_vessel, LATEST_SCHEMA, newest=True)


def daily_counts(stream: DataFrame, stamp: str, area: Column, delay: str = "1 hour") -> DataFrame:
    """Events per area and day, emitted once the watermark has passed the day."""
    return stream.withWatermark(stamp, delay).groupBy(F.window(stamp, "1 day"), area.alias("area")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").cast("date").alias("day"), "area", "events")


def recent_snapshot(reports: DataFrame, now: Column, minutes: int = 120, fallback: bool = False) -> DataFrame:
    """Newest report of each vessel in the trailing window.

    With ``fallback`` a window that holds nothing moves to the newest report.
    """
    cutoff = now - F.expr(f"interval {max(0, minutes)} minutes")
    if fallback:
        newest = reports.agg(F.max("observed").alias("m")).scalar()
        cutoff = F.when(newest < cutoff, newest - F.expr(f"interval {max(0, minutes)} minutes")).otherwise(cutoff)
    rows = reports.where(F.col("observed") >= cutoff)
    return latest_by(rows, ["mmsi"], [("observed", False), ("received", False), ("source", True)], ["lat", "lon"])


def ingest_counters(tagged: DataFrame, reason: str) -> DataFrame:
    return tagged.agg(
        F.count(F.lit(1)).alias("raw"), F.count(reason).alias("rejected"), F.max_by(reason, F.when(F.col(reason).isNotNull(), F.col("event_id"))).alias("last_reason"))


def observed_counts(df: DataFrame, reason: str, observation: Observation | str, order: str = "event_id") -> DataFrame:
    """The same counters as a side metric of a running job or stream; ``order`` tells which reason is the last."""
    rejected = F.when(F.col(reason).isNotNull(), F.col(order))
    return df.observe(
        observation, F.count(F.lit(1)).alias("raw"), F.count(reason).alias("rejected"), F.max(rejected).alias("last_order"), F.max_by(reason, rejected).alias("last_reason"))


class IngestListener(StreamingQueryListener):
    """Keeps the observed counters of each trigger of the streams that report under ``name``.

    A trigger that is repeated after a failure replaces its earlier row.
    """

    def __init__(self, name: str):
        self.name = name
        self.triggers: dict[tuple[str, int], tuple] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row and row["raw"]:
            self.triggers[str(progress.id), progress.batchId] = (row["raw"], row["rejected"], row["last_order"], row["last_reason"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Events arrive on a thread of their own; returns once those of an ended query are in."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("the listener was not told of the end of the query")

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per query and trigger."""
        rows = [(*key, *counts) for key, counts in sorted(self.triggers.items())]
        return spark.createDataFrame(rows, "query string, batch long, raw long, rejected long, last_order long, last_reason string")


def counted_run(stream: DataFrame, reason: str, label: str, order: str = "event_id") -> DataFrame:
    """Process everything available and return the counter table, one row per trigger, as the listener saw it."""
    spark = stream.sparkSession
    listener = IngestListener(label)
    spark.streams.addListener(listener)
    try:
        out = shared_dir(spark, label)
        q = observed_counts(stream, reason, label, order).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    table = shared_dir(spark, f"{label}-counters")
    listener.frame(spark).coalesce(1).write.parquet(table)
    return spark.read.parquet(table)


def total_counters(counters: DataFrame) -> DataFrame:
    """The state of the ingest over all triggers."""
    return counters.agg(F.sum("raw").alias("raw"), F.sum("rejected").alias("rejected"), F.max_by("last_reason", "last_order").alias("last_reason"))


def run_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available into a parquet folder and read it back."""
    spark = stream.sparkSession
    out = shared_dir(spark, label)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class ClosedRun:
    """A stream that is run to the end of what is there, fed, run again, and in the end closed.

    Closing takes one marker row, null but for ``stamp``, that stands ``past`` or
    more after the last report. ``past`` holds the delay of ``build`` and the length
    of its windows, so nothing real stays open; the marker's own group or window
    does. Reports before the new watermark then count as late.
    """

    def __init__(self, stream: DataFrame, build: Callable[[DataFrame], DataFrame], stamp: str, past: timedelta, label: str):
        spark = self.spark = stream.sparkSession
        self.schema = StructType([StructField(f.name, f.dataType) for f in stream.schema])
        self.stamp, self.past = stamp, past
        self.out, self.fed = shared_dir(spark, label), shared_dir(spark, f"{label}-fed")
        spark.createDataFrame([], self.schema).write.parquet(self.fed)
        self.built = build(stream.unionByName(spark.readStream.schema(self.schema).parquet(self.fed)))
        self.times: list[dict] = []

    def run(self) -> None:
        q = self.built.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        self.times += [p["eventTime"] for p in q.recentProgress]

    def feed(self, rows: DataFrame) -> None:
        """Further reports, seen by the next run."""
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("append").parquet(self.fed)

    def close(self) -> DataFrame:
        # Old progress entries are forgotten; the watermark then still bounds the last report, as ``past`` is no less than the delay.
        held = [datetime.fromisoformat(t["watermark"]) for t in self.times if "watermark" in t]
        last = max([datetime.fromisoformat(t["max"]) for t in self.times if "max" in t] + [w + self.past for w in held if w.timestamp() > 0], default=None)
        if last is not None:
            row = self.spark.createDataFrame([((last + self.past + timedelta(seconds=1)).isoformat(),)], "at string")
            self.feed(row.select(*[(F.col("at") if f.name == self.stamp else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]))
            self.run()
        return self.spark.read.schema(self.built.schema).parquet(self.out)


def run_closed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], stamp: str, past: timedelta, label: str, later: Sequence[DataFrame] = ()) -> DataFrame:
    """Process everything available, then each of ``later`` in a run of its own, then close: what the watermark still held back is written too."""
    closed = ClosedRun(stream, build, stamp, past, label)
    closed.run()
    for rows in later:
        closed.feed(rows)
        closed.run()
    return closed.close()


def run_each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every batch that is available to ``handle``; a run after a failure goes on from ``checkpoint`` with the same batch."""

    def held(batch: DataFrame, number: int) -> None:
        batch.persist()  # else each use of the batch would run the stream's state again
        try:
            handle(batch, number)
        finally:
            batch.unpersist()

    q = stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def deliver_flags(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New reports are added, flags of known ones filled or replaced; the merge of a ``DayTable``."""
    return enrich_flags(append_new(stored, incoming.select(*stored.columns)), incoming)
