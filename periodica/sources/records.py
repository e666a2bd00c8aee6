"""Records of delimited text whose quoted cells may hold line breaks.

Files are read in splits of whole lines, so a split may begin inside a quoted
cell. Whether a cell is open after a line depends only on whether one was open
before it: each line is one of four maps of that bit. A first pass composes the
maps of the lines of each split, and one small row per split tells, carried along
its file, in which state each split begins. A second pass joins lines into records
within their split, without a shuffle of lines. Only pieces of records that cross a
border between splits are brought together, by file and split.

A quote opens a cell where a cell begins; within it, two quotes are one; elsewhere
it is plain text. A cell left open at the end of a file ends there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.session import cut_lineage

SPLIT = ("file", "start", "length")
_PLAIN, _OPEN, _CLOSED = 0, 1, 2  # within a line: outside a quoted cell, inside it, behind a quote that may end it


def open_after(value: Column, delimiter: str, inside: bool) -> Column:
    """Whether a quoted cell is open after a line that begins inside one or not."""
    parts = F.split(value, '"')
    empty_start = F.struct(F.lit(_OPEN if inside else _PLAIN).alias("state"), F.element_at(parts, 1).alias("text"), F.lit(True).alias("first"))

    def next_quote(seen: Column, text: Column) -> Column:
        begins = F.endswith(seen["text"], F.lit(delimiter)) | (seen["first"] & (seen["text"] == ""))
        state = (
            F.when(seen["state"] == _OPEN, _CLOSED)
            .when((seen["state"] == _CLOSED) & (seen["text"] == ""), _OPEN)
            .when((seen["state"] == _CLOSED) & ~F.endswith(seen["text"], F.lit(delimiter)), _PLAIN)
            .when(begins, _OPEN).otherwise(_PLAIN))
        return F.struct(state.alias("state"), text.alias("text"), F.lit(False).alias("first"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), empty_start, next_quote)["state"] == _OPEN


def with_maps(lines: DataFrame, delimiter: str) -> DataFrame:
    """``lines`` with the state after each line, from outside a quoted cell and from inside."""
    quoted = F.contains("value", F.lit('"'))
    return lines.withColumns({
        "from_plain": F.when(quoted, open_after(F.col("value"), delimiter, False)).otherwise(F.lit(False)),
        "from_open": F.when(quoted, open_after(F.col("value"), delimiter, True)).otherwise(F.lit(True))})


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, length, opens, begins_open, ends_open) of each split of lines ``with_maps``.

    ``opens``: some line of the split may leave a cell open.
    """
    matters = F.col("from_plain") | ~F.col("from_open")
    found = lines.groupBy(*SPLIT).agg(
        F.sort_array(F.collect_list(F.when(matters, F.struct("id", "from_plain", "from_open")))).alias("maps"), F.max("from_plain").alias("opens"))
    both = F.struct(F.lit(False).alias("p"), F.lit(True).alias("o"))
    whole = F.aggregate("maps", both, lambda at, m: F.struct(
        F.when(at["p"], m["from_open"]).otherwise(m["from_plain"]).alias("p"), F.when(at["o"], m["from_open"]).otherwise(m["from_plain"]).alias("o")))
    found = found.select(*SPLIT, "opens", whole.alias("m"))
    # A map is constant, a swap or neither: the state is the last constant, swapped as often as swaps came since.
    along = Window.partitionBy("file").orderBy("start")
    constant, swap = F.col("m.p") == F.col("m.o"), F.col("m.p") & ~F.col("m.o")
    found = found.withColumn("swaps", F.sum(swap.cast("int")).over(along))
    since = F.last(F.when(constant, F.col("m.p").cast("int") + F.col("swaps")), ignorenulls=True).over(along)
    found = found.withColumn("ends_open", (F.coalesce(since, F.lit(0)) + F.col("swaps")) % 2 == 1)
    return found.select(*SPLIT, "opens", F.coalesce(F.lag("ends_open").over(along), F.lit(False)).alias("begins_open"), "ends_open")


def _joined(lines: DataFrame, crossing: bool) -> DataFrame:
    """Records of each split from its lines: those that lie within it, or the pieces of those that cross its borders.

    ``row_no`` counts a file's records in its first split. A piece has a part:
    -1 ends a record of an earlier split, 0 lies within one, 1 begins one.
    """
    kept = lines.select(*SPLIT, "value", "from_plain", "from_open", "begins_open")
    schema = "file string, start long, part int, value string, row_no long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held, part, is_open, count = None, [], None, False, 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["file", "start", "part", "value", "row_no"])
            out.clear()
            return made

        def done(ended: bool) -> None:
            """The record or piece in ``held`` goes out; ``ended``: its last line closed it."""
            nonlocal held, part, count
            inner = part is None and ended
            if inner != crossing:
                kind = None if inner else 1 if part is None else -1 if ended else 0
                out.append((at[0], at[1], kind, "\n".join(held), count if at[1] == 0 else None))
            count += part is None
            held, part = [], None

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != at:
                    if held:
                        done(False)
                    at, count, is_open = row[:3], 0, row[6]
                    part = 0 if is_open else None
                held.append(row[3])
                is_open = row[5] if is_open else row[4]
                if not is_open:
                    done(True)
            if out:
                yield batch()
        if held:
            done(False)
        if out:
            yield batch()

    return kept.mapInArrow(run, schema)


def _numbered(lines: DataFrame, rows: int) -> DataFrame:
    """(value, row_no) of lines that are records; the first ``rows`` of each file are numbered, found by their line ids."""
    first = lines.where("start = 0").groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    heads = first.select("low", F.explode(F.sequence("low", F.least("high", F.col("low") + rows - 1))).alias("id")).select("id", (F.col("id") - F.col("low")).alias("row_no"))
    return lines.join(heads, "id", "left").select("value", "row_no")


def records(lines: DataFrame, delimiter: str = ",", numbered: int = 1) -> DataFrame:
    """(value, row_no) of every record of (file, start, length, id, value) lines.

    ``row_no`` counts a file's records from 0. It is known for the first
    ``numbered`` records at least, as far as they begin in the file's first split,
    and null for those behind them.

    The lines are read twice. If the second reading is split differently (say,
    because the number of cores changed between), the job fails; fix
    ``spark.sql.files.minPartitionNum`` then.
    """
    mapped = with_maps(lines, delimiter)
    states = cut_lineage(split_states(mapped), "split-states")
    opens, crossing = states.agg(F.max("opens"), F.max("ends_open")).first()
    if not opens:  # every line is a record
        return _numbered(lines, numbered)
    known = mapped.join(states.select(*SPLIT, "begins_open", "ends_open"), list(SPLIT), "left")
    changed = F.raise_error(F.lit("files were split differently when read again")).cast("boolean")
    checked = F.when(F.col("begins_open").isNull(), changed).otherwise(F.col("begins_open"))
    known = known.withColumn("begins_open", checked).sortWithinPartitions("id")
    whole = _joined(known, crossing=False).select("value", "row_no")
    if not crossing:
        return whole
    pieces = _joined(known.where(F.col("begins_open") | F.col("ends_open")), crossing=True)
    order = Window.partitionBy("file").orderBy("start", "part")
    pieces = pieces.withColumn("record", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    whole_again = pieces.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "part", "value"))).alias("p"), F.max(F.when(F.col("part") == 1, F.col("row_no"))).alias("row_no"))
    return whole.unionByName(whole_again.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "row_no"))
