"""Documents dealt to shards of near equal bytes, equal texts together.

Equal texts are one atomic group. Groups stand in the order of the SHA-256 of
their text, so a shard is a range of digests: a row finds its shard by comparing
its own digest with the few cuts, without a join or a shuffle of texts, and a
group with any share of all rows is never gathered. A group larger than the even
share of what is left gets a shard of its own (largest first); the rest is cut
contiguously so that the largest shard is as small as it can be.

The smallest capacity is found by binary search, each trial checked by filling
shards greedily. It runs on sums over digest prefixes. Stretches that hold several
groups bound the capacity from both sides: cutting only at known borders can't
beat the best cut, cutting anywhere inside can't be worse. While the bounds
differ, the few stretches in which a cut may fall are summed anew over longer
prefixes, so the driver holds some ten thousand sums at any size of the table. At
equal bounds the cuts are set: within the capacity, each as near to the even share
of what is left as the cuts before and after it allow.

A row's size is the UTF-8 bytes of its text plus one. Null and empty texts are one
group of size-one rows. Rows without an id and repeated rows are placed like any
other. Slots number a shard's rows gaplessly in the order of reading; which of
several equal rows gets which slot is open. An empty table gives no rows. Only the
two named columns are read, so further ones can have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.llm.common import text_columns
from periodica.session import cut_lineage

SHARDS = 16
#: Hexadecimal digits of the first prefixes, and by how many each round lengthens those in question.
FIRST, FURTHER = 3, 2
AFTER_ALL = "g"  # sorts after every hexadecimal digest


@dataclass(frozen=True)
class Plan:
    """``own``: digests with a shard each; ``cuts``: first digests of the further shards; ``capacity``: the largest of these."""

    own: tuple[str, ...]
    cuts: tuple[str, ...]
    capacity: int


@dataclass(frozen=True)
class Stretch:
    """Neighbouring groups: their digest prefix, bytes, first and last digest."""

    prefix: str
    size: int
    first: str
    last: str


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (doc_id, size, text_crc32, digest, ordinal) of all rows, without their texts."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = text_columns(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        F.monotonically_increasing_id().alias("ordinal"))
    return cut_lineage(rows, "shard-sizes")


def _sums(rows: DataFrame, prefix: Column) -> list[Stretch]:
    found = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("first"), F.max("digest").alias("last"))
    return [Stretch(*r) for r in found.where("prefix is not null").collect()]


def _own_shards(rows: DataFrame, stretches: list[Stretch], shards: int) -> list[tuple[str, int]]:
    """Groups larger than the even share of what is left, largest first."""
    own: list[tuple[str, int]] = []
    sizes, left = {s.prefix: s.size for s in stretches}, sum(s.size for s in stretches)
    while left and shards > 1:
        heavy = [p for p, n in sizes.items() if n * shards > left]  # fewer than ``shards``
        if not heavy:
            break
        inside = rows.where(F.substring("digest", 1, FIRST).isin(heavy) & ~F.col("digest").isin([d for d, _ in own]))
        large = inside.groupBy("digest").agg(F.sum("size").alias("n")).where(F.col("n") * shards > F.lit(left)).orderBy(F.desc("n"), "digest").collect()
        if not large:
            break
        for digest, n in large:
            if shards > 1 and n * shards > left:
                own.append((digest, n))
                sizes[digest[:FIRST]] -= n
                left, shards = left - n, shards - 1
    return own


def _least(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _bounded(stretches: list[Stretch], shards: int) -> tuple[int, int, list[int], set[str]]:
    """Lower and upper bound of the capacity, border sums, and prefixes of stretches in which a cut may fall."""
    ends = [0, *accumulate(s.size for s in stretches)]
    whole = [s.first == s.last for s in stretches]
    total = ends[-1]

    def at_borders(capacity: int) -> list[int]:
        filled = [0]
        for _ in range(shards):
            filled.append(ends[bisect_right(ends, filled[-1] + capacity) - 1])
        return filled

    def anywhere(capacity: int) -> list[int]:
        filled = [0]
        for _ in range(shards):
            up_to = min(filled[-1] + capacity, total)
            i = bisect_right(ends, up_to) - 1
            filled.append(ends[i] if i < len(whole) and whole[i] else up_to)
        return filled

    even = -(-total // shards)
    low = _least(lambda c: anywhere(c)[-1] == total, even, total)
    high = _least(lambda c: at_borders(c)[-1] == total, low, total)
    open_ = set()
    if low < high:
        for a, b in zip(at_borders(low)[1:-1], anywhere(high)[1:-1]):
            for i in range(max(0, bisect_right(ends, a) - 1), min(len(whole), bisect_left(ends, b))):
                if not whole[i]:
                    open_.add(stretches[i].prefix)
    return low, high, ends, open_


def _even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Borders of ``shards`` parts of at most ``capacity``, each near the even share of what is left."""
    latest = [len(ends) - 1]  # from the right: where the remaining shards, filled up, would begin
    for _ in range(shards - 1):
        latest.append(bisect_left(ends, ends[latest[-1]] - capacity))
    latest.reverse()
    cuts, at = [], 0
    for j in range(1, shards):
        goal = ends[at] + (ends[-1] - ends[at]) / (shards - j + 1)
        least, most = max(at, latest[j - 1]), bisect_right(ends, ends[at] + capacity) - 1
        i = bisect_left(ends, goal)
        i = i - 1 if i and (i == len(ends) or goal - ends[i - 1] <= ends[i] - goal) else i
        at = min(max(i, least), most)
        cuts.append(at)
    return cuts


def plan_shards(rows: DataFrame, shards: int = SHARDS) -> Plan:
    """The plan of ``measured`` rows."""
    prefix = F.substring("digest", 1, FIRST)
    stretches = _sums(rows, prefix)
    own = _own_shards(rows, stretches, shards)
    if own:
        rows = rows.where(~F.col("digest").isin([d for d, _ in own]))
        stretches = _sums(rows, prefix)
    shards -= len(own)
    while True:
        stretches.sort(key=lambda s: s.prefix)
        low, high, ends, again = _bounded(stretches, shards)
        if low == high:
            break
        longer = F.lit(None).cast("string")
        for n in sorted({len(p) for p in again}, reverse=True):
            longer = F.when(F.substring("digest", 1, n).isin([p for p in again if len(p) == n]), F.substring("digest", 1, n + FURTHER)).otherwise(longer)
        stretches = [s for s in stretches if s.prefix not in again] + _sums(rows, longer)
    cuts = [stretches[i].first if i < len(stretches) else AFTER_ALL for i in _even_cuts(ends, high, shards)]
    return Plan(tuple(d for d, _ in own), tuple(cuts), max([high, *(n for _, n in own)]))


def shard_of(plan: Plan, digest: Column) -> Column:
    """Shard of a digest, by comparisons alone."""
    first = len(plan.own)
    out = reduce(lambda a, cut: a + (digest >= F.lit(cut)).cast("int"), plan.cuts, F.lit(first))
    for i, own in enumerate(plan.own):
        out = F.when(digest == own, F.lit(i)).otherwise(out)
    return out.cast("int")


def with_shard(docs: DataFrame, plan: Plan, text_col: str = "text") -> DataFrame:
    """``docs`` and its shard, in a column ``shard`` (``shard_2``, ... where the name is taken); nothing is shuffled."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("shard", *(f"shard_{i}" for i in range(2, len(taken) + 3))) if n not in taken)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.withColumn(name, shard_of(plan, F.sha2(text, 256)))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> Plan:
    """All columns of ``docs`` as one folder of Parquet files a shard, ``<path>/shard=<n>`` (or the free name)."""
    plan = plan_shards(measured(docs, id_col, text_col), shards)
    out = with_shard(docs, plan, text_col)
    out.write.partitionBy(out.columns[-1]).parquet(path)
    return plan


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    Slots come from the rows of a shard in each part of the input, added up over
    the parts, and a number within the part, so no shard is numbered in one task.
    """
    rows = measured(docs, id_col, text_col)
    placed = rows.withColumn("shard", shard_of(plan_shards(rows, shards), F.col("digest"))).withColumn("part", F.shiftrightunsigned("ordinal", 33))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("ordinal")) - 1
    return placed.join(counts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + within).cast("long").alias("slot"))


def digest(placed: DataFrame) -> DataFrame:
    """The rows with their law; a shard more would move every cut, so none is said to grow alone."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
