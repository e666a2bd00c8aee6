"""Ordered operators over keys of any size.

A window partitioned by a key alone sends the whole key to one task. Here the
key is split into calendar chunks: rows are ordered inside (key, chunk), one
summary row per chunk is ordered along the key, and what earlier chunks carry
over is joined back on (key, chunk). A key with a third of all rows is then
spread over as many tasks as it has chunks, and the result is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a field carries: the last or first non-null value of strictly earlier rows, or the sum up to the row.
LAST, FIRST, SUM = "last", "first", "sum"


def scan(df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with every field of ``fields`` (name to kind and value) carried along the key.

    All fields share one sort within the chunks, one summary row per chunk and one
    join, so the input is planned twice however many fields there are.
    """
    tmp = {n: f"_{n}_v" for n in fields}
    base = df.withColumns({tmp[n]: value for n, (_, value) in fields.items()})
    own = Window.partitionBy(*keys, chunk).orderBy(*order)
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    local, summed, carried = {}, [], []
    along = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in fields.items():
        v = F.col(tmp[n])
        at = F.when(v.isNotNull(), F.struct(*order))
        if kind == SUM:
            local[f"_{n}_l"] = F.sum(v).over(upto)
            summed.append(F.sum(v).alias(tmp[n]))
            carried.append(F.sum(tmp[n]).over(along).alias(f"_{n}_c"))
        elif kind in (LAST, FIRST):
            pick, best = (F.last, F.max_by) if kind == LAST else (F.first, F.min_by)
            local[f"_{n}_l"] = pick(v, ignorenulls=True).over(before)
            summed.append(best(F.when(v.isNotNull(), v), at).alias(tmp[n]))
            carried.append(pick(tmp[n], ignorenulls=True).over(along).alias(f"_{n}_c"))
        else:
            raise ValueError(f"unknown kind {kind!r}")
    summary = base.groupBy(*keys, chunk).agg(*summed)
    names = [f"_key{i}" for i in range(len(keys) + 1)]
    summary = summary.select(*[F.col(k).alias(n) for k, n in zip([*keys, chunk], names)], *carried)
    rows = base.withColumns(local)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(summary[n]) for k, n in zip([*keys, chunk], names)])
    out = rows.join(summary, same, "left")
    final = {}
    for n, (kind, _) in fields.items():
        here, carry = F.col(f"_{n}_l"), F.col(f"_{n}_c")
        final[n] = here + F.coalesce(carry, F.lit(0)) if kind == SUM else F.coalesce(here, carry) if kind == LAST else F.coalesce(carry, here)
    return out.withColumns(final).drop(*names, *tmp.values(), *[f"_{n}_{x}" for n in fields for x in "lc"])


def last_before(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` in strictly earlier rows of the key."""
    return scan(df, keys, chunk, order, {name: (LAST, value)})


def previous_row(df: DataFrame, keys: list[str], chunk: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Struct of ``fields`` of the row just before, across chunk borders."""
    return last_before(df, keys, chunk, order, F.struct(*fields), name)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Cumulative sum along the key up to and including the row."""
    return scan(df, keys, chunk, order, {name: (SUM, value)})


def row_number(df: DataFrame, keys: list[str], chunk: str, order: list[str], name: str = "row_no") -> DataFrame:
    """Position 1..n of each row along the key."""
    return running_sum(df, keys, chunk, order, F.lit(1).cast("long"), name)
