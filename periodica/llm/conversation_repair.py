"""Cheapest repair of conversations to an optional system turn and pairs of user and assistant.

Turns are symbols of role initial and first fault. Kept turns cost nothing, a new
role (user or assistant) 1, a deletion 2 (blank and repeated turns must go), an
inserted empty turn 5, a truncated turn that stays 5 more. What stands so far is
one of four states: nothing, a system turn, a user turn, an assistant turn. A
symbol is a min-plus matrix over the states, inserted turns before it included. A
conversation is collapsed into runs of equal symbols, and a run advances the costs
still to come by the cached powers of its matrix to 1, 2, 4, ... turns. The edits
are unrolled forwards, run by run and half by half, always by the first letter
(D, I, K, R) that still leads to the least cost; so the audit is the ASCII-least.

Conversations of up to ``LONG_ROWS`` rows are sorted and repaired as a whole in one
task. Longer ones are cut into blocks by range: equal rows are counted before,
repeats are found by an aggregate, each block is one matrix, costs to come go
backwards and states forwards over the blocks, and blocks are unrolled apart. Only
the digest, which hashes a conversation's lines one after another, and its audit
pass one task, as a stream.

Turns are ordered by ``turn`` (nulls first), then by a digest of role and text. A
null role or text is one blank. Rows without an id are one conversation. Equal
rows are repeats; other columns of the input are not read. A conversation without
a turn has no faults, an empty audit and an empty repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from periodica.session import cut_lineage

LONG_ROWS = 4096
#: Longest stretch of a run whose unrolled edits are remembered.
REMEMBERED = 64
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEVER = 1 << 50
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
MUST_GO = 8
#: The state after a turn that is inserted or gets its role from its place.
GIVEN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn of a symbol's initial (s, u, a, other) leads.
KEPT = ({NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: Costs to come at the end: only nothing or an assistant turn may stand last.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one turn, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = CUT if symbol >= 4 else 0
        if state in KEPT[symbol % 4]:
            out.append(("K", KEEP + extra, KEPT[symbol % 4][state]))
        out.append(("R", REROLE + extra, GIVEN[state]))
    return out


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[x][y] + b[y][z] for y in STATES) for z in STATES) for x in STATES)


UNIT = tuple(tuple(0 if x == z else NEVER for z in STATES) for x in STATES)


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> tuple:
    """Least costs from state to state over ``2 ** bit`` turns of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    out = []
    for start in STATES:
        row, state, paid = [NEVER] * 4, start, 0
        for _ in STATES:  # more than three insertions in a row only come round again
            for _, cost, then in _edits(symbol, state):
                row[then] = min(row[then], paid + cost)
            state, paid = GIVEN[state], paid + INSERT
        out.append(tuple(row))
    return tuple(out)


def before(symbol: int, length: int, after: Vector) -> Vector:
    """Costs to come before a run, from those after it."""
    bit = 0
    while length >> bit:
        if length >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(m[x][z] + after[z] for z in STATES) for x in STATES)
        bit += 1
    return after


def run_matrix(symbol: int, length: int) -> tuple:
    out, bit = UNIT, 0
    while length >> bit:
        if length >> bit & 1:
            out = product(out, power(symbol, bit))
        bit += 1
    return out


@lru_cache(maxsize=1 << 14)
def _remembered(symbol: int, length: int, after: Vector, state: int) -> tuple[str, int]:
    if length > 1:
        return _unrolled(symbol, length, after, state)
    now, letters = before(symbol, 1, after), ""
    while True:
        options = [(letter, then) for letter, cost, then in _edits(symbol, state) if cost + after[then] == now[state]]
        if INSERT + now[GIVEN[state]] == now[state]:
            options.append(("I", GIVEN[state]))
        letter, state = min(options)
        letters += letter
        if letter != "I":
            return letters, state


def _unrolled(symbol: int, length: int, after: Vector, state: int) -> tuple[str, int]:
    half = length // 2
    first, state = unrolled(symbol, half, before(symbol, length - half, after), state)
    second, state = unrolled(symbol, length - half, after, state)
    return first + second, state


def unrolled(symbol: int, length: int, after: Vector, state: int) -> tuple[str, int]:
    """Edits of a run that begins in ``state``, and the state it leaves; only differences of the costs to come matter."""
    least = min(after)
    after = tuple(c - least for c in after)
    return _remembered(symbol, length, after, state) if length <= REMEMBERED else _unrolled(symbol, length, after, state)


def unroll_runs(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[str, int]:
    costs = [after]
    for symbol, length in reversed(runs[1:]):
        costs.append(before(symbol, length, costs[-1]))
    parts = []
    for (symbol, length), after in zip(runs, reversed(costs)):
        part, state = unrolled(symbol, length, after, state)
        parts.append(part)
    return "".join(parts), state


def end_letters(state: int) -> str:
    return "I" * (AT_END[state] // INSERT)


def collapsed(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring (symbol, length) of equal symbol as one run."""
    return [(s, sum(n for _, n in part)) for s, part in groupby(symbols, key=lambda x: x[0])]


def turn_symbols(symbol: int, copies: int) -> list[tuple[int, int]]:
    return [(symbol, 1), (MUST_GO, copies - 1)] if copies > 1 else [(symbol, 1)]


def applied(letters: str, state: int, turns: Iterator[tuple[str, str, int, int]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Per turn (role, text, kind, copies): its letters and the lines that stand for it; letters left over go to the last."""
    at, held = 0, None
    for role, text, kind, copies in turns:
        if held:
            yield held
        begin, lines, rest = at, [], copies
        while rest:
            letter = letters[at]
            at += 1
            if letter in "IR":
                state = GIVEN[state]
                lines.append((ROLES[state], "" if letter == "I" else text))
            elif letter == "K":
                state = KEPT[kind][state]
                lines.append((role, text))
            rest -= letter != "I"
        held = (letters[begin:at], lines)
    if held:
        tail, lines = letters[at:], held[1]
        for _ in tail:
            state = GIVEN[state]
            lines.append((ROLES[state], ""))
        yield held[0] + tail, lines


# --- frames ----------------------------------------------------------------

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): turns dropped (no copies), emptied, cut, repeated or given to the user by a checksum of conversation and turn."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), k.alias("k")).select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _prepared(turns: DataFrame) -> DataFrame:
    """Typed turns with their symbol parts and the digest that orders turns of one number."""
    copies = F.coalesce(F.col("copies").cast("long"), F.lit(0)) if "copies" in turns.columns else F.lit(1).cast("long")
    typed = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    trimmed, initial = F.btrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    return typed.select(
        "*", (trimmed == "").alias("empty"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), initial.alias("initial"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def _conversation(rows: list[tuple]) -> tuple[list, list[tuple[str, list]]]:
    """Summary without digest, and (letters, lines) per turn, of (turn, role, text, copies, empty, cut, initial, kind)."""
    seen, symbols, blank, duplicate, truncated, illegal, last = set(), [], 0, 0, 0, 0, None
    for _, role, text, copies, empty, cut, initial, kind in rows:
        if empty:
            blank += copies
            symbol = MUST_GO
        elif (role, text) in seen:
            duplicate += copies
            symbol = MUST_GO
        else:
            seen.add((role, text))
            duplicate += copies - 1
            truncated += cut
            symbol = kind + 4 * cut
        symbols += turn_symbols(symbol, copies)
        illegal += copies - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    runs = collapsed(symbols)
    cost = AT_END
    for symbol, length in reversed(runs):
        cost = before(symbol, length, cost)
    letters, state = unroll_runs(runs, AT_END, NOTHING) if runs else ("", NOTHING)
    parts = list(applied(letters + end_letters(state), NOTHING, ((r[1], r[2], r[7], r[3]) for r in rows)))
    return [gaps, blank, duplicate, truncated, illegal, cost[NOTHING], "".join(p for p, _ in parts)], parts


def _short(turns: DataFrame, emit: str, schema: str) -> DataFrame:
    """Whole conversations in one task each; ``emit`` is ``summary`` or ``turns``."""
    columns = ["conv_id", "turn", "role", "text", "copies", "empty", "cut", "initial", "kind"]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest").select(*columns)
    key = pa.schema([pa.field("conv_id", _arrow_type(turns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (conv,), rows in _grouped(batches):
            rows = [r[1:] for r in rows if r[4]]
            summary, parts = _conversation(rows)
            lines = [line for _, part in parts for line in part]
            if emit == "summary":
                out.append((conv, *summary, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
                size += 100
            else:
                out += [(conv, i, *line) for i, line in enumerate(lines)]
                size += sum(len(t) for _, t in lines) + 100 * len(lines)
            if size > 1 << 22:
                yield _batch(out, key, emit)
                out, size = [], 0
        if out:
            yield _batch(out, key, emit)

    return ordered.mapInArrow(run, schema)


def _arrow_type(turns: DataFrame) -> pa.DataType:
    return to_arrow_type(turns.schema["conv_id"].dataType)


def _batch(rows: list[tuple], key: pa.Schema, emit: str) -> pa.RecordBatch:
    further = {
        "summary": [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())],
        "turns": [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())],
        "digests": [("audit", pa.string()), ("repaired_sha256", pa.string())],
    }[emit]
    fields = [(f.name, f.type) for f in key] + further
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


class _Blocks:
    """The frames of the long conversations: ``rows`` in blocks of the range order, and their edits."""

    def __init__(self, turns: DataFrame):
        self.key_type, self.key = _arrow_type(turns), turns.schema["conv_id"].dataType.simpleString()
        same = turns.where("copies > 0").groupBy("conv_id", "turn", "role", "text", "empty", "cut", "initial", "kind", "digest").agg(F.sum("copies").alias("copies"))
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
        ranged = same.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = cut_lineage(ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("pos")), "long-turns")
        first = rows.where("not empty").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
        rows = rows.join(first, "pos", "left").withColumn("new", F.col("new").isNotNull())
        self.rows = rows.withColumn("symbol", F.when(F.col("new"), F.col("kind") + F.when(F.col("cut"), 4).otherwise(0)).otherwise(MUST_GO))
        self.pieces = cut_lineage(self._pieces(), "pieces")
        self.costs = self._costs()
        self.states = cut_lineage(self._states(), "states")

    def _pieces(self) -> DataFrame:
        """Per conversation and block: its runs, their matrix, and what the borders need."""
        fields = [("conv_id", self.key_type), ("block", pa.int32()), ("piece", pa.int64()), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())),
                  ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())]

        def run(batches):
            for (block, conv), rows in _grouped(batches, 2):
                symbols, illegal, last, first, piece = [], 0, None, None, None
                for _, _, pos, symbol, copies, initial in rows:
                    for s, n in turn_symbols(symbol, copies):
                        if symbols and symbols[-1][0] == s:
                            symbols[-1][1] += n
                        else:
                            symbols.append([s, n])
                    illegal += copies - 1 + (last is not None and last + initial not in LEGAL)
                    last = initial
                    first, piece = (initial, pos) if piece is None else (first, piece)
                matrix = UNIT
                for s, n in symbols:
                    matrix = product(matrix, run_matrix(s, n))
                row = [conv, block, piece, [s for s, _ in symbols], [n for _, n in symbols], [c for r in matrix for c in r], illegal, first, last]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

        lean = self.rows.select("block", "conv_id", "pos", "symbol", "copies", "initial")
        lean = lean.repartition("block").sortWithinPartitions("block", "pos")
        return lean.mapInArrow(run, f"conv_id {self.key}, block int, piece long, symbols array<int>, lengths array<long>, matrix array<long>, illegal long, first string, last string")

    def _costs(self) -> DataFrame:
        """(piece, after, cost): costs to come after each piece, from a conversation's last piece backwards, and before it from nothing."""

        def run(batches):
            out = []
            for _, rows in _grouped(batches):
                after = AT_END
                for _, piece, m in rows:
                    now = tuple(min(m[4 * x + z] + after[z] for z in STATES) for x in STATES)
                    out.append((piece, list(after), now[NOTHING]))
                    after = now
                    if len(out) >= 4096:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

        def batch(out):
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["piece", "after", "cost"])

        lean = self.pieces.select("conv_id", "piece", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
        return lean.mapInArrow(run, "piece long, after array<long>, cost long")

    def _states(self) -> DataFrame:
        """(piece, state, closing, cost, illegal): the state each piece begins in, over the states every piece leads to."""
        known = self.pieces.join(self.costs, "piece").select("conv_id", "piece", "symbols", "lengths", "after", "cost", "illegal", "first", "last")

        def exits(batches):
            for b in batches:
                out = []
                for symbols, lengths, after in zip(*(b.column(c).to_pylist() for c in ("symbols", "lengths", "after"))):
                    runs = list(zip(symbols, lengths))
                    out.append([unroll_runs(runs, tuple(after), x)[1] for x in STATES])
                kept = ["conv_id", "piece", "cost", "illegal", "first", "last"]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(out, pa.list_(pa.int32()))], names=[*kept, "exits"])

        left = known.mapInArrow(exits, f"conv_id {self.key}, piece long, cost long, illegal long, first string, last string, exits array<int>")
        left = left.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        names, kinds = ["conv_id", "piece", "state", "closing", "cost", "illegal"], (self.key_type, pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        def forwards(batches):
            out = []
            for (conv,), rows in _grouped(batches):
                state, last, total = NOTHING, None, None
                for _, piece, cost, illegal, first, own_last, ways in rows:
                    crossing = last is not None and last + first not in LEGAL
                    if last is not None:
                        out[-1][3] = False
                        if len(out) >= 4096:
                            yield batch(out)
                            out = []
                    total = cost if total is None else total
                    out.append([conv, piece, state, True, total, illegal + crossing])
                    state, last = ways[state], own_last
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        return left.mapInArrow(forwards, f"conv_id {self.key}, piece long, state int, closing boolean, cost long, illegal long")

    def edits(self) -> DataFrame:
        """(conv_id, pos, letters, lines) of every row."""
        known = self.pieces.join(self.costs.select("piece", "after"), "piece").join(self.states.select("piece", "state", "closing"), "piece")

        def audits(batches):
            for b in batches:
                out = []
                for symbols, lengths, after, state, closing in zip(*(b.column(c).to_pylist() for c in ("symbols", "lengths", "after", "state", "closing"))):
                    letters, then = unroll_runs(list(zip(symbols, lengths)), tuple(after), state)
                    out.append(letters + (end_letters(then) if closing else ""))
                kept = ["conv_id", "block", "piece", "state"]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(out, pa.string())], names=[*kept, "letters"])

        letters = known.select("conv_id", "block", "piece", "state", "symbols", "lengths", "after", "closing").mapInArrow(
            audits, f"conv_id {self.key}, block int, piece long, state int, letters string")
        asked = letters.select("block", "conv_id", F.col("piece").alias("pos"), F.lit(0).alias("part"), F.col("letters").alias("role"), F.lit("").alias("text"), F.col("state").alias("kind"), F.lit(0).cast("long").alias("copies"))
        rows = self.rows.select("block", "conv_id", "pos", F.lit(1).alias("part"), "role", "text", "kind", "copies")
        both = asked.unionByName(rows).repartition("block").sortWithinPartitions("block", "pos", "part")
        line = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

        def run(batches):
            out, size = [], 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (self_key, pa.int64(), pa.string(), line))], names=["conv_id", "pos", "letters", "lines"])

            for (_, conv), rows in _grouped(batches, 2):
                head = next(rows)
                places = []

                def turns():
                    for r in rows:
                        places.append(r[2])
                        yield r[4], r[5], r[6], r[7]

                for i, (part, lines) in enumerate(applied(head[4], head[6], turns())):
                    out.append((conv, places[i], part, [{"role": a, "text": b} for a, b in lines]))
                    size += 100 + sum(len(t) for _, t in lines)
                    if size > 1 << 22:
                        yield batch()
                        out, size = [], 0
            if out:
                yield batch()

        self_key = self.key_type
        return both.mapInArrow(run, f"conv_id {self.key}, pos long, letters string, lines array<struct<role:string,text:string>>")

    def summary(self) -> DataFrame:
        copies = F.col("copies")
        counts = self.rows.groupBy("conv_id").agg(
            F.sum(F.when(F.col("empty"), copies).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("empty"), copies - F.col("new").cast("long")).otherwise(0)).alias("duplicate"),
            F.sum(F.when(F.col("new") & F.col("cut"), 1).otherwise(0)).cast("long").alias("truncated"))
        numbers = self.rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).where("turn is not null")
        gaps = numbers.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
        sums = self.states.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.sum("illegal").alias("illegal"))
        ordered = self.edits().repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "letters", "lines")
        key = pa.schema([pa.field("conv_id", self.key_type)])

        def run(batches):
            for (conv,), rows in _grouped(batches):
                digest, letters, mark = hashlib.sha256(), [], b""
                for _, part, lines in rows:
                    letters.append(part)
                    for line in lines:
                        digest.update(mark + f"{line['role']}:{line['text']}".encode())
                        mark = b"\n"
                yield _batch([(conv, "".join(letters), digest.hexdigest())], key, "digests")

        out = ordered.mapInArrow(run, f"conv_id {self.key}, audit string, repaired_sha256 string")
        for further in (counts, gaps, sums):
            further = further.withColumnRenamed("conv_id", "_conv")
            out = out.join(further, out["conv_id"].eqNullSafe(further["_conv"]), "left").drop("_conv")
        return out

    def lines(self) -> DataFrame:
        """(conv_id, place, role, text); places count a piece's lines up over the pieces before it."""
        edits = cut_lineage(self.edits(), "edits").withColumn("part", F.shiftrightunsigned("pos", 33))
        parts = edits.groupBy("conv_id", "part").agg(F.sum(F.size("lines")).alias("n"))
        before_ = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.coalesce(before_, F.lit(0)).alias("_before"))
        within = F.sum(F.size("lines")).over(Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        placed = edits.withColumn("_within", F.coalesce(within, F.lit(0))).join(parts, edits["conv_id"].eqNullSafe(parts["_conv"]) & (edits["part"] == parts["_part"]))
        line = placed.select("conv_id", (F.col("_before") + F.col("_within")).alias("_at"), F.posexplode("lines").alias("_i", "_line"))
        return line.select("conv_id", (F.col("_at") + F.col("_i")).cast("long").alias("place"), "_line.role", "_line.text")


def _split(turns: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Turns of short conversations, ids and turns of long ones (None without any)."""
    ready = _prepared(turns)
    sizes = ready.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_rows).select(F.col("conv_id").alias("_conv"))
    ids = cut_lineage(sizes, "long-conversations")
    if ids.isEmpty():
        return ready, None, None
    same = ready["conv_id"].eqNullSafe(ids["_conv"])
    return ready.join(ids, same, "left_anti"), ids, ready.join(ids, same, "left_semi")


def repair(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row per conversation: faults, least cost, audit, and the digest of its repaired lines.

    ``turns`` has conv_id, turn, role, text and, if wanted, ``copies`` (0: the turn is gone, its conversation stays).
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    short, ids, long = _split(turns, long_rows)
    out = _short(short, "summary", f"conv_id {key}, {SUMMARY}")
    if ids is None:
        return out
    found = _Blocks(long).summary()
    found = ids.join(found, ids["_conv"].eqNullSafe(found["conv_id"]), "left").drop("conv_id").withColumnRenamed("_conv", "conv_id")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256")]
    return out.unionByName(found.select("conv_id", *zeros, *texts))


def repaired_turns(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, places from 0."""
    key = turns.schema["conv_id"].dataType.simpleString()
    short, ids, long = _split(turns, long_rows)
    out = _short(short, "turns", f"conv_id {key}, place long, role string, text string")
    return out if ids is None else out.unionByName(_Blocks(long).lines())
