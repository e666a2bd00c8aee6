"""Repairs against a plain search over edits with their whole audits."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from periodica.llm import conversation_repair as cr

INITIAL = {"s": 0, "u": 1, "a": 2}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def insertions(best):
    """States reached by inserted turns, cheapest and then least audit."""
    for _ in range(4):
        for state, (cost, audit, lines) in list(best.items()):
            role = "assistant" if state == "u" else "user"
            new = (cost + 5, audit + "I", lines + [f"{role}:"])
            if role[0] not in best or new[:2] < best[role[0]][:2]:
                best[role[0]] = new
    return best


def brute(rows):
    """Summary of (turn, role, text) rows in order."""
    seen, blank, duplicate, truncated, best = set(), 0, 0, 0, {"": (0, "", [])}
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "cut")
        after = {}
        for state, (cost, audit, lines) in insertions(best).items():
            options = [(2, "D", state, [])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                given = "assistant" if state == "u" else "user"
                options.append((1 + extra, "R", given[0], [f"{given}:{text}"]))
                first = role[:1]
                if first == "s" and state == "" or first == "u" and state in ("", "s", "a") or first == "a" and state == "u":
                    options.append((extra, "K", first, [f"{role}:{text}"]))
            for paid, letter, then, line in options:
                new = (cost + paid, audit + letter, lines + line)
                if then not in after or new[:2] < after[then][:2]:
                    after[then] = new
        best = after
    cost, audit, lines = min((v for s, v in insertions(best).items() if s in ("", "a")), key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(lines)), lines


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1])}:{r[1]}{r[2]}"))
    return sorted(rows, key=key)


def damage(conv, turn, role, text):
    shown = lambda v: " " if v is None else str(v)
    k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
    role, text = shown(role), shown(text)
    text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
    return [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def test_single_runs_and_powers():
    rng = random.Random(5)
    for _ in range(300):
        rows = []
        for _ in range(rng.randrange(1, 6)):
            role = rng.choice(("system", "user", "assistant", "tool", ""))
            for _ in range(rng.randrange(1, 90)):
                rows.append((len(rows), role, rng.choice((f"t{len(rows)}.", "", f"x{len(rows)}"))))
        runs = []
        for _, role, text in rows:
            kind = INITIAL.get(role[:1], 3)
            runs.append((8 if not text else kind if text.endswith(".") else kind + 4, 1))
        runs = cr.collapsed(runs)
        want = brute(rows)
        letters, state = cr.unroll_runs(runs, cr.AT_END, cr.NOTHING)
        assert letters + cr.end_letters(state) == want[6]
        matrix = cr.UNIT
        for symbol, n in runs:
            matrix = cr.product(matrix, cr.run_matrix(symbol, n))
        assert min(matrix[0][z] + cr.AT_END[z] for z in cr.STATES) == want[5]


EDGE = [
    (None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes!"),
    (2, 5, "assistant", "late"), (2, 1, "assistant", " \t\r\n"), (3, 0, "user", "...  "), (3, 0, "user", "a b c"), (3, 0, "assistant", "x\x0b"), (3, None, "user", ""),
    (4, -5, "tool", "Odd. "), (4, 9, "User", "Odd."), (4, 9, "", "é!"), (5, 1, "user", "word " * 60_000), (5, 2, "assistant", "word " * 60_000 + "."),
    *[(6, i, "user" if i % 3 else "assistant", "same.") for i in range(40)], *[(7, 1, "user", "hot.")] * 50, *[(8, None, "assistant", f"n{i % 9}.") for i in range(30)],
]


def many(seed):
    rng, out = random.Random(seed), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            for _ in range(rng.choice((1, 1, 1, 2))):
                out.append((conv, turn if rng.random() < 0.9 else None, rng.choice(("system", "user", "user", "assistant", "assistant", "tool")), rng.choice(("Fine.", f"t{turn}!", "cut off", " ", f"q{rng.randrange(4)}?"))))
    return out


def frame(spark, rows):
    named = [(*r, 1, "x") for r in rows]
    return spark.createDataFrame(named, "conv_id long, turn long, role string, text string, block int, letters string").repartition(3)


@pytest.mark.parametrize("rows,long_rows", [(EDGE, 4096), (EDGE, 0), (many(1), 4096), (many(2), 6)], ids=["edge", "edge-long", "many", "many-long"])
def test_repair(spark, rows, long_rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).extend(damage(conv, turn, role, text))
    want = {c: brute(ordered(r)) for c, r in groups.items()}
    turns = cr.damaged(frame(spark, rows))
    got = {r[0]: tuple(r) for r in cr.repair(turns, long_rows).select("conv_id", *cr.COUNTS, "audit", "repaired_sha256").collect()}
    assert got == {c: (c, *w[:8]) for c, w in want.items()}
    lines = {}
    for r in cr.repaired_turns(turns, long_rows).collect():
        lines.setdefault(r[0], []).append((r[1], f"{r[2]}:{r[3]}"))
    assert {c: [t for _, t in sorted(x)] for c, x in lines.items()} == {c: w[8] for c, w in want.items() if w[8]}
    assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in lines.values())


def test_without_damage(spark):
    got = cr.repair(frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.\nassistant:Yes."))]


@pytest.mark.parametrize("long_rows", [4096, 0])
def test_no_rows(spark, long_rows):
    assert cr.repair(cr.damaged(frame(spark, [])), long_rows).collect() == []


def test_query(spark):
    from periodica.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    out = QUERIES["op12_conversation_repair"](spark, folder)
    assert out.columns == ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    groups = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        groups.setdefault(r["conv_id"], []).extend(damage(r["conv_id"], r["turn"], r["role"], r["text"]))
    assert Counter(map(tuple, out.collect())) == Counter((c, *brute(ordered(r))[:8]) for c, r in groups.items())
