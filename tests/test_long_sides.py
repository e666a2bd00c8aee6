"""Steps whose both sides grow with the input: no broadcast of a long side, no rows made before a shuffle that could be made after it."""

import random
import re
from datetime import date, timedelta

import pytest

from helpers import rows
from periodica.operators import joins as jn
from periodica.plans import alignment as al
from periodica.plans import factors as fa
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def news(frame):
    days = [date(2024, 1, 31), date(2024, 4, 30)]
    releases = frame([(i, f"v{i % 4}", date(2024, 5, 1 + i), float(i)) for i in range(8)] + [(8, "v0", date(2023, 1, 1), 1.0)], "release_id long, variable string, ts date, observed double")
    predictions = frame([(f"v{i}", d, float(i)) for i in range(4) for d in days], "variable string, ts date, expected double")
    gains = frame([(f"v{i}", d, k, i + k / 2) for i in range(4) for d in days for k in (1, 2)], "variable string, ts date, factor int, gain double")
    return fa.news_impacts(releases, predictions, gains, frame([(1, 0.5), (2, -0.25)], "factor int, loading double"), F.lit(2.0))


def test_news_meet_by_sorting(frame):
    out = news(frame)
    got = {r["release_id"]: r["impact"] for r in out.collect()}
    want = {i: 2.0 * (i - i % 4) * (0.5 * (i % 4 + 0.5) - 0.25 * (i % 4 + 1)) for i in range(8)}
    assert got == pytest.approx(want)
    physical = plan(out).split("== Physical Plan ==")[1].split("Initial Plan")[0]
    assert physical.count("SortMergeJoin") == 3


def test_reconstruction_never_joins_by_the_factor_alone(frame):
    months = [date(2024, m, 1) for m in (1, 2, 3, 4)]
    observed = frame([("a", months[0], 3.0), ("a", months[1], 5.0), ("a", months[1], 6.0), ("a", months[2], None), ("b", months[0], 1.0), ("c", months[0], 1.0), ("a", months[3], 1.0)], "v string, p date, y double")
    factors = frame([(months[0], "f", 1.0), (months[1], "f", 2.0), (months[2], "f", 3.0), (months[0], "g", 0.5)], "p date, factor string, f double")
    weights = frame([("a", "f", 2.0), ("a", "g", 2.0), ("b", "f", None)], "v string, factor string, loading double")
    out = fa.reconstruction_errors(observed, factors, weights, "v", "p", "y", F.lit("x"))
    got = {r["v"]: (r["mae"], r["n"]) for r in out.collect()}
    assert got == {"a": (pytest.approx((0 + 1 + 2) / 3), 3), "b": (None, 0)}
    assert not re.search(r"Join \[factor#\d+\]", plan(out))


def friday(d):
    return d + timedelta((4 - d.weekday()) % 7)


def aligned(data, first, last, borrow):
    out = []
    for k in {k for k, _d, v in data if v is not None}:
        mine = [(d, v) for x, d, v in data if x == k and v is not None]
        lo, hi = first or min(d for d, _ in mine), last or max(d for d, _ in mine)
        at, weeks = friday(lo), {}
        for d, v in sorted(mine) if k is not None else []:
            weeks.setdefault(friday(d), []).append((d, v))
        while at <= hi:
            then = weeks.get(at + timedelta(7), [])
            lends = borrow and at not in weeks and at + timedelta(7) <= hi and len(then) >= 2
            out.append((k, at, weeks[at][-1][1] if at in weeks else then[0][1] if lends else None, then[0][0] if lends else None))
            at += timedelta(7)
    return out


@pytest.mark.parametrize("first, last", [(None, None), (date(2024, 2, 1), date(2024, 3, 20)), (date(2023, 12, 1), date(2024, 7, 3))])
@pytest.mark.parametrize("borrow", [True, False])
def test_weeks_are_filled_after_the_shuffle(frame, first, last, borrow):
    rnd = random.Random(4)
    data = [(k, date(2024, 1, 1) + timedelta(d), None if rnd.random() < 0.1 else float(d)) for k in ("a", "b", "c", None) for d in sorted(rnd.sample(range(150), 25))]
    data += [("one", date(2024, 3, 1), 1.0), ("early", date(2023, 1, 1), 1.0), ("none", date(2024, 1, 1), None)]
    lit = lambda d: d and F.lit(d)
    out = al.align_to_fridays(frame(data, "k string, d date, v double"), "k", "d", "v", lit(first), lit(last), borrow)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(aligned(data, first, last, borrow), key=repr)
    physical = plan(out).split("== Physical Plan ==")[1]
    assert physical.index("explode(sequence") < physical.index("Exchange")


def test_closure_makes_a_pair_of_a_tree_once(frame, monkeypatch):
    plans, cut = [], jn.cut_lineage
    monkeypatch.setattr(jn, "cut_lineage", lambda df, label="stage": (plans.append(plan(df)), cut(df, label))[1])
    rnd = random.Random(3)
    edges = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(60)) if a < b} | {(None, 3), (7, None), (40, 41)}
    want = {e: 1 for e in edges}
    for depth in range(2, 31):
        for (a, b), k in list(want.items()):
            for c, d in edges if k == depth - 1 and b is not None else ():
                if c == b:
                    want.setdefault((a, d), depth)
    got = jn.closure(frame(sorted(edges, key=repr), "parent int, child int"))
    assert rows(got.na.fill(-1), "ancestor", "descendant", "depth") == sorted((*(-1 if x is None else x for x in e), k) for e, k in want.items())
    assert any("strategy=merge" in p for p in plans) and not any("Broadcast" in p for p in plans)
