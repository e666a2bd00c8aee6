from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from periodica.operators import quality as qa
from periodica.operators.joins import closure, nearest_prior, set_relations
from periodica.operators.setops import bag_difference
from periodica.plans import scopes as sc
from periodica.sources import deliveries as dl
from periodica.sources import delimited as de
from periodica.sources import protocol as pr

OBS = "k string, value double, source string"


def test_upsert_keeps_value_and_provenance(frame):
    stored = frame([("a", 7.0, "v1"), ("b", 2.0, "v1")], OBS)
    incoming = frame([("b", 0.0, "v2"), ("c", None, "v2"), ("a", None, "v2")], OBS)
    got = {r["k"]: (r["value"], r["source"]) for r in qa.upsert(stored, incoming, ["k"]).collect()}
    assert got == {"a": (7.0, "v1"), "b": (0.0, "v2"), "c": (None, "v2")}
    twice = qa.upsert(qa.upsert(stored, incoming, ["k"]), incoming, ["k"])
    assert {r["k"]: r["value"] for r in twice.collect()} == {"a": 7.0, "b": 0.0, "c": None}
    with pytest.raises(ValueError):
        qa.upsert(stored, incoming.unionByName(incoming), ["k"])


def test_history_guard(frame):
    before = frame([("a", 7.0, "v1"), ("b", 2.0, "v1")], OBS)
    qa.guard_history(before, before, ["k"], ["value"])
    for after in (before.where("k = 'a'"), frame([("a", 7.0, "v1"), ("z", 2.0, "v1")], OBS), before.withColumn("value", F.when(F.col("k") == "a", F.col("value")))):
        with pytest.raises(ValueError):
            qa.guard_history(before, after, ["k"], ["value"])


def test_latest_vintage_and_bag(frame):
    v = frame([("p", 1.0, "2024-01", "f"), ("p", 2.0, "2024-02", "f")], "period string, value double, vintage string, file string")
    r = qa.latest_vintage(v, ["period"], ["vintage", "file"], "value").first()
    assert (r["value"], r["revised"]) == (2.0, True)
    assert bag_difference(v.unionByName(v), v).count() == 2


def test_nearest_prior_tie_and_tolerance(frame):
    d = [(date(2024, 3, 1), 10.0), (date(2024, 2, 20), 1.0), (date(2025, 2, 25), 5.0), (date(2026, 5, 1), 6.0)]
    out = nearest_prior(frame(d, "p date, v double").withColumn("k", F.lit(1)), ["k"], "p", "v")
    got = {r["p"]: r["prior"] for r in out.collect()}
    assert got[date(2025, 2, 25)] == 10.0 and got[date(2026, 5, 1)] is None


def test_cycle_is_an_error(frame):
    assert closure(frame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")).count() == 6
    with pytest.raises(ValueError):
        closure(frame([("a", "b"), ("b", "a")], "parent string, child string"))


def brute_selection(rows_, members):
    size = {s: len(m) for s, m in members.items()}
    free = [r for r in rows_]
    bad = {s for a in free for b in free if a["scope"] != b["scope"] and members[a["scope"]] & members[b["scope"]]
           and not (members[a["scope"]] < members[b["scope"]] or members[b["scope"]] < members[a["scope"]]) for s in (a["scope"], b["scope"])}
    available = [r for r in free if r["scope"] not in bad]
    chosen, status = [], {s: "crossing" for s in bad}
    for o in sorted(available, key=lambda r: (-size[r["scope"]], r["scope"])):
        mine = members[o["scope"]]
        if any(mine <= members[c] for c in chosen):
            status[o["scope"]] = "contained"
            continue
        inner = [members[s["scope"]] for s in available if members[s["scope"]] < mine]
        if o["complete"] and inner and set().union(*inner) == mine:
            status[o["scope"]] = "split"
        else:
            status[o["scope"]] = "chosen"
            chosen.append(o["scope"])
    return status


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scope_selection_equals_greedy(frame, seed):
    import random

    rnd = random.Random(seed)
    members = {f"s{i}": set(rnd.sample(range(8), rnd.randint(1, 6))) for i in range(9)}
    data = [{"scope": s, "complete": rnd.random() < 0.6} for s in members]
    df = frame([(d["scope"], 1, "whole", "1999", date(1999, 12, 31), False, 1.0, d["complete"], "u") for d in data],
               "scope string, basis_rank int, basis string, period string, end_day date, estimated boolean, amount double, complete boolean, unit string")
    m = frame([(s, x) for s, xs in members.items() for x in xs], "scope string, member int")
    got = {r["scope"]: r["status"] for r in sc.select_scopes(sc.scope_winners(df), m).collect()}
    assert got == brute_selection(data, members)


def test_conflicting_scope_values(frame):
    df = frame([("s", 1, "whole", "1999", date(1999, 12, 31), False, a, True, "u") for a in (1.0, 2.0)],
               "scope string, basis_rank int, basis string, period string, end_day date, estimated boolean, amount double, complete boolean, unit string")
    assert sc.scope_winners(df).first()["conflict"]


def test_row_addressed_file(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("说明,,\n注释,,\n日期,数值,数值,\n2024/1/1,1.5,x,\n2024/1/2,0,y,\n,,,\n".encode("gbk"))
    assert de.detect_encoding(spark, str(p)) == "GBK"
    df = de.infer_types(de.read_rows(spark, str(p), 2, 3))
    assert df.columns == ["日期", "数值", "数值__2"] and rows(df, "数值", "数值__2") == [(0.0, "y"), (1.5, "x")]
    assert de.suggest_time_column(df) == "日期" and de.numeric_variables(df) == ["数值"]
    with pytest.raises(ValueError):
        de.infer_types(de.read_rows(spark, str(p), 2, 3), time_column="数值__2")
    wide = tmp_path / "b.csv"
    wide.write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError):
        de.read_rows(spark, str(wide))
    assert de.unique_names(["x", "x", "x__2", "x"]) == ["x", "x__2", "x__2__2", "x__3"]


def test_bad_shards_and_contract(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    good, counts = de.read_shards(spark, str(tmp_path / "s"), ["a", "b"])
    assert rows(good, "a", "b") == [("1", "2")] and counts.first()["bad_rows"] == 2
    c = tmp_path / "c.csv"
    c.write_text("date,portid,n\n2024-01-01,p,x\n")
    with pytest.raises(ValueError):
        de.read_contract_csv(spark, str(c), ["date", "n"], ["n"], ["portid"])
    with pytest.raises(ValueError):
        de.read_contract_csv(spark, str(c), ["date", "missing"], ["n"], ["portid"])


def test_date_quality(frame):
    r = de.date_quality(frame([("1899-01-01",), ("not a date",), ("2026-08-31",)], "d string"), "d").first()
    assert (r["rows"], r["before_1900"], r["unparseable"], r["first_since_1900"]) == (3, 1, 1, date(2026, 8, 31))


def test_protocol_problems(frame):
    long = frame([("2024-01-01", "c1", "0"), ("bad", "c1", "2"), ("2024-01-02", "c2", "x")], "period_text string, column string, value_text string")
    meta = frame([("c1", "甲", "日", "t", "s", "u"), ("c2", "乙", "世纪", "t", " ", "u")], "column string, name string, frequency string, unit string, source string, updated string")
    good, problems = pr.parse_sheet(long, meta, frame([("甲",), ("乙",), ("丙",)], "name string"))
    assert {(r["indicator"], r["problem"]) for r in problems.collect()} == {("甲", "invalid_date"), ("乙", "unknown_frequency"), ("乙", "missing_source"), ("乙", "not_numeric"), ("丙", "not_in_sheets")}
    assert good.where("indicator = '甲' and period = date'2024-01-01' and value is null").count() == 1
    with pytest.raises(ValueError):
        pr.require_valid(problems)


def test_bundle_replaces_and_verifies(spark, frame, tmp_path):
    e = dl.bundle_events(frame([("a", "1", datetime(2024, 1, 1, 20)), ("a", "1", datetime(2024, 1, 1, 20)), ("a", "2", datetime(2024, 1, 1, 21))], "area string, mmsi string, entered timestamp"))
    day = date(2024, 1, 2)  # business day is ahead of UTC
    assert rows(e, "mmsi", "day") == [("1", day), ("2", day)]
    cover = frame([("a", day, 2), ("b", day, 0)], "area string, day date, declared long")
    dl.check_bundle(e, cover)
    with pytest.raises(ValueError):
        dl.check_bundle(e, cover.withColumn("declared", F.col("declared") + 1))
    path = str(tmp_path / "h")
    dl.save_bundle(e, cover, path, "p")
    dl.save_bundle(e.where("mmsi = '1'"), frame([("a", day, 1)], "area string, day date, declared long"), path, "p")
    assert rows(dl.verified_history(dl.read_bundles(spark, path)), "area", "passages") == [("a", 1), ("b", 0)]


def test_pinned_snapshot(spark, frame, tmp_path):
    obs = frame([("s", "c", date(2024, 1, 31), 1.0)], "sheet string, column string, period date, value double")
    root = str(tmp_path / "r")
    v1 = dl.publish(obs, root)
    assert dl.read_published(spark, root, v1, "s").count() == 1
    v2 = dl.publish(obs.withColumn("value", F.lit(2.0)), root)
    assert v1 != v2
    with pytest.raises(ValueError):
        dl.read_published(spark, root, v1, "s")
    with pytest.raises(ValueError):
        dl.publish(obs.unionByName(obs), root)
