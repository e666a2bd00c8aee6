"""Folding and reading of text against the character data and written-out cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from periodica.functions import text as tx
from periodica.functions.folding import fold_compatible


def test_folding_equals_the_standard(frame):
    words = ["ﬁ①⑩ｶﾞﾊﾟ　ＡＢｃ", "㈱㎏½²Ⅳ℡", "éåü", "がパ", "plain", "", "Ａ̊", "ﷺ", "한글 가", "…—“x” ", "ạ́"]
    every = [chr(c) for c in range(0xA0, 0x3400)]
    rows = [(w,) for w in [*words, *(" ".join(every[i : i + 200]) for i in range(0, len(every), 200))]] + [(None,)]
    got = [tuple(r) for r in frame(rows, "s string").select("s", fold_compatible(F.col("s"))).collect()]
    for s, folded in got:
        if s is None:
            assert folded is None
        elif s != "ạ́":  # marks that would have to change places stay as they stand
            assert folded == unicodedata.normalize("NFKC", s), s


def test_names(frame):
    cases = {"指标：（甲）  乙": "指标: (甲) 乙", " a :b": "a : b", "a::b": "a: : b", "x:": "x:", "": "", "a\t\nb：c": "a b: c"}
    df = frame([(k, v) for k, v in cases.items()], "s string, want string")
    assert all(r[0] == r[1] for r in df.select(tx.normalise_name("s"), "want").collect())


@pytest.mark.parametrize("text,want", [
    ("a（1）b", "ab"), ("a (x) b", "a b"), ("(a（b) c）", "c）"), ("n（（（x）", "n（（"), ("（x(y）z)", "z)"), (" k （1） ", "k"), ("q((1)(2))r", "qr"), (")(", ")(")])
def test_brackets(frame, text, want):
    assert frame([(text,)], "s string").select(tx.strip_parentheses("s")).first()[0] == want


def test_rates(frame):
    cases = {
        "12": (1.2, False), "1,200": (120.0, False), "约 5": (0.5, False), "大约.5": (0.05, False), "≈10-20": (1.5, True), "10 至 20": (1.5, True), "20-10": (None, False),
        ">5": (None, False), "5以上": (None, False), "5-": (None, False), "-5": (None, False), "1.2.3": (None, False), "5.": (None, False), "a": (None, False), "": (None, False), "10–20x": (None, False), "3 4": (None, False)}
    df = frame([(k,) for k in cases], "s string").select("s", tx.daily_rate(F.col("s"), F.lit(None).cast("string"), F.lit("千桶/日")).alias("r"))
    got = {r["s"]: (r["r"]["amount"], r["r"]["midpoint"]) for r in df.collect()}
    for k, (amount, midpoint) in cases.items():
        assert got[k] == (pytest.approx(amount) if amount else None, midpoint), k
    plain = frame([("7", ""), ("7", "q"), (".7", ""), ("7.25", None), ("7-8", "")], "s string, q string").select(tx.plain_amount(F.col("s"), F.col("q"), F.lit("百万立方米/日")))
    assert [None if r[0] is None else float(r[0]) for r in plain.collect()] == [7.0, None, None, 7.25, None]
    assert frame([("7",)], "s string").select(tx.daily_rate(F.col("s"), F.lit(">"), F.lit("桶/日"))["amount"]).first()[0] is None


def test_periods(frame):
    cases = {
        "2023年第三季度平均": ("2023-Q3", "2023-09-30"), "2023第2季度平均产量": ("2023-Q2", "2023-06-30"), "2023四季度平均": ("2023-Q4", "2023-12-31"), "2023年三季度": (None, None),
        "2022年下半年日均": ("2022-H2", "2022-12-31"), "2022上半年平均": ("2022-H1", "2022-06-30"), "2022年上半年": (None, None), "2021年5月平均": ("2021-05", "2021-05-31"),
        "2021年02月平均": ("2021-02", "2021-02-28"), "20215月平均": (None, None), "2021年12月平均": ("2021-12", "2021-12-31"), "2021年11月平均": ("2021-11", "2021-11-30"), "2020年平均": ("2020", "2020-12-31"), "2020平均": (None, None),
        "2020年历史日均": ("2020", "2020-12-31"), "2020全年平均": ("2020", "2020-12-31"), "2020全年油田日均": ("2020", "2020-12-31"), "2020全年": (None, None), "2020年全年平均": (None, None),
        "2020-03-04": (None, "2020-03-04"), "2020-03-04 08:00": (None, "2020-03-04"), "2020-13-04": (None, None), "x2020年平均": (None, None), "": (None, None)}
    df = frame([(k,) for k in [*cases, None]], "s string").select("s", tx.observation_period(F.col("s")).alias("p"))
    got = {r["s"]: (r["p"]["code"], None if r["p"]["end"] is None else r["p"]["end"].isoformat()) for r in df.collect()}
    assert got == cases | {None: (None, None)}


def test_repeated_columns(frame):
    from periodica.operators import filters as fl

    data = [("a", 1, 1, 5.0), ("a", 1, 2, None), ("a", 3, 1, 9.0), ("b", 2, 1, 5.0), ("c", 4, 1, 5.0), ("c", 4, 2, 6.0), ("d", 5, 2, 6.0), ("d", 5, 1, 5.0), ("e", 6, 1, None), ("f", 7, 1, None), (None, 8, 1, 5.0), (None, 9, 1, 5.0)]
    df = frame(data, "k string, at int, p int, v double")
    kept, log = fl.drop_repeated_names(df, "k", "at")
    assert sorted(tuple(r) for r in log.select("at", "reason").collect()) == [(3, "duplicate_column"), (9, "duplicate_column")]
    assert kept.count() == 10 and kept.columns == ["at", "p", "v", "k"] or set(kept.columns) == {"k", "at", "p", "v"}
    copies = fl.same_content(kept, "k", "p", "v")
    assert sorted(tuple(r) for r in copies.where("k is not null").collect()) == [("b", "a", "same_content"), ("d", "c", "same_content")]
    assert fl.same_content(df.where("k = 'zz'"), "k", "p", "v").count() == 0
