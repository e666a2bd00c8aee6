"""Delimited records with quoted line breaks, however the file is split."""

import csv
import io
import random

import pytest

from periodica.sources import delimited as de
from periodica.sources.records import records


@pytest.fixture()
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def to(size):
        for k, v in zip(keys, (str(size), "1", "1")):
            spark.conf.set(k, v)

    yield to
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def landed(tmp_path, *texts):
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
    return str(tmp_path)


def parsed(spark, path):
    found = records(de.read_lines(spark, path, "UTF-8"))
    return sorted([c for row in csv.reader(io.StringIO(r["value"], newline="")) for c in row] for r in found.collect())


def whole(*texts):
    return sorted(row for t in texts for row in csv.reader(io.StringIO(t, newline="")))


def random_file(rng):
    cell = lambda: rng.choice(("a", "", "b b", "x\ny", '"', 'say "hi"', "\n\n", ",", 'p"q', "l\r\nm", "z" * rng.randrange(30)))
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=rng.choice((csv.QUOTE_ALL, csv.QUOTE_MINIMAL))).writerows([[cell(), cell(), cell() or "e"] for _ in range(rng.randrange(1, 14))])
    return out.getvalue()


@pytest.mark.parametrize("size", [15, 1 << 20])
def test_random_files(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    texts = [random_file(rng) for _ in range(3)]
    path = landed(tmp_path, *texts)
    tiny_splits(size)
    lines = de.read_lines(spark, path, "UTF-8")
    assert lines.select("file", "start").distinct().count() > {15: 12, 1 << 20: 2}[size]
    assert parsed(spark, path) == whole(*texts)


CASES = (
    'a"b,c\n1,"2\n3"\n', 'x,"open at the end\nand more', '"one ""quoted""\nword",2\n"a"b\nc,d\n', 'é,"ü\n"\n', '"","\n"\n', '1,2\n\n3,"4\n\n5"\n', ' "a\nb\n', "")


@pytest.mark.parametrize("size", [4, 1 << 20])
def test_cases(spark, tmp_path, tiny_splits, size):
    tiny_splits(size)
    assert parsed(spark, landed(tmp_path, *CASES)) == whole(*CASES)


@pytest.mark.parametrize("size", [12, 1 << 20])
def test_rows_by_number(spark, tmp_path, tiny_splits, size):
    body = "".join(f'{i},"line {i}\nof ""two"" {i}"\r\n' for i in range(12))
    path = landed(tmp_path, *['"note\nof two lines",\r\nkey,"the\ntext"\r\n' + body.replace("line", f"{n} line") for n in "ab"])
    if size > 12:
        tiny_splits(size)
        df = de.read_rows(spark, path, 1, 2)
        assert df.columns == ["key", "the\ntext"]
        assert sorted((r[0], r[1]) for r in df.collect()) == sorted((str(i), f'{n} line {i}\nof "two" {i}') for n in "ab" for i in range(12))
    else:  # a header that does not begin in the first split is not found
        tiny_splits(size)
        with pytest.raises(ValueError):
            de.read_rows(spark, path, 1, 2)


def test_without_breaks(spark, tmp_path, tiny_splits):
    path = landed(tmp_path, "k,v\n1,a\n2,\"b\"\n", "k,v\n", "k,v\n3,c\\\n")
    tiny_splits(1 << 20)
    got = sorted((r[0], r[1]) for r in de.read_rows(spark, path).collect())
    assert got == [("1", "a"), ("2", "b"), ("3", "c\\")]


def test_split_anew(spark, tmp_path, tiny_splits):
    path = landed(tmp_path, random_file(random.Random(9)) * 2)
    tiny_splits(20)
    found = records(de.read_lines(spark, path, "UTF-8"))
    tiny_splits(33)
    with pytest.raises(Exception, match="split differently"):
        found.collect()
