"""Shards against a brute-force minimax partition."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from periodica.llm import sharding as sh


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute_capacity(sizes, shards):
    """Smallest largest part of a contiguous partition, by trying all last cuts."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = list(ends)
    for _ in range(shards - 1):
        best = [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))]
    return best[-1]


def brute_plan(texts, shards):
    groups = Counter()
    for t in texts:
        groups[sha(t)] += len((t or "").encode()) + 1
    own = []
    while len(own) < shards - 1:
        left = sum(n for d, n in groups.items() if d not in own)
        large = sorted((-n, d) for d, n in groups.items() if d not in own and n * (shards - len(own)) > left)
        if not large:
            break
        own.append(large[0][1])
    rest = [n for d, n in sorted(groups.items()) if d not in own]
    return own, brute_capacity(rest, shards - len(own)), groups


def check(rows, shards, got):
    own, capacity, groups = brute_plan([t for _, t in rows], shards)
    got = [tuple(r) for r in got]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(r[:3] for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for _, size, _, shard, slot in got:
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert max([n for s, n in sizes.items() if s >= len(own)], default=0) == capacity
    assert [sizes[i] for i in range(len(own))] == [groups[d] for d in own]
    return sizes


@pytest.mark.parametrize("shards,first", [(16, 3), (4, 1), (1, 1), (3, 1)])
def test_edge_cases(edge_docs, edge_rows, shards, first, monkeypatch):
    monkeypatch.setattr(sh, "FIRST", first)
    check(edge_rows, shards, sh.assign(edge_docs, shards).collect())


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_random_texts_in_rounds(spark, shards, monkeypatch):
    monkeypatch.setattr(sh, "FIRST", 1)
    monkeypatch.setattr(sh, "FURTHER", 1)
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randrange(300) + str(rng.randrange(90))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = check(rows, shards, sh.assign(docs, shards).collect())
    if shards < 16:
        assert min(sizes.values()) > 0.6 * max(sizes.values())


def test_a_third_in_one_group(spark):
    rows = [(None, "copy " * 20)] * 200 + [(i, f"text {i} " * 8) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = check(rows, 16, sh.assign(docs).collect())
    rest = [n for s, n in sizes.items() if s]
    assert len(rest) == 15 and min(rest) > 0.7 * max(rest)


def test_only_copies(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(9)], "doc_id long, text string")
    assert sorted(tuple(r)[3:] for r in sh.assign(docs).collect()) == [(0, i) for i in range(9)]


def test_bounds_meet():
    """Sums of stretches give the capacity only once the bounds are equal."""
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))]
        shards = rng.randrange(1, 8)
        want = brute_capacity(sizes, shards)
        width = rng.randrange(1, 4)
        stretches = [sh.Stretch(f"{i:03d}", sum(sizes[i : i + width]), str(i), str(min(i + width, len(sizes)) - 1)) for i in range(0, len(sizes), width)]
        low, high, ends, again = sh._bounded(stretches, shards)
        assert low <= want <= high and (low == high or again)
        cuts = [0, *sh._even_cuts(ends, high, shards), len(ends) - 1]
        assert all(0 <= ends[b] - ends[a] <= high for a, b in zip(cuts, cuts[1:]))


def test_no_rows(no_docs):
    assert sh.assign(no_docs).collect() == []


def test_written_shards(spark, edge_docs, edge_rows, tmp_path):
    clash = edge_docs.withColumnRenamed("source", "shard")
    plan = sh.write_shards(clash, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*clash.columns, "shard_2"}
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(edge_rows)
    assert back.groupBy("text").agg({"shard_2": "max"}).count() == back.select("text", "shard_2").distinct().count()
    assert len(plan.own) + len(plan.cuts) == 3


def test_query(spark, small):
    from periodica.llm.queries import QUERIES

    out = QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check([(r["doc_id"], r["text"]) for r in small.collect()], 16, out.select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    assert [tuple(r) for r in out.select("law", "grown_shard").distinct().collect()] == [("bytes", None)]
