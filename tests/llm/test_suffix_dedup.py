"""Removal of repeated strings against a plain search."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from periodica.llm import suffix_dedup as sd


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, want = set(), Counter()
    for k in order:
        i, t = rows[k]
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize(("length", "gram", "block"), [(100, 40, 1 << 23), (100, 40, 4000), (12, 5, 700)])
def test_repeats(spark, edge_docs, edge_rows, small, length, gram, block):
    more = [(r["doc_id"] + 50, r["text"]) for r in small.limit(60).collect()]
    more += [(200, "ab" * 300), (201, "é" * 120), (202, more[3][1][:150] + "xyz" + more[3][1][40:200])]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    got = Counter(tuple(r) for r in sd.digest(sd.repeats(docs, length, gram, block, shards=7)).collect())
    assert got == brute(list(edge_rows) + more, length)


def test_no_rows(no_docs):
    assert sd.digest(sd.repeats(no_docs)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    hashes = sd.PrefixHashes(data, sd.Powers())
    starts = rng.integers(0, 380, 300)
    segment = np.sort(rng.integers(0, 9, 300))
    order = sd.suffix_order(hashes, starts, segment, 20)
    want = sorted(range(300), key=lambda k: (segment[k], bytes(data[starts[k] : starts[k] + 20]), k))
    assert [(segment[k], bytes(data[starts[k] : starts[k] + 20])) for k in order] == [(segment[k], bytes(data[starts[k] : starts[k] + 20])) for k in want]
    same = hashes.extension(np.array([0, 5]), np.array([0, 5]), 20)
    assert same.tolist() == [20, 20]


def test_hash_collisions_are_verified():
    """Two different strings whose hashes are forced to agree are no repeats."""
    data = np.frombuffer(b"a" * 12 + b"b" * 12, dtype=np.uint8)
    hashes = sd.PrefixHashes(data, sd.Powers())
    hashes.of = lambda start, length: np.zeros(len(start), dtype=np.uint64)
    marks = sd.repeated(hashes, np.array([0, 12, 1]), np.zeros(3, dtype=np.int64), np.arange(3), 10)
    assert not marks[1]


@pytest.mark.parametrize("seed", range(6))
def test_strings_around_anchors(seed):
    """Places of anchors sorted once for all offsets against suffixes sorted for each offset."""
    rng, length, gram = np.random.default_rng(seed), 12, 5
    passages = [rng.integers(97, 99, 40).astype(np.uint8) for _ in range(3)]
    parts, place, before, n, anchor, at = [], [], [], [], [], 0
    for _ in range(60):
        body, mid = passages[rng.integers(3)].copy(), int(rng.integers(15, 18))
        body[rng.integers(40)] = 97
        ahead = int(rng.integers(0, length - gram + 1))
        count = int(rng.integers(1, ahead + 2))
        part = body[mid - ahead : mid - ahead + count - 1 + length]
        parts.append(part)
        place.append(at + ahead)
        before.append(ahead)
        n.append(count)
        anchor.append(int(body[mid : mid + gram].dot(1 << np.arange(gram))))
        at += len(part)
    data, place, before, n, anchor = np.concatenate(parts), *(np.array(x) for x in (place, before, n, anchor))
    rank = rng.permutation(60)
    got = sd.repeated_around(data, sd.Powers(), place, before, n, anchor, rank, length, gram)
    inst = np.repeat(np.arange(60), n)
    step = np.arange(len(inst)) - np.repeat(np.cumsum(n) - n, n)
    segment, start = anchor[inst] * length + before[inst] - step, (place - before)[inst] + step
    order = np.argsort(segment, kind="stable")
    want = np.zeros(len(inst), dtype=bool)
    want[order] = sd.repeated(sd.PrefixHashes(data, sd.Powers()), start[order], segment[order], rank[inst][order], length)
    assert got.tolist() == want.tolist() and 0 < want.sum() < len(want)
