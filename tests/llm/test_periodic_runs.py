"""Periodic runs against the definition, word by word."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from periodica.llm import periodic_runs as pr


def brute_runs(w):
    """All maximal stretches by trying every lag; a period counts where no smaller one holds for the stretch."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            part = w[s : s + n]
            if n >= max(6, 4 * q) and not any(part[p:] == part[: n - p] for p in range(1, q)):
                out.append((s, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted=True):
    w = [x for x in (text or "").encode().split()]
    if planted and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(parts):
    bounds = np.cumsum([0, *map(len, parts)])
    start, length, period = pr.find_runs(np.array([x for p in parts for x in p], dtype=np.int64), bounds)
    own = np.searchsorted(bounds, start, side="right") - 1
    out = [[] for _ in parts]
    for i, s, n, q in zip(own.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[i].append((s - int(bounds[i]), n, q))
    return out


def test_all_short_sequences():
    parts = [list(x) for n in range(13) for x in itertools.product((0, 1), repeat=n)]
    assert found(parts) == [brute_runs(p) for p in parts]


def test_random_sequences():
    rng, parts = random.Random(3), []
    for _ in range(600):
        w = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            root = [rng.randrange(rng.choice((1, 2, 9))) for _ in range(rng.randrange(1, 14))]
            w += (root * 9)[: rng.randrange(len(root) * 9)] + [rng.randrange(4) for _ in range(rng.randrange(5))]
        parts.append(w)
    assert found(parts) == [brute_runs(p) for p in parts]


def test_one_word_many_times():
    assert found([[7] * 200_000]) == [[(0, 200_000, 1)]]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("together", [1, 2 << 20])
def test_edge_cases(edge_docs, edge_rows, together, monkeypatch):
    monkeypatch.setattr(pr, "TOGETHER", together)
    got = rows_of(pr.digest(pr.detect(edge_docs, change=pr.with_period)))
    assert got == sorted((brute_row(i, t) for i, t in edge_rows), key=str)
    plain = rows_of(pr.digest(pr.detect(edge_docs)))
    assert plain == sorted((brute_row(i, t, planted=False) for i, t in edge_rows), key=str)


def test_no_rows(no_docs):
    assert pr.digest(pr.detect(no_docs)).collect() == []


def test_query(spark, small):
    from periodica.llm.queries import QUERIES

    got = rows_of(QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001"))
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 5
