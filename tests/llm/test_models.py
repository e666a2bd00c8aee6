"""License votes and language-model tries against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from periodica.llm import licenses, ngram_trie as nt


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


NOTICE = licenses.NOTICES[0][0]
LICENSED = [
    (300, "Under the GNU General Public-License. gnu general public license! Apache License; CC BY cc-by"),
    (301, "x " * 40 + NOTICE.upper().replace(" ", ", ")),
    (302, "y " * 10 + NOTICE.replace("free of charge", "quite free of any charge").replace("copy of", "copy")),
    (303, " ".join(NOTICE.split()[:8])), (304, "mit mit license license gnu general public public license"), (305, "of the of the of the"),
]


def test_licenses(spark, edge_docs, edge_rows, small, no_docs):
    rows = list(edge_rows) + LICENSED + [(r["doc_id"] + 1000, r["text"]) for r in small.collect()]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(edge_rows):], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        found = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        want[(i, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))] += 1
    assert got == want
    added = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(LICENSED, "doc_id long, text string")).collect()}
    assert added[301] == ("mit", 1.0) and added[302][0] == "mit" and 0.8 <= added[302][1] < 1
    assert added[303] == ("", 0.0) and added[305] == ("", 0.0) and added[300][1] == 1.0
    assert licenses.scan(no_docs).count() == 0


def brute_scores(rows, mu):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t in rows]
    train = [k for k, (i, _) in enumerate(rows) if nt.learns_from(i)]
    c, pairs, ctx = Counter(), Counter(), Counter()
    for k in train:
        c.update(tokens[k])
        ctx.update(["", *tokens[k][:-1]])
        pairs.update(zip(["", *tokens[k][:-1]], tokens[k], strict=True))
    n, v, out = sum(c.values()), len(c), []
    for (i, _), toks in zip(rows, tokens, strict=True):
        base = [(c[w] + 1) / (n + v + 1) for w in toks]
        full = [(pairs[a, w] + mu * p) / (ctx[a] + mu) for a, w, p in zip(["", *toks[:-1]], toks, base, strict=True)]
        out.append((i, not nt.learns_from(i), len(toks), sum(c[w] > 0 for w in toks), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


@pytest.mark.parametrize(("block", "shards"), [(1 << 23, None), (2000, 3)])
def test_scores(spark, edge_docs, edge_rows, small, block, shards):
    rows = list(edge_rows) + [(r["doc_id"] + 1000, r["text"]) for r in small.collect()]
    docs = edge_docs.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 1000 as doc_id", "text"))
    got = sorted((tuple(r) for r in nt.scores(docs, block_bytes=block, shards=shards).collect()), key=str)
    want = sorted(brute_scores(rows, nt.MU), key=lambda r: str(r))
    a, b = (Counter(r[:5] for r in x) for x in (got, want))
    assert a == b
    key = lambda r: (str(r[:5]), r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= g[2] * nt.STEP / 2 + 1e-6  # half a step of a share's log10 for each token
    held = [r for r in got if r[1] and r[2] > 20]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_shards_change_nothing(edge_docs, small):
    docs = edge_docs.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 1000 as doc_id", "text"))
    few, many = (sorted((tuple(r) for r in nt.scores(docs, block_bytes=1 << 16, shards=n).collect()), key=str) for n in (4, 64))
    assert [r[:5] for r in few] == [r[:5] for r in many]
    assert [r[6] for r in few] == pytest.approx([r[6] for r in many], rel=1e-12)


def test_scores_without_training(spark, no_docs):
    assert nt.scores(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = nt.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row)[:5] == (held, True, 3, 0, 0) and row["base_score"] == 0 and row["score"] == pytest.approx(0)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0, 7], [3, 5, 5, 900, 901, 5_000_000_000], list(range(0, 3000, 3)), [1 << 62]])
def test_elias_fano(values):
    ef, _ = nt.EliasFano.read(nt.EliasFano.build(np.array(values, dtype=np.uint64)).to_bytes(), 0)
    assert ef.get(np.arange(len(values))).tolist() == values
    asks = sorted({x + d for x in values for d in (-1, 0, 1) if x + d >= 0} | {0, 1, 1 << 61})
    want = [next((k for k, v in enumerate(values) if v >= x), len(values)) for x in asks]
    assert ef.successor(np.array(asks, dtype=np.uint64)).tolist() == want
