"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import base64
import hashlib
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from periodica.llm import decontamination, ngram_join, toxicity
from test_pairs_and_scans import brute_entropy, brute_groups, brute_windows

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    scores = toxicity.score(docs, toxicity.learn(docs, labels, toxicity.training_id))
    toxic = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    first = {i for i, _, component in brute_groups(rows) if i == component}
    rows = [(i, t) for i, t in rows if i in first and not brute_windows(t, bench)[1]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        text, at = "", 0
        for a, _, b, _ in brute_entropy(t):
            if a >= at:
                text += t[at:a] + "[redacted]"
            at = max(at, b)
        text += t[at:]
        ids = encoding.encode_ordinary(text)
        want[i] = (ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_columns(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
    clean = {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, edge_docs, FOLDER).collect()}
    assert clean == {r["doc_id"] for r in edge_docs.collect()}


def test_stages_judge_rows_by_their_own_text(spark, monkeypatch):
    schema = "doc_id long, text string, source string"
    words = [f"w{i}" for i in range(40)]
    a, b, near = " ".join(words), " ".join(f"x{i}" for i in range(30)), " ".join([*words, "more"])
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (7, near, "s"), (8, None, "s"), (8, "", "s"), (None, a, "s"), (None, "c d e", "s"), (None, "c d e", "s"), (9, "f g h", "s"), (9, "f g h", "s"), (None, "", "s")]
    got = sorted(map(tuple, ngram_join.keep_one(spark.createDataFrame(rows, schema).repartition(4)).collect()), key=str)
    want = [(1, a, "s"), (5, b, "s"), (8, None, "s"), (8, "", "s"), (None, "c d e", "s"), (9, "f g h", "s"), (None, "", "s")]
    assert got == sorted(want, key=str)

    bad = " ".join(f"t{i}" for i in range(12))
    rows = [(None, a, "s"), (None, f"q {bad} q", "s"), (3, bad, "s"), (3, b, "s"), (4, None, "s")]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    want = sorted([(None, a, "s"), (3, b, "s"), (4, None, "s")], key=str)
    bench = spark.createDataFrame([("i", bad), ("j", "u v"), ("k", "y z")], "item_id string, text string")
    for block in (1 << 24, 8):
        got = decontamination.keep_clean(docs, bench, block_bytes=block)
        assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == docs.columns

    slots = toxicity.features(toxicity.alnum_words(bad), toxicity.WordHashes())[1:]
    monkeypatch.setattr(toxicity, "learn", lambda *_: (np.append(0, slots), np.append(-5.0, np.full(len(slots), 2.0))))
    got = toxicity.drop_toxic(docs, None)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == docs.columns
