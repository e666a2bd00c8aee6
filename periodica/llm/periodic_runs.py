"""Periodic runs of words, and texts without their repetition.

A run is a stretch of words of smallest period ``q`` (words ``q`` apart are
equal), at least ``max(6, 4 * q)`` words long, that no neighbouring word extends.

The search goes over the diagonals "this word equals the one ``q`` before". All
earlier occurrences of a frequent word would be active diagonals at once, as many
as the square of its count, so only the diagonal that can still grow into a run
is kept active: inside a run of smallest period ``q`` a gram of ``q`` words or
more last occurred exactly ``q`` words ago, as its root is primitive. So for grams
of 1, 2, 4, ... words each word has one active lag, that of the gram's last
earlier occurrence; equal lags of neighbouring words add up to the match length,
and a diagonal that ends is a run if it is long enough. Lags ``k / 2 < q <= k`` are
read from grams of ``k`` words. Words whose gram occurs once leave the search, so
ordinary text is over after a few lengths. Work is ``n log n``, memory a few
numbers a word of the documents at hand.

Null and empty texts have no words and no runs. Rows are judged one by one:
repeated rows, ids and nulls of other columns make no difference, and other
columns of ``docs`` are not read. A text of any length is worked on as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import text_columns

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Documents are searched together up to so many bytes of text (or one document).
TOGETHER = 2 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the sequences ``ids[bounds[i]:bounds[i + 1]]``, by start, then period."""
    sizes = np.diff(bounds)
    own = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(bounds[1:], sizes)
    most = np.repeat(sizes // LEAST_PERIODS, sizes)  # the longest period that a sequence has room for
    found: list[np.ndarray] = []
    pos = np.flatnonzero(most >= 1)
    key = own[pos] * (int(ids.max(initial=0)) + 1) + ids[pos]
    at = np.full(len(ids), -1, dtype=np.int64)
    k = 1
    while len(pos):
        order = np.argsort(key, kind="stable")
        new = np.ones(len(pos), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        again = order[~new]  # grams that stood before, and the place where each did last
        lag = np.zeros(len(pos), dtype=np.int64)
        lag[again] = pos[again] - pos[order[np.flatnonzero(~new) - 1]]
        active = np.flatnonzero((lag > k // 2) & (lag <= k))
        if len(active):
            p, q = pos[active], lag[active]
            first = np.ones(len(p), dtype=bool)
            first[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1])
            last = np.append(first[1:], True)
            start, period = p[first] - q[first], q[first]
            length = p[last] + k - start
            long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([start[long], length[long], period[long]]))
        # Grams of twice the length repeat only where both halves do.
        number = np.empty(len(pos), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        often = np.bincount(number) > 1
        keep = often[number]
        pos, number = pos[keep], number[keep]
        at[pos] = number
        room = (pos + 2 * k <= end[pos]) & (most[pos] > k)
        second = np.full(len(pos), -1, dtype=np.int64)
        second[room] = at[pos[room] + k]
        at[pos] = -1
        keep = second >= 0
        pos, key = pos[keep], number[keep] * len(often) + second[keep]
        k *= 2
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _searched(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
    bounds = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in docs], out=bounds[1:])
    words = [w for d in docs for w in d]
    codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(codes, bounds)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    dropped = np.cumsum(cover)[:-1] > 0
    doc = np.searchsorted(bounds, start, side="right") - 1
    edges = np.searchsorted(doc, np.arange(len(docs) + 1))
    runs, collapsed = [], []
    for i, own in enumerate(docs):
        mine = slice(edges[i], edges[i + 1])
        runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip((start[mine] - bounds[i]).tolist(), length[mine].tolist(), period[mine].tolist())])
        if edges[i] < edges[i + 1]:
            out = dropped[bounds[i] : bounds[i + 1]].tolist()
            own = [w for w, gone in zip(own, out) if not gone]
        collapsed.append(b" ".join(own).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(runs, kind), pa.array(collapsed, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs``: its words, its runs by start and period, and its text with each run cut to its first period.

    ``collapsed`` joins the kept words by one blank. ``change`` may alter the words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                text = texts[row].as_py() or ""
                words = text.encode().split()
                ids.append(doc_id)
                held.append(change(doc_id, words) if change else words)
                size += len(text)
                if size >= TOGETHER:
                    yield _searched(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield _searched(ids, held)

    return text_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of which a tenth of the documents, by a checksum of the id, repeat a stretch to the end; without an id none do."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and digests of ``detect``'s rows."""
    order = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    top = found.withColumn("top", F.array_min(order))
    length, period = F.col("top.length"), F.col("top.period")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
