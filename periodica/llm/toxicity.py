"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, neighbouring pairs and pairs with one
word between, lower-cased words of letters, digits and non-ASCII bytes, hashed
into ``2**BITS`` slots; each is present or absent. Per-coordinate rates and an L1 penalty
leave few weights, which are broadcast as (slot, weight) arrays.

The model learns from a bounded sample of labelled rows (``MAX_ROWS``, in the
order of a hash of the id, so it is spread over all sources). Everything else
covers all rows. Null or empty texts have the bias only and get its score. Rows
whose label is null or not 0/1, or without an id, are not learned from. A
repeated id is learned once per row. Without labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import WordHashes, alnum_words, by_document, keep_rows, mix, returns_memory, text_columns

BITS = 22
#: Most labelled rows that the model is fitted on, and most words they may hold.
MAX_ROWS = 8_000
MAX_WORDS = 12_000_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    updates: int = 24_000  # passes are repeated until as many rows have been learned


def features(words: list[bytes], cache: WordHashes) -> np.ndarray:
    """Distinct slots of a text's words, pairs and skip pairs; slot 0 is the bias."""
    if not words:
        return np.zeros(1, dtype=np.int64)
    h = cache.of(words)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])
    skips = mix(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1))
    slots = (np.concatenate([mix(h), pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([np.zeros(1, dtype=np.int64), np.unique(slots[slots > 0])])


def fit(rows: list[tuple[np.ndarray, float]], rates: Rates = Rates()) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero after whole passes of ``rates.updates`` rows or more."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        size = np.abs(zi) - np.where(at == 0, 0.0, rates.l1)
        return np.where(size > 0, -np.sign(zi) * size / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2), 0.0)

    for _ in range(-(-rates.updates // len(rows)) if rows else 0):
        for at, label in rows:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rates.alpha * w
            n[at] = ni + g * g
    slots = np.flatnonzero(z)
    w = weights(slots)
    return slots[w != 0], w[w != 0]


def learn(docs: DataFrame, labels: DataFrame, usable, rates: Rates = Rates(), max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from labelled rows of ``docs`` for which ``usable(doc_id)`` holds.

    The sample's ids are at most ``max_rows`` (hence a bounded broadcast); their
    texts meet in one task in hash order, which stops taking rows once it holds
    ``MAX_WORDS`` words.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label"))
        .where("doc_id is not null and label in (0, 1)").where(usable(F.col("doc_id")))
        .withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id", "label").limit(max_rows)
    )
    sample = text_columns(docs).join(F.broadcast(chosen), "doc_id").select("rank", "doc_id", "label", "text")

    def train(batches):
        cache, rows, words_held = WordHashes(), [], 0
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = alnum_words(text)
                words_held += len(words)
                if words_held <= MAX_WORDS:
                    rows.append((features(words, cache).astype(np.int32), label))
        slots, w = fit(rows, rates)
        yield pa.record_batch({"slot": pa.array(slots, pa.int64()), "weight": pa.array(w, pa.float64())})

    model = sample.repartition(1).sortWithinPartitions("rank", "doc_id", "text").mapInArrow(returns_memory(train), "slot long, weight double").toPandas()
    return model["slot"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def _scorer(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> Callable[[list], np.ndarray]:
    """Function from texts to scores, for tasks over ``docs``."""
    slots, values = weights
    model = docs.sparkSession.sparkContext.broadcast((slots.astype(np.int32), values.astype(np.float32)))
    some, held, cache = len(slots) > 0, [], WordHashes()

    def scores(texts: list) -> np.ndarray:
        if not held:
            dense = np.zeros(1 << BITS, dtype=np.float32)
            dense[model.value[0]] = model.value[1]
            held.append(dense)
        total = np.array([float(held[0][features(alnum_words(t), cache)].sum()) for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) if some else np.zeros(len(texts))

    return scores


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    scores = _scorer(docs, weights)

    def mapped(ids: list, texts: list) -> pa.RecordBatch:
        p = scores(texts)
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(p), "predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    return by_document(text_columns(docs), "doc_id long, score double, predicted int", mapped)


def training_id(doc_id):
    """Rows whose crc32(doc_id as text) mod 4 is not 2 may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are not rejected by their own text, all columns kept."""
    scores = _scorer(docs, learn(docs, labels, training_id))
    return keep_rows(docs, lambda: lambda texts: scores(texts) < THRESHOLD)
