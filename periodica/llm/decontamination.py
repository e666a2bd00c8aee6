"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A
window is ``size`` consecutive words of an item; an item of fewer words, but not
none, is one window. Every token window of every document is looked up in the
hash set, hits are verified word by word, and the words inside verified windows
are marked.

Null or empty texts have no words and no hits. Items without words are ignored.
Repeated items and repeated documents each count as rows of their own; a null
item id is reported as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import WordHashes, alnum_words, gram_hashes, keep_rows, list_array, text_columns
from periodica.session import cut_lineage

#: Bytes of benchmark text that one broadcast set holds; a larger benchmark is scanned block by block.
BLOCK_BYTES = 16 << 20


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    width = min(size, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if width else []


class WindowSet:
    """Verified lookup of the windows of one block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        hashes, found = WordHashes(), {}
        for item, words in items:
            for window in item_windows(words, size):
                found.setdefault(window, set()).add(item)
        by_width: dict[int, dict[int, list]] = {}
        for window, owners in found.items():
            h = int(gram_hashes(hashes.of(list(window)), len(window))[0])
            by_width.setdefault(len(window), {}).setdefault(h, []).append((window, owners))
        self.by_width = {w: (np.array(sorted(t), dtype=np.uint64), t) for w, t in by_width.items()}

    def scan(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Marks of hit words, and the items whose windows occur."""
        marks, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        for width, (known, table) in self.by_width.items():
            grams = gram_hashes(hashes, width)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for i in np.flatnonzero(known[at] == grams).tolist():
                for window, owners in table[int(grams[i])]:
                    if tuple(words[i : i + width]) == window:
                        items |= owners
                        marks[i] += 1
                        marks[i + width] -= 1
        return np.cumsum(marks)[:-1] > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted), hit_words (positions).

    The benchmark is measured first. Up to ``block_bytes`` of text it is one
    broadcast set. Beyond that it is cut into blocks by a hash of the item and
    the documents are scanned once per block, each pass written before the next,
    so a worker never holds more than one block.
    """
    found = text_columns(docs).withColumn("items", F.array().cast("array<string>")).withColumn("hit_words", F.array().cast("array<int>"))
    for rows, last in _blocks(benchmark, block_bytes):
        found = _pass(found, docs.sparkSession.sparkContext.broadcast(rows), size, last)
        if not last:
            found = cut_lineage(found, "windows")
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, bool]]:
    """(item, words) of each block of items, and whether it is the last."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    measured = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(measured) // block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], alnum_words(r["text"])) for r in part.toLocalIterator()], b == blocks - 1


def _pass(docs: DataFrame, items, size: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cache = WindowSet(items.value, size), WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n_words, n_hit, found, places = [], [], [], []
                texts, before, marked = (batch.column(c).to_pylist() for c in ("text", "items", "hit_words"))
                for text, had, at in zip(texts, before, marked, strict=True):
                    words = alnum_words(text)
                    hit, owners = windows.scan(words, cache.of(words))
                    hit[at] = True
                    where = np.flatnonzero(hit)
                    n_words.append(len(words))
                    n_hit.append(len(where))
                    found.append(sorted(owners.union(had)))
                    places.append(where.astype(np.int32))
                out = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                       "items": pa.array(found, pa.list_(pa.string())), "hit_words": list_array(places, pa.int32())}
                if last:
                    del out["text"]
                yield pa.record_batch(out)

    schema = "doc_id long, text string, n_words long, n_hit long, items array<string>, hit_words array<int>"
    out = docs.mapInArrow(run, schema.replace("text string, ", "") if last else schema)
    return out if last else out.select("doc_id", "text", "items", "hit_words")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows without a benchmark window in their own text, all columns kept; block by block as in ``scan``."""
    def judge(items):
        def made():
            windows, cache = WindowSet(items.value, size), WordHashes()

            def clean(texts: list) -> list[bool]:
                split = (alnum_words(t) for t in texts)
                return [not windows.scan(words, cache.of(words))[1] for words in split]

            return clean

        return made

    for rows, last in _blocks(benchmark, block_bytes):
        docs = keep_rows(docs, judge(docs.sparkSession.sparkContext.broadcast(rows)))
        if not last:
            docs = cut_lineage(docs, "clean")
    return docs
