"""Shared pieces of the text operators: words, hashes, lean frames, linked groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from periodica.session import cut_lineage

#: Bytes that are no part of a letter-or-digit word become blanks, A-Z become a-z.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def blank_words(text: str | None) -> list[bytes]:
    """Words between blanks (0x20, 0x09-0x0D), A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


class WordHashes(dict):
    """Word to unsigned 64-bit hash; forgets all when full, so its memory is bounded."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words, in text order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column of numpy arrays."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def without_cycles(run):
    """A task function that makes many small objects and no cycles, spared the collector's searches for them."""
    def wrapped(batches):
        import gc

        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return wrapped


def give_back() -> None:
    """Hand freed memory back to the machine; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returns_memory(run):
    """A task function around which its worker gives back what it freed.

    Spark keeps the workers of chained and earlier stages side by side, and each
    would hold the most that any of its tasks needed.
    """
    def wrapped(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_batches(spark) -> None:
    """Arrow batches of a thousand rows: a batch of long texts must fit a worker several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever else the frame holds; missing text stays null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def by_document(docs: DataFrame, schema: str, rows: Callable[[list, list], pa.RecordBatch | None]) -> DataFrame:
    """Map batches of (ids, texts) to record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = rows(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(returns_memory(run), schema)


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows whose own text is kept, all columns as they are; ``judge()`` gives a task its function from texts to flags."""
    plain = isinstance(docs.schema[text_col].dataType, StringType)
    given = docs if plain else docs.withColumn("_text", F.col(text_col).cast("string"))
    at, width = docs.columns.index(text_col) if plain else len(docs.columns), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = judge()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = part.filter(pa.array(np.asarray(kept(part.column(at).to_pylist()), dtype=bool)))
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays(out.columns[:width], schema=pa.schema([out.schema.field(i) for i in range(width)]))

    return given.mapInArrow(returns_memory(run), docs.schema)


def null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in cols))


def linked_groups(links: DataFrame, label: str = "groups") -> DataFrame:
    """(node, root): smallest node reachable over ``links(a, b)``, nodes with a link only.

    Each round hangs the larger end of every edge and its neighbours on the
    smallest neighbour, so rounds grow with the logarithm of a path. Edges are
    held distinct and each round is a written table. A hub's edges meet only in
    partial aggregates, never in one list.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = cut_lineage(edges, label)
    while True:
        # Each node looks at its smallest neighbour (itself included) ...
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # ... larger neighbours move there (large star), then smaller ones (small star).
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct(), label)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        small = cut_lineage(small, label)
        edges = small
        # Done when only stars are left: no node hangs on two, and no centre hangs on another.
        double = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
        if not double and not edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def only_marked(docs: DataFrame, marks: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be among ``marks(doc_id)``, and others that share a bit of a fixed-size bitmap.

    Spares a join the shuffle of all texts; it never drops a marked row.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    found = marks.groupBy(F.bitmap_bucket_number(cell + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell + 1)).alias("bits"))
    held = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in found.collect():
        at = (row["b"] - 1) * 4096
        held[at : at + 4096] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(held.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(known.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column("_cell").to_numpy()
            yield batch.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))

    marked = docs.withColumn("_cell", cell)
    return marked.mapInArrow(run, marked.schema).drop("_cell")
