"""N-gram Jaccard self-join by a count-vector R-tree, and the groups of linked documents.

A document's set holds its distinct shingles of five blank-separated words, A-Z
lower-cased; with fewer words the whole sequence is one shingle. Two documents
link when ``100 * |A & B| >= percent * |A | B|``. Sets are compared as 64-bit
hashes of shingles.

1. Equal sets form a class, and only classes are compared. Each class lists as
   keys the rarest ``n - ceil(percent * n / 100) + 1`` of its ``n`` shingles, so
   linked classes share a key. Rarity comes from a fixed-size count sketch over
   all documents, read in spreads above its median: it only settles the order of shingles, never which pairs count.
2. Classes of one key form a bucket, or several where their sizes are too far apart
   to link. A bucket has three pivots: the member whose
   keys are shared most, as an original's are beside its edited copies, and those
   first and last by a hash, so that the buckets of a group mostly agree on them.
   Each class is first verified against the pivot of each kind with which it
   shares most keys. That links most of a large group of copies at a cost linear
   in its rows.
3. Buckets that still hold several groups are cut into leaves by size and salt;
   pairs of leaves are spread over tasks. In a task the shingles are hashed into
   coordinate groups, the group counts are points, and a packed R-tree over the
   points prunes every node or pair whose summed coordinate minima cannot reach
   the overlap needed. What is left is held against finer counts, so that nearly
   all pairs that go on are links. Pairs already in one group are skipped, and so
   are those that both classes name an earlier bucket for (each names its first
   eight); the first bucket that a pair shares never skips it.
4. Surviving pairs are verified on the whole sets, and linked classes merge.

Null or empty texts and texts of blanks have an empty set and link with nothing;
each is its own component. Repeated rows and ties fall into one class. A null
doc_id keeps its row; its component is the smallest id of its group, or null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from periodica.llm.common import gram_hashes, linked_groups, list_array, returns_memory, shingle_set, signed, text_columns
from periodica.session import cut_lineage

WORDS = 5
PERCENT = 75
#: Cells of the rarity sketch and of the filter of classes with a key partner; both have this size at any scale.
SKETCH_BITS = 22
FILTER_BITS = 23
LEAF = 256
#: Buckets of a class that its rows name, so that a pair of many common buckets goes on from one.
EARLIER = 8
FANOUT = 16
#: Coordinates of a count point that are added up to one coordinate of the tree.
FOLD = 4
SLICES = 64


def _class_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def text_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the blank-separated words of each text, A-Z lower-cased; each distinct word is hashed once."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    distinct, which = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[which]
    # Blanks at the ends of a text leave empty strings.
    real = np.array([len(w) > 0 for w in distinct], dtype=bool)[which]
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    return np.split(hashed[real], np.concatenate([[0], np.cumsum(real)])[ends][:-1])


def add_counts(held: np.ndarray, texts: pa.Array, words: int) -> None:
    """Count the shingles of texts in the sketch cells ``held``, in place: a second array of all cells would double a worker's memory."""
    hashes = text_hashes(texts)
    grams = np.concatenate([gram_hashes(h, min(words, len(h))) for h in hashes])
    np.add.at(held, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), held.dtype.type(1))


def rarity_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each sketch cell 0 where it holds about as much as the median cell, else higher with the excess.

    The excess is counted in spreads of the cells, so a frequent shingle shows above
    the noise of the others, which grows as the root of their number only.
    """
    cells = 1 << SKETCH_BITS

    def packed(part: np.ndarray) -> bytes:
        kind = "u1" if part.max() < 256 else "<u4" if part.max() < 1 << 32 else "<u8"
        return kind[-1].encode() + zlib.compress(part.astype(kind).tobytes(), 1)

    def unpacked(blob: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(blob[1:]), dtype={b"1": "u1", b"4": "<u4", b"8": "<u8"}[blob[:1]]).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                add_counts(held, batch.column("text").slice(start, 512), words)
        parts = np.split(held, SLICES)
        yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([packed(p) for p in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = unpacked(blob)
                total[s] = total[s] + part if s in total else part
        yield pa.record_batch({"slice": pa.array(list(total), pa.int32()), "counts": pa.array([packed(p) for p in total.values()], pa.binary())})

    schema = "slice int, counts binary"
    summed = docs.mapInArrow(returns_memory(count), schema).repartition(SLICES, "slice").mapInArrow(returns_memory(add), schema)
    held = np.zeros(cells, dtype=np.int64)
    for row in summed.collect():
        held.reshape(SLICES, -1)[row["slice"]] += unpacked(bytes(row["counts"]))
    middle, above = np.percentile(held, [50, 84])
    return np.ceil(np.log2(np.maximum((held - middle) / (3 * (above - middle + 1)), 1.0))).astype(np.uint8)


def signatures(docs: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """doc_id, n, class, and the keys and count point of the class on its first row in a task; a column ``mark`` is carried."""
    carried = [c for c in docs.columns if c == "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rarity = set(), levels.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                size, classes, keys, points = [], [], [], []
                for hashes in text_hashes(batch.column("text")):
                    s = shingle_set(hashes, words)
                    c = _class_of(s) if len(s) else None
                    size.append(len(s))
                    classes.append(c)
                    if c is None or c in seen:
                        keys.append(s[:0].view(np.int64))
                        points.append(None)
                        continue
                    points.append(count_point(s))
                    seen.add(c)
                    level = rarity[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    rare = s[np.argsort(level, kind="stable")] if level.any() else s
                    keys.append(signed(rare[: len(s) - -(-percent * len(s) // 100) + 1]))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(size, pa.int64()), "c": pa.array(classes, pa.int64()), "keys": list_array(keys, pa.int64()), "point": pa.array(points, pa.binary()), **{x: batch.column(x) for x in carried}})

    return docs.mapInArrow(returns_memory(run), "doc_id long, n long, c long, keys array<long>, point binary" + "".join(f", {x} binary" for x in carried))


def _scramble(values: np.ndarray) -> np.ndarray:
    v = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def buckets(sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members of buckets with two classes or more: bucket, c, n, size, shared keys.

    The classes of a key, by size, are cut where the size jumps by more than linked
    sets differ; no pair over a jump can link. Buckets with the same members count
    as one; ``bucket`` is a hash of the members.
    """
    keys = sigs.select(F.explode("keys").alias("k"), "c", "n").repartition("k").sortWithinPartitions("k", "n", "c")

    def found(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, n = k[fresh], c[fresh], n[fresh]
        apart = (k[1:] != k[:-1]) | (100 * n[:-1] < percent * n[1:])
        first = np.flatnonzero(np.concatenate([[True], apart])) if len(k) else np.empty(0, dtype=np.int64)
        length = np.diff(np.append(first, len(k)))
        mark = np.add.reduceat(_scramble(c), first).view(np.int64) if len(first) else first
        keep = np.repeat(length >= 2, length)
        return pa.record_batch({
            "bucket": pa.array(np.repeat(mark, length)[keep], pa.int64()), "c": pa.array(c[keep], pa.int64()), "n": pa.array(n[keep], pa.int64()),
            "size": pa.array(np.repeat(length, length)[keep], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 3
        for batch in batches:
            k, c, n = (np.concatenate([r, batch.column(x).to_numpy()]) for r, x in zip(rest, ("k", "c", "n"), strict=True))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield found(k[:cut], c[:cut], n[:cut])
            rest = [k[cut:], c[cut:], n[cut:]]
        yield found(*rest)

    rows = keys.mapInArrow(returns_memory(run), "bucket long, c long, n long, size long")
    return rows.groupBy("bucket", "c", "n", "size").agg(F.count("*").alias("shared"))


def class_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets of classes: one row (c, n, members) for each class of ``reps(c, doc_id)``.

    The ids reach the tasks as a bitmap of fixed size, so that other documents
    are passed over; those that merely share a bit come along and do no harm.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    marked = reps.groupBy(F.bitmap_bucket_number(cell + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell + 1)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in marked.collect():
        at = (row["b"] - 1) * 4096
        bits[at : at + 4096] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bitmap = set(), np.frombuffer(known.value, dtype=np.uint8)
        for whole in batches:
            at = whole.column("cell").to_numpy()
            whole = whole.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))
            for start in range(0, whole.num_rows, 512):
                classes, members = [], []
                for hashes in text_hashes(whole.column("text").slice(start, 512)):
                    s = shingle_set(hashes, words)
                    c = _class_of(s) if len(s) else None
                    if c is not None and c not in seen:
                        seen.add(c)
                        classes.append(c)
                        members.append(signed(s))
                if classes:
                    yield pa.record_batch({"c": pa.array(classes, pa.int64()), "n": pa.array([len(m) for m in members], pa.int64()), "members": list_array(members, pa.int64())})

    found = docs.select("text", cell.alias("cell")).mapInArrow(returns_memory(run), "c long, n long, members array<long>")
    return found.join(reps.select("c"), "c", "left_semi").dropDuplicates(["c"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("c").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("c").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("ma") + F.size("mb") - F.col("common"))).select("a", "b")


def count_point(members: np.ndarray) -> bytes:
    """Counts of a set's members in hash groups: a power of two of groups that grows with the set."""
    bits = min(12, max(4, (len(members) // 3).bit_length())) + FOLD.bit_length() - 1
    groups = (_scramble(members) >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(groups, minlength=1 << bits)
    kind = "u1" if counts.max() < 256 else "<u4"
    # Small counts in no order: nothing repeats but the values, so codes by frequency alone are shortest.
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return kind[-1].encode() + coder.compress(counts.astype(kind).tobytes()) + coder.flush()


def _point(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), dtype="u1" if blob[:1] == b"1" else "<u4").astype(np.int32)


def within_bound(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed coordinate minima reach the overlap that linked sets have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True):
                x, y = _point(x), _point(y)
                width = min(len(x), len(y))
                overlap = np.minimum(x.reshape(width, -1).sum(axis=1), y.reshape(width, -1).sum(axis=1)).sum()
                keep.append((100 + percent) * overlap >= percent * (x.sum() + y.sum()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = points.select(F.col("c").alias("a"), F.col("point").alias("pa"))
    right = points.select(F.col("c").alias("b"), F.col("point").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(returns_memory(run), "a long, b long")


class CountTree:
    """Packed R-tree over count vectors; a node keeps the upper corner of its box and its smallest set."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.points = sizes[self.order], points[self.order]
        first = np.arange(0, len(sizes), FANOUT)
        self.corner = np.maximum.reduceat(self.points, first, axis=0)
        self.low, self.high = self.sizes[first], np.maximum.reduceat(self.sizes, first)

    def candidates(self, other: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers whose summed minima reach the needed overlap."""
        for i in range(len(self.low)):
            bound = np.minimum(self.corner[i], other.corner).sum(axis=1)
            near = (100 * other.high >= percent * self.low[i]) & (100 * self.high[i] >= percent * other.low)
            near &= (100 + percent) * bound >= percent * (self.low[i] + other.low)
            rows = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(self.sizes)))
            for j in np.flatnonzero(near):
                cols = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(other.sizes)))
                overlap = np.minimum(self.points[rows, None, :], other.points[None, cols, :]).sum(axis=2)
                a, b = self.sizes[rows][:, None], other.sizes[cols][None, :]
                ok = ((100 + percent) * overlap >= percent * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                x, y = np.nonzero(ok)
                if len(x):
                    yield self.order[rows[x]], other.order[cols[y]]


def _fold(points: list[np.ndarray], width: int) -> np.ndarray:
    return np.stack([p if len(p) == width else p.reshape(width, -1).sum(axis=1) for p in points])


def tree_pairs(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of ``members(bucket, c, n, size, comp)`` in different groups of one bucket, by ``points(c, point)``."""
    members = cut_lineage(members, "members")
    # A class brings its smallest buckets along: a pair that meets in one of them on both sides goes on from the first alone.
    first = members.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("bucket")), 1, EARLIER).alias("first"))
    points = points.select("c", "point").join(first, "c")
    spread = F.ceil(F.col("size") / LEAF)
    cut = F.concat_ws(":", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long"), F.pmod(F.xxhash64("c"), spread))
    # A small bucket is one leaf, a larger one is cut by size band and salt.
    small = members.where(spread <= 1).select("bucket", F.lit("").alias("l1"), F.lit("").alias("l2"), F.lit(0).alias("side"), "c", "n", "comp")
    members = members.where(spread > 1).withColumn("leaf", cut)
    leaves = members.select("bucket", "leaf").distinct()
    band = F.split("leaf", ":")[0].cast("int")
    left = leaves.select("bucket", F.col("leaf").alias("l1"), band.alias("b1"))
    right = leaves.select("bucket", F.col("leaf").alias("l2"), band.alias("b2"))
    # A leaf meets itself and the leaves of its own and the next size band.
    meets = left.join(right, "bucket").where("b2 = b1 + 1 or (b2 = b1 and l2 >= l1)").select("bucket", "l1", "l2")
    one = meets.join(members.withColumnRenamed("leaf", "l1"), ["bucket", "l1"]).withColumn("side", F.lit(0))
    two = meets.where("l1 <> l2").join(members.withColumnRenamed("leaf", "l2"), ["bucket", "l2"]).withColumn("side", F.lit(1))
    rows = small.unionByName(one.select(small.columns)).unionByName(two.select(small.columns))
    # The points come last, so that they travel once.
    rows = rows.join(points, "c").withColumn("first", F.filter("first", lambda b: b < F.col("bucket")))
    rows = rows.select(*small.columns, "point", "first").repartition("bucket", "l1", "l2").sortWithinPartitions("bucket", "l1", "l2", "side", "c")

    def join(group: list[dict]) -> Iterator[tuple[int, int]]:
        if set(group[0]["first"]).intersection(*(r["first"] for r in group)):
            return  # all pairs meet in an earlier bucket
        for r in group:
            r["point"] = _point(r["point"])
        by_width: list[dict[int, list[dict]]] = [{}, {}]
        for r in group:
            by_width[r["side"]].setdefault(len(r["point"]), []).append(r)
        own = not by_width[1]
        left, right = by_width[0], by_width[0] if own else by_width[1]
        # Sets that can link have points of equal width, or one is twice as wide and is folded.
        for wide, rows in left.items():
            for other in (wide // 2, wide, wide * 2):
                if other in right and not (own and other < wide):
                    yield from _meet(rows, right[other], min(wide, other), own and other == wide)

    def _meet(rows: list[dict], others: list[dict], width: int, own: bool) -> Iterator[tuple[int, int]]:
        points = [_fold([r["point"] for r in s], width) for s in (rows, others)]
        sizes = [np.array([r["n"] for r in s]) for s in (rows, others)]
        trees = [CountTree(n, p.reshape(len(p), -1, FOLD).sum(axis=2)) for n, p in zip(sizes, points, strict=True)]
        comps, classes = ([np.array([r[x] for r in s], dtype=np.int64) for s in (rows, others)] for x in ("comp", "c"))
        for x, y in trees[0].candidates(trees[1], percent):
            other = comps[0][x] != comps[1][y]
            if own:
                other &= classes[0][x] < classes[1][y]
            x, y = x[other], y[other]
            if not len(x):
                continue
            near = (100 + percent) * np.minimum(points[0][x], points[1][y]).sum(axis=1) >= percent * (sizes[0][x] + sizes[1][y])
            for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                r, s = rows[i], others[j]
                if set(r["first"]).isdisjoint(s["first"]):
                    yield min(r["c"], s["c"]), max(r["c"], s["c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = list(join(group)) if len(group) > 1 else []
            if pairs:
                yield pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["bucket"], row["l1"], row["l2"])
                if key != at:
                    yield from flush()
                    at, group = key, []
                group.append(row)
        yield from flush()

    return rows.mapInArrow(returns_memory(run), "a long, b long").distinct()


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = _grouped(text_columns(docs), words, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Every row's signature with ``root``, which the rows of a group share, and ``component_id``, both null without words."""
    spark = texts.sparkSession
    levels = spark.sparkContext.broadcast(rarity_levels(texts.select("text"), words))
    sigs = cut_lineage(signatures(texts, levels, words, percent), "signatures")
    members = cut_lineage(buckets(sigs, percent), "buckets")
    classes = sigs.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    points = sigs.where("point is not null").select("c", "point").dropDuplicates(["c"])

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs, "pairs")
        used = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        sets = cut_lineage(class_sets(texts, used.join(classes, "c"), words), "sets")
        return cut_lineage(verified(pairs, sets, percent), "links")

    open_share = members.groupBy("c").agg((F.sum("shared") / F.max("n")).alias("open"))
    member, mark = F.struct("c", "n"), F.xxhash64("c")
    pivots = members.join(open_share, "c").groupBy("bucket").agg(F.array(F.max_by(member, F.struct("open", "c")), F.max_by(member, mark), F.min_by(member, mark)).alias("p"))
    star = members.join(pivots.select("bucket", F.posexplode("p").alias("turn", "p")), "bucket").select("c", "n", "shared", "turn", F.col("p.c").alias("pivot"), F.col("p.n").alias("pivot_n"))
    fits = F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n")
    star = star.where((F.col("c") != F.col("pivot")) & fits).groupBy("c", "turn", "pivot").agg(F.sum("shared").alias("shared"))
    star = star.groupBy("c", "turn").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot")).select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b")).distinct()
    links = linked(within_bound(star, points, percent))
    roots = cut_lineage(linked_groups(links), "roots")

    grouped = members.join(roots, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "c")).drop("node", "root")
    open_buckets = grouped.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    left = grouped.join(open_buckets, "bucket").select("bucket", "c", "n", "size", "comp").distinct()
    more = linked(tree_pairs(left, points, percent))
    roots = cut_lineage(linked_groups(links.unionByName(more)), "roots")

    lowest = classes.withColumnRenamed("doc_id", "lowest").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).select("c", "root", "lowest")
    lowest = cut_lineage(lowest, "lowest")
    named = lowest.groupBy("root").agg(F.min("lowest").alias("component_id")).join(lowest, "root").select("c", "root", "component_id")
    named = cut_lineage(named, "named")
    return sigs.drop("keys", "point").join(named, "c", "left")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each linked group, the one with the smallest id (none last) and then digest; all columns kept.

    Rows are told apart by id and digest of the text, so other texts under the
    id of a copy stay. Rows without words are groups of their own and all stay.
    Only repeats of a kept id and text meet in an aggregate. A bitmap of fixed size
    sets aside the rows that may be copies; the texts of the others stay where they are.
    """
    id_, mark = F.col("doc_id").cast("long"), F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    rows = _grouped(text_columns(docs).withColumn("mark", mark), words, percent).where("c is not null")
    keys = cut_lineage(rows.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times")), "keys")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"))
    told = keys.join(first, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    told = told.where("not kept or times > 1").select(F.col("doc_id").alias("_told_id"), F.col("mark").alias("_told_mark"), "kept")
    told = cut_lineage(told, "told")
    marked = docs.withColumn("_id", id_).withColumn("_mark", mark)
    same = F.col("_id").eqNullSafe(F.col("_told_id")) & (F.col("_mark") == F.col("_told_mark"))
    sifted, repeats = _sifted(marked, told), told.where("kept")
    rest = sifted.where("_near").join(told, same, "left_anti").unionByName(sifted.where("not _near"))
    once = _sifted(marked, repeats).where("_near").join(repeats, same, "left_semi").dropDuplicates(["_id", "_mark"])
    return rest.unionByName(once).drop("_id", "_mark", "_near")


def _sifted(marked: DataFrame, told: DataFrame) -> DataFrame:
    """``marked`` with ``_near``, false only where (_id, _mark) is none of ``told(_told_id, _told_mark)``."""
    def cell(*key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS)) + 1

    asked = cell("_told_id", "_told_mark")
    slices = told.groupBy(F.bitmap_bucket_number(asked).alias("_slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(asked)).alias("_bits"))
    at = F.bitmap_bit_position("_cell").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    rows = marked.withColumn("_cell", cell("_id", "_mark"))
    rows = rows.join(F.broadcast(slices), F.bitmap_bucket_number("_cell") == F.col("_slice"), "left")
    return rows.withColumn("_near", F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop("_cell", "_slice", "_bits")
