"""Removal of repeated byte strings, found by a suffix sort that compares by hashes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or same
document and earlier start) goes; strings are judged on the input.

1. Each ``LENGTH``-byte string names an anchor: the leftmost smallest hash of its
   ``GRAM``-byte substrings. Equal strings name equal anchors, and neighbouring strings
   mostly share one, so a document has about one anchor in thirty bytes.
2. Tasks cut documents into blocks and ask, packed by ranges of the hash, which
   anchors occur more than once. Only those go on, each with the bytes around it
   that hold all strings naming it. Within a block, equal surroundings are sent
   once, by their first place; the others are repeats already.
3. Where anchors meet, the text from each of an anchor's places on is a suffix, and
   the text before it one of the reversed bytes. Both are merge-sorted; two
   suffixes are compared through prefix polynomial hashes (mod 2**64), whose binary search
   finds the common extension in logarithmic steps. Neighbours in order are
   compared byte by byte. Strings that start ``d`` bytes before their anchor are
   equal where the reversed suffixes agree over ``d`` bytes and the others over
   the rest of ``LENGTH``; all but the first place are repeats.
4. Repeats return to their block, which drops the covered bytes.

Blocks are read more than once; a block that differs between readings fails the
job. Null or empty texts have no bytes. Rows without an id count as smallest; rows
with equal ids are ordered by block and place, so of two equal rows one stays.
Texts under ``LENGTH`` bytes are left alone. A text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from periodica.llm.common import mix, text_columns

LENGTH, GRAM = 100, 40
#: Marks the row that holds a block's texts; it sorts behind the answers to the block.
WHOLE = 1 << 30
BLOCK_BYTES = 4 << 20

#: Odd base of the polynomial and its inverse mod 2**64, and a random-looking value per byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)])) for x in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


class PrefixHashes:
    """Hash of any substring, and the common extension of any two places, of one byte string."""

    def __init__(self, data: np.ndarray, powers: Powers):
        n = len(data)
        up, self.down = powers.upto(n + 1)
        self.data, self.sums = data, np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def grams(self, length: int) -> np.ndarray:
        n = len(self.data) - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def extension(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Length, up to ``most``, over which the suffixes at ``i`` and ``j`` agree."""
        low, high = np.zeros(len(i), dtype=np.int64), np.full(len(i), most, dtype=np.int64)
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(i, mid) == self.of(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def anchors(hashes: PrefixHashes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first string start, last string start) of each anchor."""
    n = len(hashes.data) - length + 1
    if n <= 0:
        return (np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 3)
    keys = mix(hashes.grams(gram))
    best, at, width, span = keys, np.arange(len(keys), dtype=np.int32), 1, length - gram + 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        later = right < left
        best, at, width = np.where(later, right, left), np.where(later, at[step:], at[:-step]), width + step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n) - 1
    place = at[first].astype(np.int64)
    # The smallest of many hashes are small; mixed again they spread evenly over shards.
    return mix(keys[place]), place, first, last


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, byte plane by byte plane, compressed."""
    out = bytearray()
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.int64, copy=False) if a.dtype != np.uint64 else np.ascontiguousarray(a)
        out += len(a).to_bytes(8, "little") + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
        at += 8 + 8 * n
    return out


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, ids, texts); a block is known by a hash of its content."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            body = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            ids.append(doc)
            texts.append(body)
            size += len(body)
            if size >= block_bytes:
                yield _named(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _named(ids, texts)


def _named(ids: list, texts: list[bytes]) -> tuple[int, list, list[bytes]]:
    seen = xxhash.xxh3_64()
    for doc, text in zip(ids, texts, strict=True):
        seen.update(f"{doc}:{len(text)}:")
        seen.update(text)
    return int(np.uint64(seen.intdigest()).astype(np.int64)), ids, texts


def _row(**columns) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "shard": pa.int32(), "part": pa.int32(), "body": pa.binary(), "more": pa.binary(), "docs": pa.list_(pa.int64())}
    return pa.record_batch({k: pa.array([v], kinds[k]) for k, v in columns.items()})


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of ``column`` of a partition sorted by it."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != at:
                yield at, rows
                rows = []
            at = row[column]
            rows.append(row)
    if rows:
        yield at, rows


def suffix_order(hashes: PrefixHashes, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order that sorts the suffixes at ``starts`` within each segment (given in runs) by their first ``length`` bytes.

    Bottom-up merge sort: at each level every element finds its rank in the run
    beside its own by binary search, all elements at once.
    """
    order = np.arange(len(starts))
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else order
    size = np.diff(np.append(first, len(starts)))
    base, room = np.repeat(first, size), np.repeat(size, size)
    padded = np.append(hashes.data, 0)
    width = 1
    while len(size) and width < size.max():
        who = np.flatnonzero(room > width)
        inside = who - base[who]
        run = inside // width
        right = run % 2 == 1
        other = np.where(right, run - 1, run + 1) * width
        low = np.zeros(len(who), dtype=np.int64)
        high = np.clip(room[who] - other, 0, width)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) >> 1
            mine, theirs = starts[order[who[live]]], starts[order[base[who[live]] + other[live] + mid]]
            same = hashes.extension(mine, theirs, length)
            a, b = padded[mine + same], padded[theirs + same]
            # Right elements come after equal left ones.
            past = np.where(same >= length, right[live], b < a)
            low[live], high[live] = np.where(past, mid + 1, low[live]), np.where(past, high[live], mid)
        target = base[who] + (run - run % 2) * width + inside % width + low
        moved = order.copy()
        moved[target] = order[who]
        order, width = moved, 2 * width
    return order


def repeated(hashes: PrefixHashes, starts: np.ndarray, segment: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Marks suffixes whose first ``length`` bytes also start at a place of lower rank in their segment."""
    marks = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return marks
    order = suffix_order(hashes, starts, segment, length)
    s, g = starts[order], segment[order]
    equal = np.zeros(len(s), dtype=bool)
    beside = np.flatnonzero(g[1:] == g[:-1]) + 1
    beside = beside[hashes.of(s[beside], length) == hashes.of(s[beside - 1], length)]
    span = np.arange(length)
    for at in range(0, len(beside), 20_000):
        part = beside[at : at + 20_000]
        # Equal hashes are verified on the bytes.
        equal[part] = (hashes.data[s[part][:, None] + span] == hashes.data[s[part - 1][:, None] + span]).all(axis=1)
    run = np.cumsum(~equal) - 1
    lowest = np.minimum.reduceat(rank[order], np.flatnonzero(~equal))
    marks[order] = rank[order] > lowest[run]
    return marks


def _classes(data: np.ndarray, powers: Powers, starts: np.ndarray, segment: np.ndarray, depth: int):
    """A function from a length up to ``depth`` to numbers that only suffixes of one segment with that much in common share."""
    hashes = PrefixHashes(np.append(data, np.zeros(depth, dtype=np.uint8)), powers)
    order = np.argsort(segment, kind="stable")
    order = order[suffix_order(hashes, starts[order], segment[order], depth)]
    common, span = np.full(len(order), -1, dtype=np.int64), np.arange(depth)
    beside = np.flatnonzero(segment[order[1:]] == segment[order[:-1]]) + 1
    for at in range(0, len(beside), 20_000):
        part = beside[at : at + 20_000]
        same = hashes.data[starts[order[part]][:, None] + span] == hashes.data[starts[order[part - 1]][:, None] + span]
        common[part] = np.where(same.all(axis=1), depth, same.argmin(axis=1))

    def of(length: int) -> np.ndarray:
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(common < length)
        return number

    return of


def repeated_around(data: np.ndarray, powers: Powers, place: np.ndarray, before: np.ndarray, n: np.ndarray, anchor: np.ndarray, rank: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Marks strings that also start, as far before the same anchor, around a place of lower rank.

    The ``n`` strings of a place of an anchor start ``before`` bytes ahead of it and
    at the bytes that follow; the marks are one place after the other.
    """
    first = np.cumsum(n) - n
    marks = np.zeros(int(n.sum()), dtype=bool)
    _, anchor, count = np.unique(anchor, return_inverse=True, return_counts=True)
    who = np.flatnonzero(count[anchor] > 1)  # a lone place repeats nothing
    who = who[np.argsort(rank[who], kind="stable")]
    place, before, n, anchor, first = (x[who] for x in (place, before, n, anchor, first))
    if not len(who):
        return marks
    right = _classes(data, powers, place, anchor, length)
    left = _classes(data[::-1], powers, len(data) - place, anchor, max(1, length - gram))
    for d in range(int((before - n).min()) + 1, int(before.max()) + 1):
        live = np.flatnonzero((before - n < d) & (d <= before))
        after, ahead = right(length - d)[live], left(d)[live]
        many = (np.bincount(after)[after] > 1) & (np.bincount(ahead)[ahead] > 1)
        live, after, ahead = live[many], after[many], ahead[many]
        _, lowest = np.unique(after * (len(who) + 1) + ahead, return_index=True)
        again = np.ones(len(live), dtype=bool)
        again[lowest] = False
        live = live[again]
        marks[first[live] + before[live] - d] = True
    return marks


def _covered(starts: np.ndarray, marks: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of the bytes under runs of neighbouring marked strings."""
    at = np.flatnonzero(marks)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (doc[at][1:] != doc[at][:-1]) | (starts[at][1:] != starts[at][:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[at[first]], starts[at[first]], starts[at[last]] + length


def _documents(ids: list, bodies: list[bytes], spans: list[list[dict]]) -> pa.RecordBatch:
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(bodies, pa.binary()), "spans": pa.array(spans, pa.list_(span))})


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """(doc_id, text binary, spans array<struct<from,to>>): each document and its repeated bytes, as disjoint ascending spans."""
    spark = docs.sparkSession
    texts = text_columns(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 16 * parts
    edges = (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)

    def block_anchors(bodies: list[bytes]):
        powers = Powers()
        for k, body in enumerate(bodies):
            if len(body) >= length:
                yield k, anchors(PrefixHashes(np.frombuffer(body, dtype=np.uint8), powers), length, gram)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, bodies in _blocks(batches, block_bytes):
            keys = [a[0] for _, a in block_anchors(bodies)]
            if not keys:
                continue
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            cuts = [0, *np.searchsorted(found, edges).tolist(), len(found)]
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    steps = np.diff(found[a:b], prepend=np.uint64(0))
                    yield _row(shard=s, key=block, body=_pack(steps, (counts[a:b] > 1).astype(np.int64)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard"):
            asked = [_unpack(r["body"]) for r in rows]
            keys = [np.cumsum(steps.view(np.uint64)) for steps, _ in asked]
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            for r, k, (_, often) in zip(rows, keys, asked, strict=True):
                yes = (often > 0) | (counts[np.searchsorted(found, k)] > 1)
                yield _row(key=r["key"], part=shard, body=np.packbits(yes).tobytes(), more=len(yes).to_bytes(8, "little"), docs=None)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, bodies in _blocks(batches, block_bytes):
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            yield _row(key=block, part=WHOLE, body=blob, more=_pack(np.array([len(b) for b in bodies])), docs=ids)

    def unpacked(row: dict) -> list[bytes]:
        (sizes,) = _unpack(row["more"])
        data, ends = zstandard.ZstdDecompressor().decompress(row["body"]), np.cumsum(sizes).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches, "key"):
            if rows[-1]["part"] != WHOLE:
                raise RuntimeError("a block changed between two readings; write the documents first")
            bodies, ids = unpacked(rows[-1]), rows[-1]["docs"]
            asked = {r["part"]: r for r in rows if r["part"] != WHOLE}  # blocks of equal content are answered alike
            flags = [np.unpackbits(np.frombuffer(r["body"], dtype=np.uint8), count=int.from_bytes(r["more"], "little")) for r in asked.values()]
            known = np.concatenate(flags).astype(bool) if flags else np.empty(0, dtype=bool)
            found = list(block_anchors(bodies))
            distinct = np.unique(np.concatenate([a[0] for _, a in found])) if found else np.empty(0, dtype=np.uint64)
            if len(distinct) != len(known):
                raise RuntimeError("a block changed between two readings; write the documents first")
            first, here, sent = {}, [], []
            place = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
            rank = {k: r for r, k in enumerate(place)}
            for k, (keys, at, lo, hi) in sorted(found, key=lambda f: rank[f[0]]):
                body = bodies[k]
                for i in np.flatnonzero(known[np.searchsorted(distinct, keys)]).tolist():
                    a, b = int(lo[i]), int(hi[i])
                    around = (body[a : b + length], int(at[i]) - a)
                    if around in first:
                        here.append((k, a, b + length))
                    else:
                        first[around] = True
                        sent.append((int(keys[i]), k, a, b, int(at[i]), around[0]))
            yield _row(shard=shards, key=block, part=0, body=_pack(*np.array(here, dtype=np.int64).reshape(-1, 3).T), more=None, docs=None)
            if not sent:
                continue
            keys = np.array([s[0] for s in sent], dtype=np.uint64)
            shard = np.searchsorted(edges, keys, side="right")
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                mine = [sent[i] for i in order[cuts[s] : cuts[s + 1]].tolist()]
                table = np.array([m[1:5] for m in mine], dtype=np.int64).T
                docs_of = np.array([ids[m[1]] if ids[m[1]] is not None else -(1 << 63) for m in mine], dtype=np.int64)
                body = _pack(np.array([m[0] for m in mine], dtype=np.uint64), docs_of, *table)
                yield _row(shard=s, key=block, part=1, body=body, more=zstandard.ZstdCompressor(level=3).compress(b"".join(m[5] for m in mine)), docs=None)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for shard, rows in _grouped(batches, "shard"):
            if shard == shards:  # repeats that a block has found by itself
                for r in rows:
                    yield _row(key=r["key"], part=shard, body=r["body"], more=None, docs=None)
                continue
            tables = [_unpack(r["body"]) for r in rows]
            keys, doc_ids, k, lo, hi, at = (np.concatenate(c) for c in zip(*tables, strict=True))
            owner = np.repeat(np.arange(len(rows)), [len(t[0]) for t in tables])
            block = np.array([r["key"] for r in rows], dtype=np.int64)[owner]
            data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["more"]) for r in rows), dtype=np.uint8)
            width = hi - lo + length
            base = np.cumsum(width) - width
            n = hi - lo + 1
            # One row per string start: its instance and its place there.
            inst = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(inst)) - np.repeat(np.cumsum(n) - n, n)
            rank = np.empty(len(n), dtype=np.int64)
            rank[np.lexsort((at, k, block, doc_ids))] = np.arange(len(n))
            marks = repeated_around(data, powers, base + at - lo, at - lo, n, keys, rank, length, gram)
            starts, ends = lo[inst] + step, np.searchsorted(owner[inst], np.arange(len(rows) + 1))
            for r in range(len(rows)):
                mine = slice(ends[r], ends[r + 1])
                yield _spans_row(rows[r]["key"], shard, starts[mine], marks[mine], inst[mine], k)

    def _spans_row(key: int, shard: int, starts: np.ndarray, marks: np.ndarray, inst: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        who, begin, end = _covered(starts, marks, inst, length)
        return _row(key=key, part=shard, body=_pack(k[who] if len(who) else who, begin, end), more=None, docs=None)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "key"):
            bodies, ids = unpacked(rows[-1]), rows[-1]["docs"]
            spans = [_unpack(r["body"]) for r in rows if r["part"] != WHOLE]
            copies = sum(r["part"] == WHOLE for r in rows)
            doc, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True)) if spans else [np.empty(0, dtype=np.int64)] * 3
            order = np.lexsort((begin, doc))
            doc, begin, end = doc[order], begin[order], end[order]
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            for at in range(0, len(ids), 256):
                out = []
                for d in range(at, min(at + 256, len(ids))):
                    merged: list[dict] = []
                    for a, b in zip(begin[cuts[d] : cuts[d + 1]].tolist(), end[cuts[d] : cuts[d + 1]].tolist(), strict=True):
                        if merged and a <= merged[-1]["to"]:
                            merged[-1]["to"] = max(merged[-1]["to"], b)
                        else:
                            merged.append({"from": a, "to": b})
                    out.append(merged)
                yield _documents(ids[at : at + 256], bodies[at : at + 256], out)
            # A further block of the same content repeats the first one throughout.
            for _ in range(copies - 1):
                for at in range(0, len(ids), 256):
                    part = bodies[at : at + 256]
                    yield _documents(ids[at : at + 256], part, [[{"from": 0, "to": len(b)}] if len(b) >= length else [] for b in part])

    schema = "key long, part int, body binary, more binary, docs array<long>"
    asked = texts.mapInArrow(ask, "shard int, key long, body binary").repartition(parts, "shard").sortWithinPartitions("shard", "key")
    answers = asked.mapInArrow(answer, schema)
    blocks = texts.mapInArrow(whole, schema)
    around = answers.unionByName(blocks).repartition(parts, "key").sortWithinPartitions("key", "part").mapInArrow(surroundings, "shard int, " + schema)
    judged = around.repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(judge, schema)
    together = judged.unionByName(blocks).repartition(parts, "key").sortWithinPartitions("key", "part")
    return together.mapInArrow(apply, "doc_id long, text binary, spans array<struct<from:long,to:long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, count, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                body, at, rest = text.as_py(), 0, hashlib.sha256()
                for s in spans:
                    rest.update(body[at : s["from"]])
                    at = s["to"]
                rest.update(body[at:])
                size.append(len(body))
                gone.append(sum(s["to"] - s["from"] for s in spans))
                count.append(len(spans))
                kept.append(rest.hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(kept)})

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
