"""Language-model scores from Elias-Fano n-gram tries.

Tokens are blank-separated words, A-Z lower-cased, and one end per document. The
model learns from documents whose crc32(doc_id as text) mod 7 is not 2; rows
without an id count as held out. With training counts ``c``, ``N`` tokens and ``V`` distinct tokens

    base    p(w)     = (c(w) + 1) / (N + V + 1)
    model   p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU)

which sums to the same mass as the base for every context.

1. Tasks cut documents into blocks and ask, packed by ranges of the word hash, for
   the corpus counts of their distinct words; asking brings their own training counts.
2. Blocks then ask for their distinct word pairs, packed by the context's shard.
   A context that holds more than a shard's share of all tokens is spread over
   several shards by its successor, so no context meets in one task.
3. A shard builds a trie from all training pairs it was sent: the sorted contexts, Elias-Fano
   pointers to each context's successors, and the successors as one Elias-Fano
   sequence, monotone because each is taken relative to its context. Every pair holds
   its smoothed share ``c(v w) / (c(v) + MU)``, quantised to two bytes: steps of
   ``STEP`` in its log10, the same for all shards, so scores don't depend on how
   many there are. The trie is one byte string whose levels are read in place, as from a mapped file. Queries
   find the context, and then the successor in that context's stretch.
4. Blocks turn the answers into scores.

Words are known by 64-bit hashes, successors within a context by 40 bits of
theirs. Null or empty texts are a single end. Repeated rows are learned and given
once per row. Without training rows all counts are 0. Blocks are read more than
once; one that differs between readings fails the job. Other columns are not
carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import blank_words, mix, text_columns, without_cycles
from periodica.session import cut_lineage

MU = 8.0
BLOCK_BYTES = 8 << 20
ID_BITS = 40
#: Step of a share's log10 and the number of steps, which reach a share of 10**-16.
STEP, STEPS = 1 / 4096, 65535
#: Names of the pseudo-words; no blank-separated word holds a blank.
START, END = b" start", b" end"
WHOLE = 1 << 30


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


START_HASH = _word_hash(START)


def learns_from(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


class EliasFano:
    """Monotone sequence of unsigned numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) if n else 0) // 64 + 2
        bits = np.zeros(size * 64, dtype=np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros((n * low_bits + 63) // 64 + 2, dtype="<u8")
        if low_bits:
            kept = values & np.uint64((1 << low_bits) - 1)
            where = np.arange(n, dtype=np.int64) * low_bits
            word, shift = where >> 6, (where & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, kept << shift)
            over = shift > np.uint64(64 - low_bits)
            np.bitwise_or.at(low, word[over] + 1, kept[over] >> (np.uint64(64) - shift[over]))
        return cls(n, low_bits, low, high)

    def _select(self, counts: np.ndarray, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th (from 0) set bit of ``words`` with running ``counts``."""
        out = np.empty(len(k), dtype=np.int64)
        for a in range(0, len(k), 50_000):
            part = k[a : a + 50_000]
            word = np.searchsorted(counts, part, side="right") - 1
            bits = np.unpackbits(np.ascontiguousarray(words[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = (np.cumsum(bits, axis=1, dtype=np.uint8) <= (part - counts[word])[:, None]).sum(axis=1)
            out[a : a + 50_000] = word * 64 + inside
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(self.ones, self.high, i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        where = i * self.low_bits
        word, shift = where >> 6, (where & 63).astype(np.uint64)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below each ``x`` (``n`` where there is none)."""
        return self.find(x)[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor's index of each ``x``, and whether the successor is ``x`` itself."""
        bucket = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1])
        edge = np.clip(np.concatenate([bucket - 1, bucket]), 0, last - 1)
        found = self._select(self.zeros, ~self.high, edge) - edge
        begin, end = np.where(bucket > 0, found[: len(x)], 0), found[len(x) :]
        begin = np.where(bucket > last, self.n, begin)
        end = np.where(bucket >= last, self.n, end)
        low, stop = x & np.uint64((1 << self.low_bits) - 1), end.copy()
        while True:
            live = np.flatnonzero(begin < end)
            if not len(live):
                # Below ``stop`` the high bits are those of ``x``.
                same = begin < stop
                same[same] = self._low(begin[same]) == low[same]
                return begin, same
            mid = (begin[live] + end[live]) >> 1
            below = self._low(mid) < low[live]
            begin[live], end[live] = np.where(below, mid + 1, begin[live]), np.where(below, end[live], mid)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, lows, highs = np.frombuffer(data, dtype="<i8", count=4, offset=at).tolist()
        low = np.frombuffer(data, dtype="<u8", count=lows, offset=at + 32)
        high = np.frombuffer(data, dtype="<u8", count=highs, offset=at + 32 + 8 * lows)
        return cls(n, low_bits, low, high), at + 32 + 8 * (lows + highs)


def trie_bytes(contexts: np.ndarray, counts: np.ndarray, owner: np.ndarray, ids: np.ndarray, pairs: np.ndarray, mu: float) -> bytes:
    """Serialised trie of sorted ``contexts`` with corpus ``counts`` and their sorted (owner, id) successors with counts ``pairs``."""
    pointers = np.searchsorted(owner, np.arange(len(contexts) + 1)).astype(np.uint64)
    share = np.log10(pairs / (counts[owner] + mu))
    codes = (1 + np.minimum(np.rint(-share / STEP), STEPS - 1)).astype("<u2")
    head = np.array([len(contexts), len(codes)], dtype="<i8").tobytes()
    relative = (owner.astype(np.uint64) << np.uint64(ID_BITS)) | ids
    return head + contexts.astype("<u8").tobytes() + EliasFano.build(pointers).to_bytes() + EliasFano.build(relative).to_bytes() + codes.tobytes()


class Trie:
    """Levels of a serialised trie, read in place."""

    def __init__(self, data: bytes):
        n, codes = np.frombuffer(data, dtype="<i8", count=2).tolist()
        self.contexts = np.frombuffer(data, dtype="<u8", count=n, offset=16)
        self.pointers, at = EliasFano.read(data, 16 + 8 * n)
        self.successors, at = EliasFano.read(data, at)
        self.codes = np.frombuffer(data, dtype="<u2", count=codes, offset=at)

    def lookup(self, contexts: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Code of each pair (contexts[owner], id), 0 where training has none."""
        out = np.zeros(len(ids), dtype=np.uint16)
        if not len(self.contexts) or not len(ids):
            return out
        node = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        known = self.contexts[node] == contexts
        begin, end = self.pointers.get(node), self.pointers.get(node + 1)
        ask = np.flatnonzero(known[owner])
        want = (node[owner[ask]].astype(np.uint64) << np.uint64(ID_BITS)) | ids[ask]
        at, same = self.successors.find(want)
        same &= (at >= begin[owner[ask]].astype(np.int64)) & (at < end[owner[ask]].astype(np.int64))
        out[ask[same]] = self.codes[at[same]]
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane, compressed."""
    out = bytearray()
    for a in arrays:
        raw = np.ascontiguousarray(a.astype(np.uint64) if a.dtype != np.float64 else a)
        out += len(a).to_bytes(8, "little") + np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
        at += 8 + 8 * n
    return out


class Block:
    """Token codes of some documents; code 0 is the start, code 1 the end, others in order of first use."""

    def __init__(self, docs: list, sizes: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
        self.docs, self.sizes, self.codes, self.hashes = docs, sizes.astype(np.int64), codes.astype(np.int64), hashes
        self.learned = np.repeat(np.array([learns_from(d) for d in docs], dtype=bool), self.sizes)
        self.order = np.argsort(hashes)

    def training_counts(self) -> np.ndarray:
        counts = np.bincount(self.codes[self.learned], minlength=len(self.hashes))
        counts[0] = sum(learns_from(d) for d in self.docs)
        return counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) codes, their training counts, and the pair of each token."""
        before = np.concatenate([[0], self.codes[:-1]])
        before[np.cumsum(self.sizes) - self.sizes] = 0
        keys = before * len(self.hashes) + self.codes
        found, which = np.unique(keys, return_inverse=True)
        return found // len(self.hashes), found % len(self.hashes), np.bincount(which[self.learned], minlength=len(found)), which

    def key(self) -> int:
        seen = xxhash.xxh3_64(repr(self.docs))
        for a in (self.sizes, self.codes, self.hashes):
            seen.update(np.ascontiguousarray(a).tobytes())
        return int(np.uint64(seen.intdigest()).astype(np.int64))

    def whole(self) -> pa.RecordBatch:
        return _row(key=self.key(), part=WHOLE, body=_pack(self.sizes, self.codes, self.hashes), docs=self.docs)

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(row["docs"], *_unpack(row["body"]))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    def closed() -> Block:
        return Block(docs, np.array([len(p) for p in parts]), np.concatenate(parts), np.array([_word_hash(w) for w in codes], dtype=np.uint64))

    docs, parts, codes, size = [], [], {START: 0, END: 1}, 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = blank_words(text.as_py())
            docs.append(doc)
            parts.append(np.array([codes.setdefault(w, len(codes)) for w in words] + [1], dtype=np.int64))
            size += len(text.as_py() or "")
            if size >= block_bytes:
                yield closed()
                docs, parts, codes, size = [], [], {START: 0, END: 1}, 0
    if docs:
        yield closed()


def _row(**columns) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "shard": pa.int32(), "part": pa.int32(), "body": pa.binary(), "docs": pa.list_(pa.int64()), "n": pa.int64(), "v": pa.int64()}
    return pa.record_batch({k: pa.array([v], kinds[k]) for k, v in columns.items()})


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != at:
                yield rows
                rows = []
            at = row[column]
            rows.append(row)
    if rows:
        yield rows


def scores(docs: DataFrame, mu: float = MU, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    texts = text_columns(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 4 * parts
    edges = (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_bytes):
            key, counts = block.key(), block.training_counts()[block.order]
            hashes = block.hashes[block.order]
            cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    yield _row(shard=s, key=key, body=_pack(np.diff(hashes[a:b], prepend=np.uint64(0)), counts[a:b]))

    def answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "shard"):
            asked = [_unpack(r["body"]) for r in rows]
            hashes = [np.cumsum(a[0]) for a in asked]
            found, which = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(found)).astype(np.int64)
            word = found != np.uint64(START_HASH)
            n, v = int(total[word].sum()), int((total[word] > 0).sum())
            for r, h in zip(rows, hashes, strict=True):
                yield _row(key=r["key"], part=r["shard"], body=_pack(total[np.searchsorted(found, h)]), docs=None, n=n, v=v)
                n = v = 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_bytes):
            yield block.whole()

    def counted(rows: list[dict]) -> tuple[Block, np.ndarray, int]:
        """The block of a group of rows, the corpus counts of its codes, and its copies."""
        if rows[-1]["part"] != WHOLE:
            raise RuntimeError("a block changed between two readings; write the documents first")
        block = Block.of(rows[-1])
        answers = {r["part"]: r for r in rows if r["part"] < shards}  # blocks of equal content are answered alike
        found = np.concatenate([_unpack(answers[p]["body"])[0] for p in sorted(answers)]).astype(np.int64)
        if len(found) != len(block.hashes):
            raise RuntimeError("a block changed between two readings; write the documents first")
        counts = np.empty(len(found), dtype=np.int64)
        counts[block.order] = found
        return block, counts, sum(r["part"] == WHOLE for r in rows)

    def dealt(block: Block, counts: np.ndarray, n_all: int):
        """Distinct pairs in the order in which they are asked, with their shard and successor id."""
        v, w, learned, which = block.pairs()
        spread = 1 + counts[v] * shards // max(n_all, 1)
        ids = block.hashes[w] >> np.uint64(64 - ID_BITS)
        shard = (np.searchsorted(edges, mix(block.hashes[v]), side="right") + (mix(ids) % spread.astype(np.uint64)).astype(np.int64)) % shards
        order = np.lexsort((ids, block.hashes[v], shard))
        return v[order], ids[order], learned[order], shard[order], order, which

    def ask_pairs(n_all: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _grouped(batches, "key"):
                block, counts, copies = counted(rows)
                v, ids, learned, shard, _, _ = dealt(block, counts, n_all)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = slice(cuts[s], cuts[s + 1])
                    first = np.flatnonzero(np.concatenate([[True], v[mine][1:] != v[mine][:-1]]))
                    size = np.diff(np.append(first, cuts[s + 1] - cuts[s]))
                    c = v[mine][first]
                    yield _row(shard=s, key=rows[0]["key"], body=_pack(block.hashes[c], counts[c], size, ids[mine], learned[mine] * copies))
        return run

    def answer_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "shard"):
            asked = [_unpack(r["body"]) for r in rows]
            context = np.concatenate([np.repeat(a[0], a[2].astype(np.int64)) for a in asked])
            count = np.concatenate([np.repeat(a[1], a[2].astype(np.int64)) for a in asked]).astype(np.int64)
            ids, learned = (np.concatenate([a[k] for a in asked]) for k in (3, 4))
            seen = np.flatnonzero(learned > 0)
            seen = seen[np.lexsort((ids[seen], context[seen]))]
            context, count, ids, learned = context[seen], count[seen], ids[seen], learned[seen].astype(np.int64)
            new = np.concatenate([[True], (context[1:] != context[:-1]) | (ids[1:] != ids[:-1])]) if len(seen) else np.empty(0, dtype=bool)
            first = np.flatnonzero(new)
            pairs = np.add.reduceat(learned, first) if len(first) else first
            contexts, at, owner = np.unique(context[first], return_index=True, return_inverse=True)
            trie = Trie(trie_bytes(contexts, count[first][at], owner, ids[first], pairs, mu))
            for r, a in zip(rows, asked, strict=True):
                codes = trie.lookup(a[0], np.repeat(np.arange(len(a[0])), a[2].astype(np.int64)), a[3])
                yield _row(key=r["key"], part=shards + r["shard"], body=_pack(codes), docs=None)

    def score(n_all: int, v_all: int):
        shares = np.concatenate([[0.0], 10.0 ** (-STEP * np.arange(STEPS))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _grouped(batches, "key"):
                block, counts, copies = counted(rows)
                v, ids, _, shard, order, which = dealt(block, counts, n_all)
                answers = {r["part"]: r for r in rows if shards <= r["part"] < WHOLE}
                held = []
                for p in sorted(answers):
                    held.append(shares[_unpack(answers[p]["body"])[0].astype(np.int64)])
                if sum(map(len, held)) != len(v):
                    raise RuntimeError("a block changed between two readings; write the documents first")
                share = np.empty(len(v))
                share[order] = np.concatenate(held)
                context, word, _, _ = block.pairs()
                base = (counts + 1.0) / (n_all + v_all + 1.0)
                model = np.log10(share + mu / (counts[context] + mu) * base[word])
                first = np.cumsum(block.sizes) - block.sizes
                known = np.add.reduceat((counts[block.codes] > 0).astype(np.int64), first)
                plain = np.add.reduceat(np.log10(base)[block.codes], first)
                full = np.add.reduceat(model[which], first)
                for _ in range(copies):
                    yield pa.record_batch({
                        "doc_id": pa.array(block.docs, pa.int64()), "held_out": pa.array([not learns_from(d) for d in block.docs]), "n_tokens": pa.array(block.sizes, pa.int64()),
                        "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_all] * len(first), pa.int64()), "base_score": pa.array(plain), "score": pa.array(full),
                    })
        return run

    schema = "key long, part int, body binary, docs array<long>"
    asked = texts.mapInArrow(without_cycles(ask_words), "shard int, key long, body binary").repartition(parts, "shard").sortWithinPartitions("shard", "key")
    words = cut_lineage(asked.mapInArrow(answer_words, schema + ", n long, v long"), "word-counts")
    total = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"] or 0)
    blocks = words.drop("n", "v").unionByName(texts.mapInArrow(without_cycles(whole), schema))
    pairs = blocks.repartition(parts, "key").sortWithinPartitions("key", "part").mapInArrow(ask_pairs(n_all), "shard int, key long, body binary")
    told = pairs.repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(answer_pairs, schema)
    together = told.unionByName(blocks).repartition(parts, "key").sortWithinPartitions("key", "part")
    return together.mapInArrow(score(n_all, v_all), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
