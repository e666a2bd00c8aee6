"""Byte-level BPE by a global shuffle of distinct words, and decoding by a token-byte table.

1. Each task cuts its documents into blocks of bounded text and splits them into
   pre-tokens (the matches of the pattern). A block lists its distinct
   pre-tokens, dealt by a hash of the word over shards, one packed row per
   (block, shard).
2. A shard encodes each distinct word once, whichever blocks ask for it, and
   answers each block in the order in which it asked.
3. Blocks meet their answers by the block's key, a hash of its content, and the
   ids are put back by position.

The blocks are read twice, once for the words and once for the positions; a
block that comes out differently in the second reading finds no answers and the
job fails instead of giving wrong ids. Inputs whose rows come in another order at
each reading must be written first.

Null or empty texts have no ids and decode to an empty string. Rows are kept as
they come: repeated rows and null ids each give a row. Other columns are not
carried. A text of any length is one block at most, never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from periodica.llm.common import returns_memory, text_columns

#: UTF-8 bytes after which a block is closed.
BLOCK_BYTES = 8 << 20
#: Largest vocabulary file that is broadcast; those of byte-level tokenizers hold a few MB.
MOST_VOCABULARY_BYTES = 64 << 20

SPACE_THEN_BLANK = re.compile(r"\s ")
#: White space of ASCII before a blank, as ``re`` sees it.
ASCII_PAIRS = [bytes([c, 0x20]) for c in (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))]
WORD_END = re.compile(r"(?<=\S)(?= )")


def read_vocabulary(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes is too large to broadcast")
    return data


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Splitter:
    """Pre-tokens of texts as codes of one block's dictionary, in order of first use.

    A pre-token never reaches over a blank that follows a character other than
    white space, so texts are cut there first and each distinct piece is matched
    against the pattern once.
    """

    def __init__(self, pattern):
        self.pattern, self.codes = pattern, {}
        # The pieces don't point back here: in a cycle they would outlive their block until the collector's next long search.
        self.first, self.later = _Pieces(pattern, self.codes, ""), _Pieces(pattern, self.codes, " ")

    def split(self, text: str) -> np.ndarray:
        body = text.encode()
        doubled = any(pair in body for pair in ASCII_PAIRS) or (not text.isascii() and SPACE_THEN_BLANK.search(text))
        if doubled:
            return np.frombuffer(b"".join([self.first[p.encode()] for p in WORD_END.split(text)]), dtype="<u4")
        head, *rest = body.split(b" ")
        return np.frombuffer(self.first[head] + b"".join(map(self.later.__getitem__, rest)), dtype="<u4")


class _Pieces(dict):
    def __init__(self, pattern, codes: dict[bytes, int], lead: str):
        super().__init__()
        self.pattern, self.codes, self.lead, self.mark = pattern, codes, lead, lead.encode()

    def __missing__(self, piece: bytes) -> bytes:
        codes = self.codes
        if piece.isalpha():  # ASCII letters only: one match
            value = codes.setdefault(self.mark + piece, len(codes)).to_bytes(4, "little")
        else:
            found = self.pattern.findall(self.lead + piece.decode())
            value = b"".join([codes.setdefault(m.encode(), len(codes)).to_bytes(4, "little") for m in found])
        self[piece] = value
        return value


def _blocks(batches: Iterator[pa.RecordBatch], pattern_text: str, block_bytes: int):
    """(key, ids, counts, codes, words) of each block of a task's documents."""
    import regex

    pattern = regex.compile(pattern_text)
    state = None
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if state is None:
                state = (xxhash.xxh3_64(), Splitter(pattern), [], [], [0])
            seen, splitter, docs, parts, size = state
            text = text.as_py() or ""
            seen.update(f"{doc}:{len(text)}:")
            seen.update(text)
            docs.append(doc)
            parts.append(splitter.split(text))
            size[0] += len(text)
            if size[0] >= block_bytes:
                block = _closed(*state)
                state = seen = splitter = docs = parts = None
                yield block
    if state is not None:
        yield _closed(*state)


def _closed(seen, splitter, docs, parts, size):
    key = int(np.uint64(seen.intdigest()).astype(np.int64))
    return key, docs, np.array([len(p) for p in parts], dtype="<u4"), np.concatenate(parts), list(splitter.codes)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte plane by byte plane, compressed."""
    out = bytearray()
    for a in arrays:
        body = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        out += len(a).to_bytes(8, "little") + body
    return zstandard.ZstdCompressor(level=3).compress(bytes(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(data, dtype=np.uint8, count=4 * n, offset=at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + 4 * n
    return out


def _shards_of(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), dtype=np.uint32, count=len(words))


def encode(docs: DataFrame, vocabulary: str, pattern: str, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``."""
    spark = docs.sparkSession
    texts = text_columns(docs)
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 4 * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, _, words in _blocks(batches, pattern, block_bytes):
            shard = _shards_of(words, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            compress = zstandard.ZstdCompressor(level=3).compress
            lengths = np.array([len(w) for w in words], dtype=np.uint32)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[s] : edges[s + 1]]
                yield pa.record_batch({
                    "shard": pa.array([s], pa.int32()), "key": pa.array([key], pa.int64()),
                    "lengths": pa.array([_pack(lengths[mine])], pa.binary()), "words": pa.array([compress(b"".join([words[i] for i in mine.tolist()]))], pa.binary()),
                })

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_of(data.value), special_tokens={})._core_bpe
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                (lengths,) = _unpack(row["lengths"])
                text = zstandard.ZstdDecompressor().decompress(row["words"])
                ends = np.cumsum(lengths).tolist()
                ids = []
                for start, end in zip([0, *ends[:-1]], ends, strict=True):
                    word = text[start:end]
                    if word not in known:
                        known[word] = np.array(core.encode_single_piece(word), dtype="<u4")
                    ids.append(known[word])
                yield pa.record_batch({
                    "key": pa.array([row["key"]], pa.int64()), "part": pa.array([row["shard"]], pa.int32()),
                    "body": pa.array([_pack(np.array([len(i) for i in ids]), np.concatenate(ids))], pa.binary()), "docs": pa.array([None], pa.list_(pa.int64())),
                })

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, counts, codes, words in _blocks(batches, pattern, block_bytes):
            yield pa.record_batch({
                "key": pa.array([key], pa.int64()), "part": pa.array([shards], pa.int32()),
                "body": pa.array([_pack(counts, codes, _shards_of(words, shards))], pa.binary()), "docs": pa.array([ids], pa.list_(pa.int64())),
            })

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lengths, ids = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != at:
                    at, lengths, ids, last = row["key"], [], [], -1
                if row["part"] < shards:
                    if row["part"] != last:  # blocks of the same content ask and are answered alike
                        a, b = _unpack(row["body"])
                        lengths.append(a)
                        ids.append(b)
                    last = row["part"]
                else:
                    yield from _block_rows(row, lengths, ids)

    def _block_rows(row: dict, lengths: list, ids: list) -> Iterator[pa.RecordBatch]:
        counts, codes, shard = _unpack(row["body"])
        size, flat = (np.concatenate(x) if x else np.empty(0, dtype=np.uint32) for x in (lengths, ids))
        if len(size) != len(shard):
            raise RuntimeError("a block changed between two readings; write the documents first")
        start = np.cumsum(size.astype(np.int64)) - size
        by_code = np.empty(len(shard), dtype=np.int64)
        by_code[np.argsort(shard, kind="stable")] = np.arange(len(shard))
        ends = np.cumsum(counts.astype(np.int64))
        for a in range(0, len(counts), 256):
            b = min(a + 256, len(counts))
            slots = by_code[codes[(ends[a - 1] if a else 0) : ends[b - 1]]]
            n = size[slots].astype(np.int64)
            out_ends = np.cumsum(n)
            # Each slot's ids stand in a run of the flat array.
            at = np.repeat(start[slots] - (out_ends - n), n) + np.arange(int(out_ends[-1]) if len(n) else 0)
            doc_ends = np.concatenate([[0], out_ends])[ends[a:b] - (ends[a - 1] if a else 0)]
            offsets = np.concatenate([[0], doc_ends]).astype(np.int32)
            yield pa.record_batch({
                "doc_id": pa.array(row["docs"][a:b], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at].astype(np.int32))),
            })

    asked = texts.mapInArrow(returns_memory(ask), "shard int, key long, lengths binary, words binary").repartition(parts, "shard")
    schema = "key long, part int, body binary, docs array<long>"
    answers = asked.mapInArrow(returns_memory(answer), schema)
    blocks = answers.unionByName(texts.mapInArrow(returns_memory(places), schema))
    return blocks.repartition(parts, "key").sortWithinPartitions("key", "part").mapInArrow(returns_memory(assemble), "doc_id long, ids array<int>")


def token_table(data: bytes) -> list[bytes]:
    ranks = ranks_of(data)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _joined(table: pa.Array, flat: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Bytes of the rows of ``table`` that ``flat`` names, end to end, and the offsets."""
    rows = table.take(pa.array(flat))
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[: len(flat) + 1]
    return memoryview(rows.buffers()[2] or b""), offsets


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded binary): ids joined with the broadcast token-byte table."""
    data = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_table(data.value), pa.large_binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("ids").fill_null([])
                lengths = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
                body, offsets = _joined(table, ids.flatten().to_numpy())
                ends = offsets[np.cumsum(lengths)]
                texts = [bytes(body[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": ids, "decoded": pa.array(texts, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(returns_memory(run), "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decoded rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown_ids = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("ids")
                flat = ids.flatten().to_numpy()
                top = int(flat.max()) + 1 if len(flat) else 0
                if shown_ids is None or len(shown_ids) < top:
                    shown_ids = pa.array([b"%d " % i for i in range(max(top, 1))], pa.large_binary())
                body, offsets = _joined(shown_ids, flat)
                n = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
                ends = np.cumsum(n)
                # The last id of a row is shown without its blank.
                named = [hashlib.sha256(body[offsets[e - k] : offsets[e] - 1] if k else b"").hexdigest() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                shown = [hashlib.sha256(d.as_buffer()).hexdigest() for d in batch.column("decoded")]
                out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": pa.array(named, pa.string()), "decoded_sha256": pa.array(shown, pa.string())}
                if keep_ids:
                    out["ids"] = ids
                yield pa.record_batch(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return decoded.mapInArrow(returns_memory(run), schema)
