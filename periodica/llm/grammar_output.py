"""Token ids in grammar-compressed shards (Re-Pair), written in id order and read back.

Documents are ranged by ascending doc_id (rows without an id first, equal ids by
text), encoded, closed with an end id, and packed into shards of bounded length.
In a shard, frequent neighbouring symbols are replaced by nonterminals, in passes
of pairs that cannot overlap, until no pair is frequent or the symbols of two
bytes are used up. A shard is one record of a Spark table (a record survives a lost
executor as any other row does):

    part, seq      place of the shard in the whole, ascending with doc_id
    n_docs, n_tokens
    body           b"RPG1", five counts, then the arrays
                   left, right   symbols of each rule
                   size          expansion length of each rule
                   sequence      start string
                   ends          token end of each document
                   ids, known    doc_id of each document, and whether it has one

Expansion lengths make any token range readable without expanding the rest.

Null or empty texts are a single end id. Repeated rows are written once per row.
No rows give no shards. Other columns are not carried.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from periodica.llm.common import text_columns, without_cycles
from periodica.session import shared_dir

MAGIC = b"RPG1"
#: Tokens after which a shard is closed; a longer document is one shard.
SHARD_TOKENS = 1 << 20
#: A pair is replaced where it stands this often at least.
LEAST_COUNT = 6
SYMBOLS = 1 << 16
#: Expansions of this length or less are looked up when a shard is read.
SHORT = 32
MOST_TOKENIZER_BYTES = 64 << 20


#: Letters below U+0180 whose lower case stands alone.
LETTER = "A-Za-zÀ-ÖØ-öø-įıĲ-ſ"
#: Such letters, then the end or an ASCII character that is no letter.
WORD = re.compile(rf"([{LETTER}]+)(?:$|(?=[\x00-\x40\x5b-\x60\x7b-\x7f]))")
#: A text of such letters and ASCII alone, and in its lower case the matches of the tokenizer's pattern.
PLAIN = re.compile(rf"[\x00-\x7f{LETTER}]*")
MATCH = re.compile(rf"[{LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\x09-\x0d\x20{LETTER}0-9]+")


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: themselves, or the next free letters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class MatchIds(dict):
    """Ids of matches in plain text as bytes, found through ``pieces``; forgets all when full."""

    def __init__(self, pieces: PieceIds):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, match: str) -> bytes:
        if len(self) >= self.pieces.most:
            self.clear()
        value = self[match] = self.pieces.model_ids(match) if match.isalpha() else self.pieces.library_ids(match)
        return value


class PieceIds(dict):
    """Ids of blank-separated pieces as bytes; forgets all when full.

    A plain text without the mark of a special token is cut into matches of the
    tokenizer's pattern at once. Other texts are cut at blanks first.

    A piece is encoded by the library. One that starts with a plain word, as most
    do, takes the word and the rest apart, since the tokenizer's pattern ends a
    match there; the library's model then encodes the word alone.
    """

    def __init__(self, tokenizer, most: int = 300_000):
        super().__init__()
        self.tokenizer, self.most, self.model = tokenizer, most, tokenizer.model
        self.letters, self.words, self.rests = byte_letters(), {}, {}
        self.ids = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.matches, self.marks = MatchIds(self), [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if piece.isalpha():
            value = self[piece] = self._word(piece.lower().decode())
            return value
        text = piece.decode()
        found = WORD.match(text)
        if found:
            end = found.end()
            value = self._word(text[:end].lower())
            if end < len(text):
                value += self._rest(text[end:])
        else:
            value = self.library_ids(text)
        self[piece] = value
        return value

    def _word(self, word: str) -> bytes:
        value = self.words.get(word)
        if value is None:
            if len(self.words) >= self.most:
                self.words.clear()
            value = self.words[word] = self.model_ids(word)
        return value

    def _rest(self, rest: str) -> bytes:
        value = self.rests.get(rest)
        if value is None:
            if len(self.rests) >= self.most:
                self.rests.clear()
            value = self.rests[rest] = self.library_ids(rest)
        return value

    def model_ids(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.ids[t.id] for t in self.model.tokenize(shown)])

    def library_ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: str) -> np.ndarray:
        if (text.isascii() or PLAIN.fullmatch(text)) and not any(mark in text for mark in self.marks):
            found = map(self.matches.__getitem__, MATCH.findall(text.lower()))
        else:
            found = map(self.__getitem__, text.encode().split())
        return np.frombuffer(b"".join(found), dtype="<u4")


def _places(seq: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted pairs ``wanted`` stand in ``seq``, and which pair each is."""
    left, lefts = np.unique(wanted >> np.uint32(16), return_inverse=True)
    right, rights = np.unique(wanted & np.uint32(0xFFFF), return_inverse=True)
    if len(left) * len(right) > 1 << 22:  # too wide for a table: search
        slot = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        at = np.flatnonzero(wanted[slot] == keys)
        return at, slot[at]
    table = np.full((len(left) + 1, len(right) + 1), -1, dtype=np.int32)
    table[lefts + 1, rights + 1] = np.arange(len(wanted))
    row, column = np.zeros(SYMBOLS, dtype=np.int32), np.zeros(SYMBOLS, dtype=np.int32)
    row[left], column[right] = np.arange(1, len(left) + 1) * (len(right) + 1), np.arange(1, len(right) + 1)
    found = table.ravel()[row[seq[:-1]] + column[seq[1:]]]
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def compress(ids: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right, expansion length) and start string of a shard's ids.

    Symbol ``first_free + r`` stands for rule ``r``. A pass takes the most frequent
    pairs whose symbols keep one side, left or right, so that no two places
    overlap; a pair of equal symbols is taken at every other place of a run.
    """
    seq = ids.astype(np.uint32)
    lefts, rights, free = [], [], first_free
    while len(seq) > 1 and free < SYMBOLS:
        keys = (seq[:-1] << np.uint32(16)) | seq[1:]
        # In sorted keys a frequent one equals the key that stands LEAST_COUNT - 1 places on.
        ranked = np.sort(keys)
        found = ranked[LEAST_COUNT - 1 :]
        found = found[ranked[: len(found)] == found]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, dtype=np.int64)
        found, counts = found[first], np.diff(np.append(first, len(found)))
        often = np.argsort(-counts, kind="stable")[: SYMBOLS - free]
        side: dict[int, str] = {}
        chosen = []
        for key in found[often].tolist():
            a, b = key >> 16, key & 0xFFFF
            if a == b:
                if a not in side:
                    side[a] = "both"
                    chosen.append(key)
            elif side.get(a, "left") == "left" and side.get(b, "right") == "right":
                side[a], side[b] = "left", "right"
                chosen.append(key)
        if not chosen:
            break
        wanted = np.array(sorted(chosen), dtype=np.uint32)
        number = np.arange(free, free + len(wanted), dtype=np.uint32)
        lefts.append(wanted >> np.uint32(16))
        rights.append(wanted & np.uint32(0xFFFF))
        free += len(wanted)
        at, slot = _places(seq, keys, wanted)
        twin = seq[at] == seq[at + 1]
        if twin.any():
            # All places of a pair of equal symbols are here, so a run of them is a stretch of neighbouring places.
            same = at[twin]
            run = np.maximum.accumulate(np.where(np.diff(same, prepend=-2) != 1, same, 0))
            twin[twin] = (same - run) % 2 == 1
            at, slot = at[~twin], slot[~twin]
        seq = seq.copy()
        seq[at] = number[slot]
        rest = np.ones(len(seq), dtype=bool)
        rest[at + 1] = False
        seq = seq[rest]
    left, right = (np.concatenate(x) if x else np.empty(0, dtype=np.uint32) for x in (lefts, rights))
    size = np.ones(first_free + len(left), dtype=np.uint32)
    done = first_free
    for part in lefts:
        span = slice(done - first_free, done - first_free + len(part))
        size[done : done + len(part)] = size[left[span]] + size[right[span]]
        done += len(part)
    return left, right, size[first_free:], seq


def pack(ids: list[int | None], parts: list[np.ndarray], first_free: int) -> bytes:
    """One shard record's body."""
    left, right, size, seq = compress(np.concatenate(parts), first_free)
    ends = np.cumsum([len(p) for p in parts])
    head = MAGIC + struct.pack("<5Q", first_free, len(left), len(seq), len(ids), int(ends[-1]))
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    arrays = (left.astype("<u2"), right.astype("<u2"), size.astype("<u4"), seq.astype("<u2"), ends.astype("<u8"), np.array([i or 0 for i in ids], dtype="<i8"), known)
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """Reader of a shard record's body; arrays are views, nothing is expanded before it is asked for."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        self.first_free, rules, symbols, docs, self.n_tokens = struct.unpack_from("<5Q", body, 4)
        at, arrays = 44, []
        for kind, n in (("<u2", rules), ("<u2", rules), ("<u4", rules), ("<u2", symbols), ("<u8", docs), ("<i8", docs), ("u1", docs)):
            arrays.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
            at += arrays[-1].nbytes
        self.left, self.right, size, self.sequence, self.ends, ids, known = arrays
        self.size = np.concatenate([np.ones(self.first_free, dtype=np.int64), size.astype(np.int64)])
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.reach = np.cumsum(self.size[self.sequence])
        # Expansions of all symbols of SHORT tokens at most, one after another; longer ones are halved until they are short.
        self.short = np.flatnonzero(self.size <= SHORT)
        lengths = self.size[self.short]
        self.start = np.zeros(len(self.size), dtype=np.int64)
        self.start[self.short] = np.cumsum(lengths) - lengths
        self.table = self._halved(self.short, 1)

    def _halved(self, symbols: np.ndarray, longest: int) -> np.ndarray:
        """Symbols with rules of more than ``longest`` tokens replaced by their sides."""
        out = symbols.astype(np.uint32)
        while (rule := self.size[out] > longest).any():
            at = np.repeat(out, np.where(rule, 2, 1))
            first = np.cumsum(np.where(rule, 2, 1))[rule] - 2
            which = out[rule] - self.first_free
            at[first], at[first + 1] = self.left[which], self.right[which]
            out = at
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        out = self._halved(symbols, SHORT)
        lengths = self.size[out]
        stops = np.cumsum(lengths)
        return self.table[np.repeat(self.start[out] - stops + lengths, lengths) + np.arange(int(lengths.sum()))]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Token ids [start, stop) of the shard; only the symbols over that range are expanded."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        a, b = np.searchsorted(self.reach, start, side="right"), np.searchsorted(self.reach, stop - 1, side="right")
        before = int(self.reach[a - 1]) if a else 0
        return self.expand(self.sequence[a : b + 1])[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` and write shards below ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    text = Path(tokenizer_file).read_text(encoding="utf-8")
    if len(text) > MOST_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is too large to broadcast")
    held = spark.sparkContext.broadcast(text)
    ordered = text_columns(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(held.value)
        pieces, first_free = PieceIds(tokenizer), max(tokenizer.get_vocab_size(), end_id + 1)
        if first_free >= SYMBOLS:
            raise ValueError("ids of this vocabulary do not fit two bytes")
        part, seq, ids, parts, length = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def record() -> pa.RecordBatch:
            return pa.record_batch({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                "n_tokens": pa.array([length], pa.int64()), "body": pa.array([pack(ids, parts, first_free)], pa.binary()),
            })

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = pieces.of(text or "")
                    ids.append(doc)
                    parts.append(np.concatenate([found, end]))
                    length += len(found) + 1
                    if length >= shard_tokens:
                        yield record()
                        seq, ids, parts, length = seq + 1, [], [], 0
        if ids:
            yield record()

    ordered.mapInArrow(without_cycles(run), "part int, seq int, n_docs long, n_tokens long, body binary").write.mode("errorifexists").parquet(path)


def offsets(shards: DataFrame) -> DataFrame:
    """(part, seq, before): tokens in all shards before each; one row per task meets in the outer sum."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    parts = parts.withColumn("_earlier", F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    local = shards.select("part", "seq", F.sum("n_tokens").over(within).alias("_local"))
    zero = F.lit(0).cast("long")
    return local.join(parts, "part").select("part", "seq", (F.coalesce("_local", zero) + F.coalesce("_earlier", zero)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, seq, local_start, ids) of each document, decoded from the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, body in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("body"), strict=True):
                shard = Shard(body.as_py())
                for a in range(0, len(shard.doc_ids), 256):
                    b = min(a + 256, len(shard.doc_ids))
                    edges = np.concatenate([[shard.ends[a - 1] if a else 0], shard.ends[a:b]]).astype(np.int64)
                    flat = shard.tokens(int(edges[0]), int(edges[-1]))
                    yield pa.record_batch({
                        "doc_id": pa.array(shard.doc_ids[a:b], pa.int64()), "part": pa.array([part] * (b - a), pa.int32()), "seq": pa.array([seq] * (b - a), pa.int32()),
                        "local_start": pa.array(edges[:-1]), "ids": pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(flat.astype(np.int32))),
                    })

    return spark.read.parquet(path).select("part", "seq", "body").mapInArrow(run, "doc_id long, part int, seq int, local_start long, ids array<int>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = [ids.values.to_numpy() for ids in batch.column("ids")]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "part": batch.column("part"), "seq": batch.column("seq"), "local_start": batch.column("local_start"),
                "n_tokens": pa.array([len(f) for f in flats], pa.int64()), "ids_crc32": pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in flats], pa.int64()),
            })

    rows = read(spark, path).mapInArrow(run, "doc_id long, part int, seq int, local_start long, n_tokens long, ids_crc32 long")
    before = offsets(spark.read.parquet(path).select("part", "seq", "n_tokens"))
    return rows.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer_file: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Digest of ``docs`` after a round trip through shards in the shared folder."""
    path = shared_dir(docs.sparkSession, "grammar")
    write(docs, path, tokenizer_file, end_id, shard_tokens)
    return digest(docs.sparkSession, path)
