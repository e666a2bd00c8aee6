"""Token operators against the libraries themselves."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from periodica.llm import byte_bpe, grammar_output

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [1 << 25, 3000])
def test_byte_bpe(edge_docs, edge_rows, small, encoding, block):
    rows = list(edge_rows) + [tuple(r) for r in small.select("doc_id", "text").collect()]
    docs = edge_docs.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN, block_bytes=block)
    got = Counter(tuple(r) for r in byte_bpe.digest(byte_bpe.decode(encoded, PATH)).collect())
    want = Counter()
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_byte_bpe_without_rows(no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, PATH, P.PATTERN), PATH).count() == 0


@pytest.mark.parametrize("text", ["a  b", "a \n b", "  ", " a", "a ", "\x1c \x1d a", "a　 b 　c", "'s 's x's", "1 2  3\n\n 4", "́a ́"])
def test_splitter(encoding, text):
    import regex

    s = byte_bpe.Splitter(regex.compile(P.PATTERN))
    codes = s.split(text).tolist()
    words = list(s.codes)
    ids = [x for c in codes for x in encoding._core_bpe.encode_single_piece(words[c])]
    assert ids == encoding.encode_ordinary(text)


def test_pieces_end_with_their_block():
    import gc
    import weakref

    splitter = byte_bpe.Splitter(re.compile(r"\w+|\s+|[^\w\s]+"))
    splitter.split("one two, three")
    pieces = weakref.ref(splitter.later)
    gc.disable()
    try:
        del splitter
        assert pieces() is None
    finally:
        gc.enable()


WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_grammar_shards(spark, edge_docs, edge_rows, small, shard):
    rows = list(edge_rows) + [(r["doc_id"] + 100, r["text"]) for r in small.collect()]
    docs = edge_docs.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 100 as doc_id", "text")).repartition(5)
    got = Counter(tuple(r) for r in grammar_output.written_and_read(docs, WORDS, 2, shard).collect())
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, Counter()
    for known, i, t in sorted((i is not None, i or 0, t or "") for i, t in rows):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        want[(i if known else None, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert got == want


def test_matches_of_plain_text():
    """Texts of ASCII and plain letters are cut at the pattern's matches, and their words meet the library's model alone."""
    rng, tokenizer = np.random.default_rng(5), Tokenizer.from_file(WORDS)
    pieces, parts = grammar_output.PieceIds(tokenizer), ["a", "B", "É", "ß", " ", "\n", "\x1c", "\x85", "'s", "'LL", "'", "22", ".", ",", "<|endoftext|>", "<|", "\x00", "don't", "İ", "ſ", "́", "x'S", "µ", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        assert pieces.of(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert "é" in pieces.matches and "'s" in pieces.matches and "<|endoftext|>" not in pieces.matches


def test_grammar_without_rows(no_docs):
    assert grammar_output.written_and_read(no_docs, WORDS, 2).count() == 0


@pytest.mark.parametrize("ids", [[5] * 1000, [1, 2, 3] * 400 + [7], list(range(500)), [1, 1, 2, 1, 1, 1, 2, 2] * 90, [9]])
def test_grammar_ranges(ids):
    flat = np.array(ids, dtype=np.uint32)
    half = len(flat) // 2
    shard = grammar_output.Shard(grammar_output.pack([4, None], [flat[:half], flat[half:]], 1000))
    assert shard.doc_ids == [4, None] and shard.tokens(0, len(flat)).tolist() == ids
    assert shard.document(0).tolist() == ids[:half] and shard.document(1).tolist() == ids[half:]
    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, len(ids) + 1, (50, 2)).tolist():
        assert shard.tokens(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)]
    if len(set(ids)) < 5 and len(ids) > 100:
        assert len(shard.sequence) < len(ids) / 4


def test_short_expansions_are_looked_up():
    """A reader holds the expansions of symbols of few tokens only; longer symbols are halved until they are short."""
    rng = np.random.default_rng(2)
    passage = rng.permutation(900).astype(np.uint32)
    shard = grammar_output.Shard(grammar_output.pack([1], [np.concatenate([np.tile(passage, 7), np.full(3000, 5, dtype=np.uint32)])], 1000))

    def plain(symbol):
        if symbol < 1000:
            return [symbol]
        return plain(int(shard.left[symbol - 1000])) + plain(int(shard.right[symbol - 1000]))

    assert shard.size.max() >= 900 and shard.size[shard.short].max() <= grammar_output.SHORT
    assert len(shard.table) == shard.size[shard.short].sum() <= grammar_output.SHORT * len(shard.size)
    for symbol in range(len(shard.size)):
        assert shard.expand(np.array([symbol])).tolist() == plain(symbol)


def test_grammar_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.permutation(900).astype(np.uint32)
    flat = np.concatenate([np.concatenate([passage, [1000 + k]]) for k in range(8)]).astype(np.uint32)
    left, right, size, seq = grammar_output.compress(flat, 2000)
    assert size.max() == 900 and len(seq) == 16
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert max(pairs.values()) < 6
    shard = grammar_output.Shard(grammar_output.pack([1], [flat], 2000))
    assert shard.tokens(0, len(flat)).tolist() == flat.tolist()
