"""Byte-level BPE and Huffman files against the public libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidegauge.llm import bpe, huffman
from tidegauge.llm.base import new_path
from tidegauge.llm.bpe_query import PATTERN, RANKS

TOKENS = bpe.read_ranks(RANKS)
ENCODING = tiktoken.Encoding(
    "own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={}
)


def expected(text):
    return np.array(ENCODING.encode_ordinary(text or ""), "<u4").tobytes()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(TOKENS, PATTERN)


def test_random_texts(vocabulary):
    draw = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "1", "!!", "中", "\x1c", "\xa0", "the ", " of"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)]
    assert vocabulary.words.encode_batch(texts) == [expected(t) for t in texts]


def test_long_matches(vocabulary):
    for word in ("abcde" * 400, "a" * 5000, "xyz" * 23, "é" * 300):
        assert vocabulary.words.encode_batch([word]) == [expected(word)]


def test_round_trip(spark, odd):
    rows = bpe.encode(odd, TOKENS, PATTERN, decoded="decoded").collect()
    assert len(rows) == odd.count()
    for row in rows:
        assert bytes(row["ids"]) == expected(row["text"])
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    again = bpe.decode(bpe.encode(odd.select("doc_id", "text"), TOKENS, PATTERN), TOKENS, PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again)
    assert bpe.encode(odd.limit(0), TOKENS, PATTERN).count() == 0


def test_code_is_optimal_and_limited():
    draw = np.random.default_rng(1)
    counts = np.floor(draw.pareto(0.7, 3000) * 5).astype(np.int64)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and (lengths[counts > 0] > 0).all() and (lengths[counts == 0] == 0).all()
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    even = huffman.code_lengths(np.ones(8, np.int64))
    assert (even == 3).all()
    assert huffman.code_lengths(np.array([0, 5]))[1] == 1


def test_pack_and_unpack():
    draw = np.random.default_rng(2)
    counts = np.floor(draw.pareto(0.7, 500) * 5).astype(np.int64) + 1
    lengths = huffman.code_lengths(counts)
    ids = draw.choice(500, 5000, p=counts / counts.sum())
    stream, points = huffman.pack(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.unpack(stream, points, len(ids), lengths) == ids).all()
    # A block decodes from its checkpoint alone.
    part = huffman.unpack(stream, points[2:3], huffman.BLOCK, lengths)
    assert (part == ids[2 * huffman.BLOCK : 3 * huffman.BLOCK]).all()


def test_files(spark, odd):
    with open(huffman.VOCABULARY, encoding="utf-8") as file:
        description = file.read()
    own = Tokenizer.from_str(description)
    own.encode_special_tokens = True
    folder = new_path(spark, "test-ids")
    huffman.write_ids(odd, folder, description)
    rows = huffman.read_ids(spark, folder).orderBy("start").collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(own.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    start = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in texts[r["doc_id"]]
        assert r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(keys) == odd.count()
    digests = {(r["doc_id"], r["ids_crc32"]) for r in huffman.read_ids(spark, folder, digest=True).collect()}
    assert digests == {(r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in rows}
