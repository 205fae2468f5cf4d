"""Token alignment against the two libraries, pair by pair, and perfect hashing."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegauge.llm import alignment, byte_bpe
from tidegauge.llm.perfect_hash import PerfectHash

with open(alignment.BYTE_LEVEL, encoding="utf-8") as _file:
    DESCRIPTION = _file.read()
with open(alignment.PIECES, "rb") as _file:
    MODEL = _file.read()
LIBRARY = Tokenizer.from_str(DESCRIPTION)
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def groups(text):
    """The groups of a text, as lists of A and B ids."""
    if not text:
        return []
    names = {c: bytes([b]) for b, c in byte_bpe.byte_names().items()}
    vocab = {i: t for t, i in LIBRARY.get_vocab().items()}
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    bytes_a = [b"".join(names[c] for c in vocab[i]) for i in a]
    bytes_b = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    out, begun = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append([[i for i, e in zip(ids, ends, strict=True) if begun < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))])
        begun = end
    return out


def brute(texts):
    cut = [groups(t) for t in texts]
    linked = [[(a, b) for ga, gb in own for a in ga for b in gb] for own in cut]
    counts = Counter(p for own in linked for p in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for own, links in zip(cut, linked, strict=True):
        yield (
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links),
            sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
            ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own),
        )


PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "1", "!!", "中", "\xa0", "▁", "<s>", "<0x41>", "<|endoftext|>", "the ", " of", "\U0001f600", "ation"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    own = ["".join(draw.choices(PARTS, k=draw.randint(0, 12))) for _ in range(150)]
    return [*own, *own[:10], None, "", "zq" * 400, "supercalifragilistic " * 60]


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 150])
def test_against_libraries(spark, texts, monkeypatch, slice_pairs):
    """Also with pairs in several slices, and counts summed from many tasks."""
    monkeypatch.setattr(alignment, "SLICE_PAIRS", slice_pairs)
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_A int, row string").repartition(19)
    found = alignment.align(df, DESCRIPTION, MODEL)
    assert found.columns == ["doc_id", "text", "row", *alignment.ADDED[:7]]
    got = {r["doc_id"]: tuple(r[c] for c in alignment.ADDED[:7]) for r in found.collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, texts[i]


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(1, "of the"), (1, "of the"), (2, "▁"), (None, None)], "doc_id long, text string")
    got = alignment.align(df, DESCRIPTION, MODEL, keep=["doc_id"], digest=True).collect()
    text = list(brute(["of the"]))[0][6]
    assert sorted(r["groups_sha256"] for r in got) == ["", ""] + [hashlib.sha256(text.encode()).hexdigest()] * 2
    assert {r["count_sum"] for r in got if r["n_a"]} == {2 * got[0]["n_links"] if got[0]["n_a"] else 4}
    assert alignment.align(df.limit(0), DESCRIPTION, MODEL).count() == 0


def test_links_in_pieces(monkeypatch):
    """Long groups are listed bit by bit, with the same links."""
    draw = np.random.default_rng(1)
    a = [draw.integers(0, 50, 300), draw.integers(0, 50, 7)]
    b = [draw.integers(0, 40, 200), draw.integers(0, 40, 1)]
    sizes_a = np.ones(50, np.int64)
    sizes_b = np.full(40, 1)
    b[0] = np.concatenate([b[0], draw.integers(0, 40, 100)])
    b[1] = np.concatenate([b[1], draw.integers(0, 40, 6)])
    whole = alignment.Aligned(a, b, sizes_a, sizes_b)
    whole.a_group[:300], whole.b_group[:300] = 0, 0
    whole.a_group[300:], whole.b_group[300:] = 1, 1
    whole.in_a = whole.in_b = np.array([300, 7])

    def listed():
        return sorted(p for doc, key in whole.links(40) for p in zip(doc.tolist(), key.tolist(), strict=True))

    want, distinct = listed(), whole.distinct((50, 40))
    assert len(want) == 300 * 300 + 49
    monkeypatch.setattr(alignment, "LINKS", 1000)
    assert listed() == want and (whole.distinct((50, 40)) == distinct).all()
    assert distinct.tolist() == sorted({d * 2000 + k for d, k in want})


def test_perfect_hash():
    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 200_000):
        keys = np.unique(draw.integers(0, 1 << 40, n))
        own = PerfectHash.build(keys)
        place = own.places(keys)
        assert (np.sort(place) == np.arange(len(keys))).all() and (own.keys[place] == keys).all()
        other = np.setdiff1d(draw.integers(0, 1 << 40, 1000), keys)
        assert (own.places(other) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))


def test_ranks_encode_like_the_library():
    own = byte_bpe.ByteBpe(DESCRIPTION)
    assert own._merger is not None
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x3000, 0x20000, 37))
    lines = [f" a{chr(c)}b {chr(c)}{chr(c)}  {chr(c)} 1{chr(c)}\n" for c in points if not 0xD800 <= c < 0xE000]
    lines += ["", "<|endoftext|> <|endoftext|>", "x" * 3000]
    want = LIBRARY.encode_batch(lines, add_special_tokens=False)
    assert all(x.tolist() == e.ids for x, e in zip(own.encode(lines), want, strict=True))
    # Another cut: the library itself.
    other = byte_bpe.ByteBpe(DESCRIPTION.replace('"add_prefix_space":false', '"add_prefix_space":true', 1).replace('"add_prefix_space": false', '"add_prefix_space": true', 1))
    assert other._merger is None
    assert other.encode(["ab", "c"])[0].tolist() == own.encode([" ab"])[0].tolist()


def test_repeated_pairs_are_sorted_and_looked_up_once(monkeypatch):
    """Many links of few pairs, listed in pieces: sums by link, and no pair asked for twice a piece."""
    monkeypatch.setattr(alignment, "LINKS", 50)
    draw = np.random.default_rng(5)
    a = [draw.integers(0, 4, n).astype(np.uint32) for n in (60, 0, 90)]
    part = alignment.Aligned(a, [x[: len(x) // 2] for x in a], np.full(4, 1), np.full(4, 2))
    met = np.unique(np.concatenate([key for _, key in part.links(4)]))
    assert part.pairs(4).tolist() == met.tolist() == np.unique(part.distinct((4, 4)) % 16).tolist()
    keys, best = met[1:], np.full(4, 7)  # one pair is no key
    lookup = alignment.Lookup(0, 1, PerfectHash.build(keys), np.zeros(len(keys), np.int64))
    lookup.counts[:] = 3 + lookup.hash.keys % 5
    asked, places = [], PerfectHash.places
    monkeypatch.setattr(PerfectHash, "places", lambda self, k: asked.append(k) or places(self, k))
    monkeypatch.setattr(alignment, "slice_of", None)  # one slice holds every pair
    for _, key in part.links(4):
        count, is_best = alignment.standing(lookup, best, key, 4)
        expected = [3 + k % 5 if k in keys else 0 for k in key.tolist()]
        assert count.tolist() == expected and is_best.tolist() == [c == 7 for c in expected]
    assert len(asked) > 1 and all(len(k) == len(set(k.tolist())) for k in asked)


@pytest.mark.parametrize("plain", [True, False])
def test_ids_give_their_bytes(plain):
    with open(alignment.BYTE_LEVEL, encoding="utf-8") as file:
        own = byte_bpe.ByteBpe(file.read())
    if not plain:
        own._merger = None
    ids = own.tokens().index(b" the"), own.tokens().index(b"\xff")
    assert own.decode(np.array([*ids, ids[0]], np.uint32)) == b" the\xff the" and own.decode(np.zeros(0, np.uint32)) == b""
