"""Byte-level BPE encoding and decoding.

Text is cut by the vocabulary's pattern, and each match is merged on its own: over its byte
positions stands a segment tree whose leaf ``i`` holds the rank of the pair that starts at
``i``, followed by ``i`` itself, so the root is the leftmost pair of lowest rank. A merge
writes the leaves of the merged pair, its left neighbour and the symbol that went, each with
a logarithmic walk to the root. Short matches are merged many at a time, one tree per row of
a matrix; long ones, which would fill a matrix alone, one by one.

Most words of a corpus repeat, so every Python worker remembers the ids of some pieces of
text, bounded in bytes. Spark partitions the documents; nothing is shuffled.

Null and empty texts have no ids. Rows are kept as they are, repeated ones too, and all
other columns pass through; the two columns that are added replace any of their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.memory import Remembered, held
from tidegauge.llm.words import WordIds

# Bytes of the words, and of the matches, that a worker remembers.
REMEMBERED = 64 << 20
# Matches of more bytes than this are merged one by one.
ROW_BYTES = 64
NONE = np.int64(1) << 62
PLACE = np.int64((1 << 32) - 1)

def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank: base64 of the token, blank, rank on each line."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """The merge tables of one rank file, and the pieces of text met so far."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for the bytes {missing}")
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            self.rank[t[:i]] << 32 | self.rank[t[i:]]: r
            for r, t in enumerate(tokens)
            for i in range(1, len(t))
            if t[:i] in self.rank and t[i:] in self.rank
        }
        self.pairs = pairs
        self.pair_keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_ranks = np.array([*(pairs[k] for k in self.pair_keys.tolist()), NONE], np.int64)
        self.pair_keys = np.append(self.pair_keys, np.int64(-1) ^ (np.int64(1) << 63))
        first = np.arange(256)
        self.byte_pairs = self.pair_rank(
            np.repeat(self.of_byte[first], 256), np.tile(self.of_byte[first], 256)
        )
        self.matches = Remembered(REMEMBERED)
        self.words = WordIds(self.encode_pieces, REMEMBERED)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    # -- merging -----------------------------------------------------------------------

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Merge words of 2 to ROW_BYTES bytes, a segment tree in each row of a matrix."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        leaves = 1 << int(lengths.max() - 1).bit_length()
        width = leaves + 2
        padded = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        padded = padded.reshape(n, width).astype(np.int64)
        symbols = self.of_byte[padded]
        place = np.arange(width)
        # Column ``lengths`` of a row stands for its end; before the first there is -1.
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * leaves), NONE)
        ranks = self.byte_pairs[(padded[:, :-1] << 8 | padded[:, 1:])[:, :leaves]]
        inside = place[:leaves] + 1 < lengths[:, None]
        tree[:, leaves:] = np.where(inside & (ranks < NONE), ranks << 32 | place[:leaves], NONE)
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(
                tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
            )
        alive = np.ones((n, width), bool) & (place < lengths[:, None])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best & PLACE, best >> 32
            gone = after[rows, at]
            follow = after[rows, gone]
            symbols[rows, at] = rank
            alive[rows, gone] = False
            after[rows, at] = follow
            before[rows, follow] = at
            right = np.where(follow < lengths[rows], self.pair_rank(rank, symbols[rows, follow]), NONE)
            prior = before[rows, at]
            held = np.maximum(prior, 0)
            left = np.where(prior >= 0, self.pair_rank(symbols[rows, held], rank), NONE)
            # The last byte starts no pair and may have no leaf.
            ends = gone < leaves
            self._write(tree, leaves, rows[ends], gone[ends], np.full(int(ends.sum()), NONE))
            self._write(tree, leaves, rows, at, np.where(right < NONE, right << 32 | at, NONE))
            has = prior >= 0
            left = np.where(left < NONE, left << 32 | held, NONE)
            self._write(tree, leaves, rows[has], held[has], left[has])
            rows = rows[tree[rows, 1] < NONE]
        flat = symbols[alive].astype("<u4").tobytes()
        stops = np.cumsum(alive.sum(axis=1)) * 4
        starts = np.concatenate([[0], stops[:-1]])
        return [flat[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    @staticmethod
    def _write(tree: np.ndarray, leaves: int, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        node = leaves + at
        tree[rows, node] = values
        level = leaves
        while level > 1:
            level >>= 1
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_one(self, word: bytes) -> bytes:
        """Merge one long word; the same tree in a list."""
        none, n, pairs = 1 << 62, len(word), self.pairs
        leaves = 1 << (n - 1).bit_length()
        symbols = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def leaf(i: int, j: int) -> int:
            rank = pairs.get(symbols[i] << 32 | symbols[j])
            return none if rank is None else rank << 32 | i

        tree = [none] * (2 * leaves)
        tree[leaves : leaves + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def write(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while (best := tree[1]) < none:
            i = best & 0xFFFFFFFF
            gone = after[i]
            follow = after[gone]
            symbols[i], symbols[gone] = best >> 32, -1
            after[i] = follow
            write(gone, none)
            if follow < n:
                before[follow] = i
                write(i, leaf(i, follow))
            else:
                write(i, none)
            if (prior := before[i]) >= 0:
                write(prior, leaf(prior, i))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def encode_matches(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of every distinct match; a match that is a token needs no merge."""
        out, rows = {}, {}
        for word in words:
            rank = self.rank.get(word)
            if rank is not None:
                out[word] = rank.to_bytes(4, "little")
            elif len(word) > ROW_BYTES:
                out[word] = self.merge_one(word)
            else:
                rows.setdefault((len(word) - 1).bit_length(), []).append(word)
        for own in rows.values():
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                out.update(zip(part, self.merge_rows(part), strict=True))
        return out

    # -- texts -------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of whole strings, each cut by the pattern."""
        cut = [[m.encode() for m in self.pattern.findall(p)] for p in pieces]
        self.matches.update({m for words in cut for m in words}, self._encode_list)
        known = self.matches.young.__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def _encode_list(self, matches: list[bytes]) -> list[bytes]:
        found = self.encode_matches(matches)
        return [found[m] for m in matches]

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _vocabulary(shared, pattern: str) -> Vocabulary:
    """One vocabulary per Python worker, however many tasks it runs."""
    tokens = shared.value
    digest = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).digest()
    return held(("bpe", digest, pattern), lambda: Vocabulary(tokens, pattern))


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the columns of ``added`` at its end."""
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in added}
    return pa.RecordBatch.from_pydict({**kept, **added})


def _schema(df: DataFrame, names: list[str]) -> T.StructType:
    kept = [f for f in df.schema if f.name not in names]
    return T.StructType([*kept, *(T.StructField(n, T.BinaryType()) for n in names)])


def encode(
    df: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Add ``ids``, the packed ids of ``text``; with ``decoded`` also the bytes they stand for.

    ``tokens`` come from ``read_ranks``; they travel as a broadcast, whose size is that of
    the vocabulary. Decoding in the same pass saves sending the ids to Python again.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    names = [ids] + ([decoded] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(shared, pattern)
        for batch in batches:
            packed = own.words.encode_batch(batch.column(text).to_pylist())
            added = {ids: pa.array(packed, pa.binary())}
            if decoded:
                added[decoded] = pa.array([own.decode(p) for p in packed], pa.binary())
            yield _with(batch, added)

    return df.mapInArrow(run, _schema(df, names))


def decode(
    df: DataFrame, tokens: list[bytes], pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add ``decoded``, the bytes of the packed ids; null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(shared, pattern)
        for batch in batches:
            out = [own.decode(p) for p in batch.column(ids).to_pylist()]
            yield _with(batch, {decoded: pa.array(out, pa.binary())})

    return df.mapInArrow(run, _schema(df, [decoded]))
