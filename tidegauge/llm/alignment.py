"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same text.

A text is encoded by a byte-level BPE vocabulary (A, with a blank before the text) and by a
SentencePiece model (B, which adds the blank itself). Bytes at which tokens of both end cut
the tokens into groups; every A token of a group is linked with every B token of it. For each
pair of ids the documents that hold it linked are counted over the corpus, and every document
is told how its links stand in these counts.

Ids are stored once, two bytes each where the vocabulary allows, and each task adds the
distinct pairs it met. All distinct pairs are dealt by hash into slices of about SLICE_PAIRS,
and each slice gets a minimal perfect hash (``perfect_hash.py``). For each slice every task
aligns its stored ids again and counts in one dense vector, indexed by the hash; vectors are
cut into segments and summed as a tree, FAN_IN at a time. In the second pass documents are
aligned once more and look their pairs up, keys verified. A pair of ids that is not a key, or
is looked up in another slice, has no place. So a worker holds the pairs of one slice,
whatever the corpus; how many slices there are follows from the pairs, which the two
vocabularies bound. Links are listed LINKS at a time, so long groups take time, not memory.

Null and empty texts, and texts that A or B do not give back byte for byte, have no tokens:
zeros, and empty groups. Repeated rows are documents of their own. An empty table gives no
rows. Columns named like those that are added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.base import materialize, query, table
from tidegauge.llm.byte_bpe import ByteBpe
from tidegauge.llm.memory import held
from tidegauge.llm.perfect_hash import PerfectHash, mixed

SLICE_PAIRS = 2_000_000
# Counts of one stored segment, and vectors that one task sums.
SEGMENT = 1 << 16
FAN_IN = 16
# Links listed at once, and distinct pairs a task holds before it hands them on.
LINKS = 1 << 20
HELD_PAIRS = 1 << 21
# Bytes of text encoded and aligned at once; a longer text is alone.
PART_BYTES = 1 << 20
# The seed that deals pairs to slices; no level of a perfect hash has it.
SLICE_SEED = 1_000_003

ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, description: str, model: bytes):
        import sentencepiece

        self.a = ByteBpe(description)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = self.a.tokens()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 40:
            raise ValueError("the vocabularies have too many pairs")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.a_bytes), len(self.b_bytes)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both; none where either does not give the text back."""
        none = np.zeros(0, np.uint32)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        known = [i for i, text in enumerate(texts) if text]
        spaced = [" " + texts[i] for i in known]
        for i, own, a, b in zip(known, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in known], num_threads=1), strict=True):
            data = own.encode()
            if self.a.decode(a) == data == b"".join(map(self.b_bytes.__getitem__, b)):
                out_a[i], out_b[i] = a, np.array(b, np.uint32)
        return out_a, out_b


class Aligned:
    """Tokens of several documents one after the other, cut into groups."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(none + a).astype(np.int64), np.concatenate(none + b).astype(np.int64)
        ends_a, ends_b = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        # Both give the same bytes of each document, so its end is a common end.
        at = np.searchsorted(ends_b, ends_a)
        common = ends_b[at] == ends_a if len(at) else np.zeros(0, bool)
        self.a_last, self.b_last = common, np.zeros(len(self.b), bool)
        self.b_last[at[common]] = True
        self.a_group = np.cumsum(common) - common
        self.b_group = np.cumsum(self.b_last) - self.b_last
        groups = int(common.sum())
        self.in_a = np.bincount(self.a_group, minlength=groups)
        self.in_b = np.bincount(self.b_group, minlength=groups)
        self.a_doc = np.repeat(np.arange(len(a)), self.n_a)
        self.n_groups = np.bincount(self.a_doc[common], minlength=len(a))

    def links(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, A id * width + B id) of all links, about LINKS at a time."""
        first_b = np.cumsum(self.in_b) - self.in_b
        partners = self.in_b[self.a_group]
        ends = np.cumsum(partners)
        start = 0
        while start < len(self.a):
            begun = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, begun + LINKS, side="right")))
            n = partners[start:stop]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            b = self.b[np.repeat(first_b[self.a_group[start:stop]], n) + within]
            yield np.repeat(self.a_doc[start:stop], n), np.repeat(self.a[start:stop], n) * width + b
            start = stop

    def distinct(self, shape: tuple[int, int]) -> np.ndarray:
        """document * all pairs + pair, once for each pair of a document."""
        pairs = shape[0] * shape[1]
        return _distinct(doc * pairs + key for doc, key in self.links(shape[1]))

    def pairs(self, width: int) -> np.ndarray:
        """A id * width + B id, once for each pair of any document."""
        return _distinct(key for _, key in self.links(width))

    def texts(self, strings: list[str], shape: tuple[int, int]) -> list[str]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        before_b, upto_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        codes[np.arange(len(self.a)) + before_b[self.a_group]] = self.a + shape[0] * self.a_last
        codes[np.arange(len(self.b)) + upto_a[self.b_group]] = 2 * shape[0] + self.b + shape[1] * self.b_last
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        out, start = [], 0
        for end in ends:
            out.append("".join(map(strings.__getitem__, codes[start:end].tolist()))[:-1])
            start = end
        return out


def _distinct(arrays: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct numbers of all arrays, in order; each array is sorted once."""
    held, size = [], 0
    for own in arrays:
        held.append(np.unique(own))
        size += len(held[-1])
        if size > 4 * LINKS and len(held) > 1:
            held = [np.unique(np.concatenate(held))]
            size = 0
    return held[0] if len(held) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *held]))


def group_strings(shape: tuple[int, int]) -> list[str]:
    a, b = range(shape[0]), range(shape[1])
    return [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b]


@dataclass
class Lookup:
    """The counts of one slice's pairs, by the place of its hash."""

    number: int
    slices: int
    hash: PerfectHash
    counts: np.ndarray

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Verified places of the keys of this slice, -1 for others."""
        if self.slices == 1:
            return self.hash.places(keys)
        out = np.full(len(keys), -1, np.int64)
        own = slice_of(keys, self.slices) == self.number
        out[own] = self.hash.places(keys[own])
        return out


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mixed(keys, SLICE_SEED) % np.uint64(slices)).astype(np.int64)


class _Store:
    """Packs ids into as few bytes as the vocabulary allows."""

    def __init__(self, size: int):
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def pack(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind)


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about PART_BYTES."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > PART_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def tokenized(df: DataFrame, text: str, description: str, model: bytes, keep: list[str]) -> DataFrame:
    """Stored: ``row`` (the kept columns), ``id``, ``a`` and ``b`` of each document, and rows of distinct ``pairs``."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast((description, model))
    schema = T.StructType([
        T.StructField("row", own.schema["row"].dataType), T.StructField("id", T.LongType()), T.StructField("a", T.BinaryType()),
        T.StructField("b", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = held(("vocabularies", *shared.value), lambda: Vocabularies(*shared.value))
        store_a, store_b = map(_Store, both.shape)
        next_id = TaskContext.get().partitionId() << 40
        seen, kind = [np.zeros(0, np.int64)], None

        def handed() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(seen))
            return pa.RecordBatch.from_pydict({
                "row": pa.nulls(1, kind), "id": pa.nulls(1, pa.int64()), "a": pa.nulls(1, pa.binary()), "b": pa.nulls(1, pa.binary()),
                "pairs": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys)),
            })

        for batch in batches:
            kind = batch.column("row").type
            texts = batch.column("text").to_pylist()
            for part in _parts([len(t or "") for t in texts]):
                a, b = both.encode(texts[part])
                seen.append(Aligned(a, b, both.a_sizes, both.b_sizes).pairs(both.shape[1]))
                n = len(a)
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column("row")[part], "id": pa.array(range(next_id, next_id + n), pa.int64()),
                    "a": pa.array([store_a.pack(x) for x in a], pa.binary()), "b": pa.array([store_b.pack(x) for x in b], pa.binary()),
                    "pairs": pa.nulls(n, pa.list_(pa.int64())),
                })
                next_id += n
                if sum(map(len, seen)) > HELD_PAIRS:
                    seen = [np.unique(np.concatenate(seen))]
                    if len(seen[0]) > HELD_PAIRS // 2:
                        yield handed()
                        seen = [np.zeros(0, np.int64)]
        if kind is not None:
            yield handed()

    return materialize(own.mapInArrow(run, schema), "tokens")


@dataclass
class Shared:
    """What aligning stored ids needs of the vocabularies."""

    a_sizes: np.ndarray
    b_sizes: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.a_sizes), len(self.b_sizes)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
        """Stored documents, aligned again, a few at a time."""
        store_a, store_b = map(_Store, self.shape)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for part in _parts([2 * len(x) for x in a]):
                yield batch.slice(part.start, part.stop - part.start), Aligned(
                    [store_a.unpack(x) for x in a[part]], [store_b.unpack(x) for x in b[part]], self.a_sizes, self.b_sizes
                )


def hashed_slices(pairs: DataFrame, slices: int) -> DataFrame:
    """A row per slice: its number, and the perfect hash of its pairs."""

    def build(rows: pa.Table) -> pa.Table:
        own = PerfectHash.build(rows.column("pair").to_numpy())
        return pa.table({
            "slice": rows.column("slice")[:1], "words": pa.array([own.words.tobytes()], pa.binary()),
            "sizes": pa.array([own.sizes], pa.list_(pa.int64())), "keys": pa.array([own.keys.tobytes()], pa.binary()),
        })

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_pydict({"pair": batch.column("pair"), "slice": slice_of(keys, slices)})

    dealt = pairs.mapInArrow(number, "pair long, slice long")
    return materialize(dealt.groupBy("slice").applyInArrow(build, "slice long, words binary, sizes array<long>, keys binary"), "hashes")


def summed_counts(stored: DataFrame, shared, found) -> DataFrame:
    """Stored rows (segment, counts) of one slice: the documents that hold each pair, by place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = shared.value, found.value
        pairs = own.shape[0] * own.shape[1]
        vector = np.zeros(len(lookup.hash.keys), np.int64)
        for _, part in own.parts(batches):
            keys, times = np.unique(part.distinct(own.shape) % pairs, return_counts=True)
            place = lookup.places(keys)
            vector[place[place >= 0]] += times[place >= 0]
        branch = TaskContext.get().partitionId()
        for start in range(0, len(vector), SEGMENT):
            if (piece := vector[start : start + SEGMENT]).any():
                yield pa.RecordBatch.from_pylist([{"branch": branch, "segment": start // SEGMENT, "counts": piece.tobytes()}], schema=_COUNTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["branch"], row["segment"]) != key:
                    if key is not None:
                        yield _segment(key, total)
                    key, total = (row["branch"], row["segment"]), np.frombuffer(row["counts"], np.int64).copy()
                else:
                    total += np.frombuffer(row["counts"], np.int64)
        if key is not None:
            yield _segment(key, total)

    ddl = "branch long, segment long, counts binary"
    rows = materialize(stored.select("a", "b").mapInArrow(count, ddl), "counts")
    left = rows.agg(F.max("branch")).first()[0] or 0
    while left > 0:
        left //= FAN_IN
        dealt = rows.withColumn("branch", F.expr(f"branch div {FAN_IN}")).repartition("branch", "segment")
        rows = materialize(dealt.sortWithinPartitions("branch", "segment").mapInArrow(add, ddl), "counts")
    return rows


_COUNTS = pa.schema([("branch", pa.int64()), ("segment", pa.int64()), ("counts", pa.binary())])


def _segment(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"branch": key[0], "segment": key[1], "counts": total.tobytes()}], schema=_COUNTS)


def align(
    df: DataFrame, description: str, model: bytes, text: str = "text", keep: list[str] | None = None, digest: bool = False,
) -> DataFrame:
    """The ``keep`` columns (all by default) with n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id;
    ``count_sum`` sums the documents of their pairs over links. With ``digest`` groups become
    ``groups_sha256``.
    """
    spark = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ADDED]
    both = Vocabularies(description, model)
    stored = tokenized(df, text, description, model, keep)
    docs, shape = stored.where("id is not null").select("row", "id", "a", "b"), both.shape
    shared = spark.sparkContext.broadcast(Shared(both.a_sizes, both.b_sizes))
    pairs = materialize(stored.where("pairs is not null").select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    slices = max(1, -(-pairs.count() // SLICE_PAIRS))
    hashes = hashed_slices(pairs, slices)
    best = np.zeros(shape[0], np.int64)
    counted: list[DataFrame] = []

    def lookup(number: int) -> Lookup:
        row = hashes.where(F.col("slice") == number).first()
        own = PerfectHash(np.zeros(0, "<u8"), [], np.zeros(0, np.int64))
        if row is not None:
            own = PerfectHash(np.frombuffer(row["words"], "<u8"), list(row["sizes"]), np.frombuffer(row["keys"], np.int64))
        counts = np.zeros(len(own.keys), np.int64)
        if number < len(counted):
            for piece in counted[number].select("segment", "counts").collect():
                start = piece["segment"] * SEGMENT
                counts[start : start + SEGMENT] = np.frombuffer(piece["counts"], np.int64)
        return Lookup(number, slices, own, counts)

    for number in range(slices):
        found = spark.sparkContext.broadcast(lookup(number))
        counted.append(summed_counts(docs, shared, found))
        found.unpersist()
        own = lookup(number)
        np.maximum.at(best, own.hash.keys // shape[1], own.counts)
    parts = []
    for number in range(slices):
        found = spark.sparkContext.broadcast((lookup(number), best))
        parts.append(_looked_up(docs if number == 0 else docs.select("id", "a", "b"), shared, found, number == 0, digest))
    if slices == 1:
        return parts[0].select("row.*", *_columns(digest))
    totals = parts[0].select("id", "n_best", "count_sum")
    for part in parts[1:]:
        totals = totals.unionByName(part)
    totals = totals.groupBy("id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return parts[0].drop("n_best", "count_sum").join(totals, "id").select("row.*", *_columns(digest))


def _columns(digest: bool) -> list[str]:
    return [*ADDED[:6], ADDED[7] if digest else ADDED[6]]


def standing(lookup: Lookup, best: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The count of each link's pair, and whether it is its A id's highest; 0 and False in other slices.

    Pairs repeat, so each is looked up once.
    """
    pairs, of = np.unique(key, return_inverse=True)
    place = lookup.places(pairs)
    here = place >= 0
    count = np.zeros(len(pairs), np.int64)
    count[here] = lookup.counts[place[here]]
    return count[of], (here & (count == best[pairs // width]))[of]


def _looked_up(docs: DataFrame, shared, found, whole: bool, digest: bool) -> DataFrame:
    """Links of one slice in its counts; with ``whole`` the other columns too."""
    fields = [T.StructField("id", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    if whole:
        fields = [
            docs.schema["row"], *fields, *(T.StructField(n, T.LongType()) for n in ADDED[:4]),
            T.StructField(_columns(digest)[-1], T.StringType()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (lookup, best) = shared.value, found.value
        strings = held(("strings", own.shape), lambda: group_strings(own.shape)) if whole else []
        for batch, part in own.parts(batches):
            n = batch.num_rows
            n_best, total, n_links = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, key in part.links(own.shape[1]):
                count, is_best = standing(lookup, best, key, own.shape[1])
                np.add.at(total, doc, count)
                n_best += np.bincount(doc[is_best], minlength=n)
                n_links += np.bincount(doc, minlength=n)
            out = {"id": batch.column("id"), "n_best": n_best, "count_sum": total}
            if whole:
                texts = part.texts(strings, own.shape)
                if digest:
                    texts = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                out = {
                    "row": batch.column("row"), **out, "n_a": part.n_a, "n_b": part.n_b, "n_groups": part.n_groups.astype(np.int64),
                    "n_links": n_links, _columns(digest)[-1]: pa.array(texts, pa.string()),
                }
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, T.StructType(fields))


BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op12_token_alignment")
def _align(spark, folder):
    """Every document aligned, and how its links stand in the counts of the corpus."""
    with open(BYTE_LEVEL, encoding="utf-8") as file:
        description = file.read()
    with open(PIECES, "rb") as file:
        model = file.read()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return align(docs, description, model, keep=["doc_id"], digest=True)
