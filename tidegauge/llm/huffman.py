"""Token ids in canonical length-limited Huffman files.

The code is built from the counts of all ids: lengths of at most LIMIT bits come from
package-merge, and codes are canonical, so a file needs only the lengths. LIMIT bits allow
65,536 different ids in one corpus; writing more is refused. A file holds the ids of a run of
documents in ascending order as one bit stream, cut into blocks of BLOCK ids that decode on
their own: a checkpoint gives each block's first bit. A decoder looks LIMIT bits up in a
table that gives the id and its length, and steps through all blocks of a file side by side.

Documents are range-partitioned by id before they are encoded, ties by a hash of the text, so
a repeated id is split too; a file's place is (partition, number within it). Texts are
tokenized once: the ids of each file-to-be are a row of a stored table, from which they are
counted and then coded, so neither step shuffles. Where a document's ids start follows from
the totals of the files before it, which are read back: one number per file. Only the counts,
bounded by the vocabulary, pass through the driver.

Null and empty texts have the end id alone. Null document ids come first. An empty table
gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, new_path, query, table
from tidegauge.llm.blobs import read_files, write_files
from tidegauge.llm.byte_bpe import ByteBpe
from tidegauge.llm.memory import held

LIMIT = 16
BLOCK = 1024
FILE_IDS = 1 << 21
MAGIC, ENDING = b"HUFIDS01", b"HEND"
_HEAD = struct.Struct("<8sIIQIIII")  # magic, partition, number, ids, block, and sizes of the three tables


# -- the code --------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    items, leaf_flags = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([weights, pairs])
        place = np.argsort(joined, kind="stable")
        items = joined[place]
        leaf_flags.append(place < n)
    taken, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:taken].sum())
        depth[:leaves] += 1
        taken = 2 * (taken - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        steps = 1 << (LIMIT - lengths[order].astype(np.int64))
        codes[order] = (np.cumsum(steps) - steps) >> (LIMIT - lengths[order].astype(np.int64))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT bits, the id that they begin with and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << LIMIT, np.int64), np.ones(1 << LIMIT, np.int64)
    total = int(spans.sum())
    ids[:total], sizes[:total] = np.repeat(order, spans), np.repeat(lengths[order].astype(np.int64), spans)
    return ids, sizes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids``, and the first bit of every block."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    # A code of up to 16 bits from any bit of a 32-bit word ends within the next word. Every word
    # of the stream has a code that starts in it, so those of one word are a run of values.
    word = starts >> 5
    values = codes[ids].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
    runs = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.bitwise_or.reduceat(values, runs) if len(ids) else np.zeros(0, np.uint64)
    stream = np.zeros(len(both) + 1, np.uint64)
    stream[:-1] = both >> np.uint64(32)
    stream[1:] |= both & np.uint64(0xFFFFFFFF)
    return stream.astype(">u4").tobytes()[: (total + 7) // 8 + 3].ljust((total + 7) // 8 + 3, b"\0"), starts[::block].copy()


def unpack(
    stream: bytes, checkpoints: np.ndarray, total: int, lengths: np.ndarray, block: int = BLOCK
) -> np.ndarray:
    """All ids of a file, every block from its checkpoint, all blocks step by step."""
    ids, sizes = decoding_table(lengths)
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at, out = checkpoints.astype(np.int64), np.zeros((block, len(checkpoints)), np.int64)
    last = len(words) - 1
    for step in range(min(block, total)):
        window = words[np.minimum(at >> 3, last)] >> (8 - (at & 7)) & 0xFFFF
        out[step] = ids[window]
        at = at + sizes[window]
    return out.T.reshape(-1)[:total]


# -- files -----------------------------------------------------------------------------


def _squeeze(ids: bytes) -> bytes:
    """Packed ids as compressed byte planes, so a stored table of them is about as small as the files."""
    planes = np.frombuffer(ids, np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _file(
    partition: int, number: int, keys: list[int | None], sizes: list[int], ids: np.ndarray, lengths, codes
) -> bytes:
    """One file, without the last four bytes, which the writer of files adds."""
    stream, checkpoints = pack(ids, lengths, codes)
    table = zlib.compress(lengths.tobytes())
    known = np.array([k is not None for k in keys], np.uint8).tobytes()
    docs = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(sizes, "<u4").tobytes()
    docs = zlib.compress(known + docs)
    points = zlib.compress(checkpoints.astype("<u8").tobytes())
    head = _HEAD.pack(MAGIC, partition, number, len(ids), BLOCK, len(table), len(docs), len(points))
    return head + table + docs + points + stream


def _parse(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """Partition, number, document ids, their id counts, and all ids of a file."""
    magic, partition, number, total, block, *sizes = _HEAD.unpack_from(data)
    if magic != MAGIC or not data.endswith(ENDING):
        raise ValueError("not a whole file of ids")
    at, tables = _HEAD.size, []
    for size in sizes:
        tables.append(zlib.decompress(data[at : at + size]))
        at += size
    lengths, docs, points = tables
    n = len(docs) // 13
    known, keys = np.frombuffer(docs, np.uint8, n), np.frombuffer(docs, "<i8", n, n)
    counts = np.frombuffer(docs, "<u4", n, 9 * n).astype(np.int64)
    ids = unpack(data[at:-4], np.frombuffer(points, "<u8"), total, np.frombuffer(lengths, np.uint8), block)
    return partition, number, [int(k) if x else None for k, x in zip(keys, known, strict=True)], counts, ids


# -- Spark -----------------------------------------------------------------------------

def _encoder(description: str) -> ByteBpe:
    """One tokenizer per Python worker."""
    return held(("byte_bpe", description), lambda: ByteBpe(description))


def _chunks(docs: DataFrame, description: str, end_id: int) -> DataFrame:
    """The ids of every file to be, in ascending order of ``doc_id``: each text is tokenized here, once."""
    shared = docs.sparkSession.sparkContext.broadcast(description)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, partition = _encoder(shared.value), TaskContext.get().partitionId()
        keys, sizes, parts, size, number = [], [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "partition": pa.array([partition], pa.int32()), "number": pa.array([number], pa.int32()),
                "keys": pa.array([keys], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "ids": pa.array([_squeeze(np.concatenate(parts).astype("<u4").tobytes())], pa.binary()),
            })

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column("text"))
            for key, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                keys.append(key)
                parts += [own.encode([text])[0], end]
                sizes.append(len(parts[-2]) + 1)
                size += sizes[-1]
                if size >= FILE_IDS:
                    yield chunk()
                    keys, sizes, parts, size, number = [], [], [], 0, number + 1
        if keys:
            yield chunk()

    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ddl = "partition int, number int, keys array<long>, sizes array<long>, ids binary"
    return materialize(ordered.mapInArrow(run, ddl), "chunks")


def count_ids(chunks: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                counts += np.bincount(_unsqueeze(data), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int32), "n": counts[used]})

    totals = chunks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in totals.collect():  # a row per id of the vocabulary at most
        counts[row["id"]] = row["n"]
    return counts


def write_ids(docs: DataFrame, folder: str, description: str, end_id: int = 0) -> None:
    """Write the ids of every row's ``text``, ``end_id`` after each, in ascending ``doc_id`` order.

    ``description`` is the JSON of a tokenizers vocabulary.
    """
    import tokenizers

    vocabulary = tokenizers.Tokenizer.from_str(description).get_vocab_size()
    chunks = _chunks(docs.select("doc_id", "text"), description, end_id)
    lengths = code_lengths(count_ids(chunks, vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = _unsqueeze(row["ids"])
                yield _one(_file(row["partition"], row["number"], row["keys"], row["sizes"], ids, lengths, codes))

    write_files(chunks.mapInArrow(run, "file binary"), "file", folder, ENDING)


def _one(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array([data], pa.binary())})


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, and ``ids`` (packed) or with ``digest`` their ``ids_crc32``.

    ``start`` counts the ids of all documents before, in all files.
    """
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                partition, number, keys, counts, ids = _parse(data)
                starts = np.cumsum(counts) - counts
                packed = ids.astype("<u4").tobytes()
                own = [packed[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                values = pa.array(map(zlib.crc32, own), pa.int64()) if digest else pa.array(own, pa.binary())
                whole = pa.RecordBatch.from_pydict({
                    "partition": np.full(len(keys), partition, np.int32), "number": np.full(len(keys), number, np.int32),
                    "doc_id": pa.array(keys, pa.int64()), "place": starts, "n_tokens": counts, last.split()[0]: values,
                })
                for at in range(0, whole.num_rows, 512):
                    yield whole.slice(at, 512)

    ddl = f"partition int, number int, doc_id long, place long, n_tokens long, {last}"
    rows = materialize(read_files(spark, folder).mapInArrow(run, ddl), "ids")
    files = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("partition").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    partitions = files.groupBy("partition").agg(F.sum("n").alias("n")).select(
        "partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    earlier = W.partitionBy("partition").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("partition", "number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("within"))
    bases = bases.join(partitions, "partition").select("partition", "number", (F.col("base") + F.col("within")).alias("base"))
    return rows.join(bases, ["partition", "number"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", last.split()[0]
    )


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query("op8_huffman_ids")
def _ids(spark, folder):
    """The ids of all documents, written to files and read back."""
    with open(VOCABULARY, encoding="utf-8") as file:
        description = file.read()
    files = new_path(spark, "ids")
    write_ids(table(spark, folder, "documents"), files, description)
    return read_ids(spark, files, digest=True)
