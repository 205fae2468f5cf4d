"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two sets link
when their Jaccard similarity is at least 0.75, so they differ in at most a seventh of the sum
of their sizes. Sizes are cut into bands, each up to 4/3 times its least size: a pair's larger
set lies in the smaller one's band or the next, and the smaller one's band bounds how many
elements the pair differs in. For that bound k the domain of hashes is cut into n1 groups of
n2 partitions, with so many groups that some group holds at most k2 of the differences: then
some n2 - k2 of its partitions are equal in both sets. A signature is the content of such a
subset of partitions; similar sets share one. A set has signatures for its own band and the
one before.

A subset of empty partitions says nothing, and is left out unless a set has so many of them
that every group a pair must agree in could hold one; then it counts like any other.

Signatures go to their partition packed in arrays, a set's from each task once. Sets that
share a signature are a bucket. A similar pair agrees in a known number of groups, so a set
that shares fewer signatures with any others can't be similar to one and leaves its buckets:
that is what most documents do that only share a passage. Buckets are then answered exactly
without comparing all pairs:

1. Every member is compared with the least one of all its buckets, and links are joined to
   components.
2. In buckets that still span several components, members are compared across components by
   parity sketches: bit h mod m of a sketch is the parity of the elements that fall on it, so
   two sets differ in at least as many elements as their sketches in bits. Large buckets are
   compared in pairs of blocks, so no task holds more than two blocks. Of the pairs that
   sketches can't rule out, the closest of each member are verified first, and components are
   joined again.
3. Members that may still be similar to one of another component meet again with their
   shingles. All such pairs are verified where they meet, and only links that join components
   leave the task, so pairs inside a group of copies are never listed.

Equal sets are one member throughout. Null documents ids link with nothing, nor do empty and
null texts; fewer than five words are one shingle. Sets count as equal when their 64-bit
hashes and sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, packed, query, table, unpacked
from tidegauge.llm.components import components
from tidegauge.llm.memory import held

SHINGLE = 5
# The similarity is SHARE / WHOLE.
SHARE, WHOLE = 75, 100
# Words, or sets, that a worker remembers: some 20 MB.
REMEMBERED = 120_000
# Signatures a task holds before it sends them on, and members of a bucket compared at once.
HELD = 1 << 20
BLOCK = 1024
CLOSEST = 2
NEVER = 1 << 30
# Of a member's buckets, how many go along with it.
KNOWN_BUCKETS = 16
# Shingles of the sets that are verified in one block.
BLOCK_SHINGLES = 500_000
_U = np.uint64


# -- sets ------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words, remembered as long as they take few bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        own = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = own
        return own


_FACTORS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    own = np.fromiter(map(held("shingles", Words).__getitem__, words), np.uint64, len(words))
    n = len(own) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(_FACTORS):
        total += own[k : k + n] * _U(factor)
    return np.unique(_mix(total))


def set_id(own: np.ndarray) -> int:
    """A set's identity, as a signed number."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * shared >= SHARE * (len(a) + len(b) - shared)


# -- signatures ------------------------------------------------------------------------


@lru_cache(None)
def bands(limit: int) -> tuple[tuple[int, int], ...]:
    """Least and greatest size of each band, up to the one that holds ``limit``."""
    out, low = [], 1
    while low <= limit:
        high = low * WHOLE // SHARE
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(None)
def scheme(high: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 for a band, and in how many groups at least a similar pair agrees."""
    # Sizes a <= b of a pair: a <= high and b <= a / 0.75.
    differ = (high + high * WHOLE // SHARE) * (WHOLE - SHARE) // (WHOLE + SHARE)
    if differ == 0:
        n1, n2, k2 = 1, 1, 0
    elif differ <= 5:
        n1, n2, k2 = 1, differ + 3, differ
    elif differ <= 24:
        n1, n2, k2 = differ // 2 + 1, 4, 1
        n1 += max(1, n1 // 5)
    else:
        n1, n2, k2 = differ + 1 + differ // 4, 1, 0
    return n1, n2, k2, n1 - differ // (k2 + 1)


def signatures(own: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The signatures of a set, in its own band and the one before.

    The lowest bit is the parity of the band. Also, for each parity, how many signatures at
    least a similar set shares; NEVER where the set has no such band.
    """
    size, need = len(own), [NEVER, NEVER]
    if not size:
        return np.zeros(0, np.uint64), need
    known = bands(1 << max(10, size.bit_length() + 1))
    at = next(i for i, (_, high) in enumerate(known) if size <= high)
    out = []
    for level in range(max(0, at - 1), at + 1):
        found, need[level & 1] = _of_band(own, level, known[level][1])
        out.append(found & ~_U(1) | _U(level & 1))
    return np.concatenate(out), need


def _of_band(own: np.ndarray, level: int, high: int) -> tuple[np.ndarray, int]:
    n1, n2, k2, agree = scheme(high)
    parts = n1 * n2
    # Partitions are ranges of the hash, so a sorted set is cut into slices.
    edges = np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)
    cuts = np.concatenate([[0], np.searchsorted(own, edges.astype(np.uint64)), [len(own)]])
    sums = np.concatenate([[_U(0)], np.cumsum(_mix(own ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    content, counts = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(n1, n2), np.diff(cuts).reshape(n1, n2)
    out, empty = [], []
    for k, subset in enumerate(combinations(range(n2), n2 - k2)):
        chosen = content[:, subset].sum(axis=1, dtype=np.uint64)
        first = (level * 1_000_003 + k * 7_919) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        salt = np.arange(n1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + _U(first)
        out.append(_mix(chosen ^ _mix(salt)))
        empty.append(counts[:, subset].sum(axis=1) == 0)
    found, none = np.stack(out, axis=1), np.stack(empty, axis=1)
    vain = int(none.any(axis=1).sum())
    if vain < agree:
        return found[~none], agree - vain
    return found.ravel(), agree


# -- buckets ---------------------------------------------------------------------------

_ROW = {"doc": pa.int64(), "size": pa.int64(), "own": pa.int64(), "sketch": pa.binary(), "need0": pa.int64(), "need1": pa.int64()}
_ROW_DDL = "doc long, size long, own long, sketch binary, need0 long, need1 long"
_SENT = f"slot int, {_ROW_DDL}, prints binary, owners binary"
_FOUND = f"{_ROW_DDL}, members array<long>, shared0 long, shared1 long"


def _send(slots: int):
    """Documents to packed signatures for each slot, and a row of each document's size and set."""

    def packed(prints: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        lengths = [len(p) for p in prints]
        own, by = np.concatenate(prints), np.repeat(np.array(owners, np.int64), lengths)
        slot = (own >> _U(33)).astype(np.int64) % slots
        order = np.argsort(slot, kind="stable")
        own, by, slot = own[order], by[order], slot[order]
        firsts = np.searchsorted(slot, np.arange(slots + 1))
        used = [k for k in range(slots) if firsts[k] < firsts[k + 1]]
        n = len(used)
        return pa.RecordBatch.from_pydict(
            {"slot": pa.array(used, pa.int32())}
            | {name: pa.nulls(n, kind) for name, kind in _ROW.items()}
            | {"prints": pa.array([own[firsts[k] : firsts[k + 1]].tobytes() for k in used], pa.binary())}
            | {"owners": pa.array([by[firsts[k] : firsts[k + 1]].tobytes() for k in used], pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, owners, held, seen, spread = [], [], 0, set(), 0
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in _ROW}
            for doc, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                own = shingles(text)
                mark = set_id(own) if len(own) and doc is not None else None
                row = (doc, len(own), mark, None, None, None)
                if mark is not None and mark not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()  # described once more: no harm
                    seen.add(mark)
                    found, need = signatures(own)
                    row = (doc, len(own), mark, sketch(own), *need)
                    prints.append(found)
                    owners.append(mark)
                    held += len(found)
                for name, value in zip(_ROW, row, strict=True):
                    rows[name].append(value)
                if held >= HELD:
                    yield packed(prints, owners)
                    prints, owners, held = [], [], 0
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {"slot": ((np.arange(n) + spread) % slots).astype(np.int32)}
                | {name: pa.array(rows[name], kind) for name, kind in _ROW.items()}
                | {"prints": pa.nulls(n, pa.binary()), "owners": pa.nulls(n, pa.binary())}
            )
            spread += n
        if prints:
            yield packed(prints, owners)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of documents as they are, then the members of every signature with several sets.

    Many signatures have the same members; a list of members comes once, with the number of
    its signatures of either parity.
    """
    prints, owners = [], []
    more = {"members": pa.list_(pa.int64()), "shared0": pa.int64(), "shared1": pa.int64()}
    schema = pa.schema([*_ROW.items(), *more.items()])
    for batch in batches:
        packed = batch.filter(pc.is_valid(batch.column("prints")))
        prints += [np.frombuffer(x, np.uint64) for x in packed.column("prints").to_pylist()]
        owners += [np.frombuffer(x, np.int64) for x in packed.column("owners").to_pylist()]
        rows = batch.filter(pc.is_null(batch.column("prints")))
        yield pa.RecordBatch.from_arrays(
            [rows.column(n) for n in _ROW] + [pa.nulls(rows.num_rows, k) for k in more.values()], schema=schema
        )
    if not prints:
        return
    own, by = np.concatenate(prints), np.concatenate(owners)
    del prints, owners
    order = np.argsort(own, kind="stable")
    own, by = own[order], by[order]
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    several = np.flatnonzero(np.diff(edges) > 1)
    lists: dict[bytes, list[int]] = {}
    for first, last in zip(edges[several].tolist(), edges[several + 1].tolist(), strict=True):
        members = np.unique(by[first:last])
        if len(members) > 1:
            lists.setdefault(members.tobytes(), [0, 0])[int(own[first]) & 1] += 1
    found = list(lists.items())
    for start in range(0, len(found), 512):
        part = found[start : start + 512]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(part), k) for k in _ROW.values()]
            + [pa.array([np.frombuffer(m, np.int64) for m, _ in part], pa.list_(pa.int64()))]
            + [pa.array([n[parity] for _, n in part], pa.int64()) for parity in (0, 1)],
            schema=schema,
        )


# -- verifying -------------------------------------------------------------------------


def _sets(needed: DataFrame, docs: DataFrame, light: DataFrame) -> DataFrame:
    """Stored: ``own`` and the ``shingles`` of the sets in ``needed`` (own), by a document of each."""
    wanted = light.join(needed.distinct(), "own", "left_semi").select("own", F.col("doc").alias("doc_id"))
    wanted = materialize(wanted, "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets, same = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                # A repeated document id may bring other sets, and one set often.
                found = shingles(text) if own not in seen else None
                same.append(found is not None and set_id(found) == own)
                sets.append(found.tobytes() if same[-1] else None)
                if same[-1]:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
            yield pa.RecordBatch.from_pydict(
                {"own": batch.column("own"), "shingles": pa.array(sets, pa.binary())}
            ).filter(pa.array(same, pa.bool_()))

    found = docs.join(wanted, "doc_id").select("own", "text").mapInArrow(cut, "own long, shingles binary")
    # Several tasks may bring one set.
    return materialize(found, "sets").dropDuplicates(["own"])


def _verified(pairs: DataFrame, docs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by the shingles of a document of each."""
    pairs = materialize(pairs, "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("own")), docs, light)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = sets.select(F.col("own").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("own").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sketch_bits(size: int) -> int:
    """Bits of a set's sketch: about four for each element that a similar set may differ in."""
    return 1 << max(6, (4 * size // 3).bit_length())


def sketch(own: np.ndarray) -> bytes:
    bits = _sketch_bits(len(own))
    return np.packbits(np.bincount((own & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width; a narrower sketch is the exclusive or of a wider one's parts."""
    out = np.zeros((len(sketches), width), np.uint8)
    for i, own in enumerate(sketches):
        own = np.frombuffer(own, np.uint8)
        out[i] = own if len(own) == width else np.bitwise_xor.reduce(own.reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that sketches don't rule out."""
    for batch in batches:
        bound = (batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()) * (WHOLE - SHARE) // (WHOLE + SHARE)
        left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        keep = []
        for x, y, most in zip(left, right, bound.tolist(), strict=True):
            a, b = _folded([x, y], min(len(x), len(y)))
            keep.append(int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= most)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray], Iterator]]:
    """Bucket, members and, for each member of the left block, its row and those of the right
    block of other components that sketches don't rule out, with the bits they are apart."""
    for batch in batches:
        lists = batch.column("members")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        names = [f.name for f in flat.type if f.name not in ("sketch", "shingles", "buckets")]
        columns = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in names}
        for row, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = {n: c[first:last] for n, c in columns.items()}
            if "shingles" in {f.name for f in flat.type}:
                own["shingles"] = flat.field("shingles")[first:last].to_pylist()
            if "buckets" in {f.name for f in flat.type}:
                cuts, values = flat.field("buckets").offsets.to_numpy(), flat.field("buckets").values.to_numpy()
                own["buckets"] = [values[a:b] for a, b in zip(cuts[first:last], cuts[first + 1 : last + 1], strict=True)]
            sketches = flat.field("sketch")[first:last].to_pylist()
            left, right = np.flatnonzero(own["side"] != 1), np.flatnonzero(own["side"] != 0)

            def pairs(own=own, sketches=sketches, left=left, right=right):
                if not len(left) or not len(right):
                    return
                folded = _folded(sketches, min(map(len, sketches)))
                across = folded[right]
                for i in left.tolist():
                    apart = np.bitwise_count(folded[i] ^ across).sum(axis=1, dtype=np.int64)
                    bound = (own["size"][i] + own["size"][right]) * (WHOLE - SHARE) // (WHOLE + SHARE)
                    near = np.flatnonzero((apart <= bound) & (own["root"][right] != own["root"][i]))
                    if len(near):
                        yield i, right[near], apart[near]

            yield batch.column("bucket")[row].as_py(), own, pairs()


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member the nearest few of other components, each member in one bucket."""
    for _, own, pairs in _possible(batches):
        found: set[tuple[int, int]] = set()
        for i, near, apart in pairs:
            if own["lead"][i]:
                for j in near[np.argsort(apart, kind="stable")[:CLOSEST]].tolist():
                    found.add((min(own["own"][i], own["own"][j]), max(own["own"][i], own["own"][j])))
        if found:
            a, b = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that may still be similar to one of another component in their bucket.

    Two members may share many buckets; a pair that is known to share a lesser one counts
    there. Of a member's buckets only the least few are known, so a pair may count twice, but
    never nowhere.
    """
    for bucket, own, pairs in _possible(batches):
        found, sizes = np.zeros(len(own["own"]), bool), np.array([len(x) for x in own["buckets"]])
        for i, near, _ in pairs:
            mine = own["buckets"][i]
            theirs = np.concatenate([own["buckets"][j] for j in near.tolist()])
            shared = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            least = np.minimum.reduceat(np.where(shared, theirs, np.iinfo(np.int64).max), np.cumsum(sizes[near]) - sizes[near])
            near = near[least >= bucket]
            if len(near):
                found[i] = True
                found[near] = True
        if found.any():
            yield pa.RecordBatch.from_pydict({"bucket": np.full(int(found.sum()), bucket), "own": own["own"][found]})


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of a pair of blocks as all its links do, by their shingles."""
    for _, own, pairs in _possible(batches):
        parent = {r: r for r in own["root"].tolist()}

        def top(r: int, parent=parent) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        sets = [np.frombuffer(x, np.uint64) for x in own["shingles"]]
        sizes = np.array([len(x) for x in sets])
        found = []
        for i, near, _ in pairs:
            here = top(int(own["root"][i]))
            near = near[[top(r) != here for r in own["root"][near].tolist()]]
            if not len(near):
                continue
            theirs = np.concatenate([sets[j] for j in near.tolist()])
            # Shingles of all that are near, looked up in the member's own sorted ones.
            at = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
            shared = np.add.reduceat(sets[i][at] == theirs, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            for j in near[WHOLE * shared >= SHARE * (sizes[i] + sizes[near] - shared)].tolist():
                a, b = top(int(own["root"][i])), top(int(own["root"][j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((own["own"][i], own["own"][j]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _placed(member: DataFrame, roots: DataFrame, light: DataFrame) -> DataFrame:
    """bucket, own, size and root of the members of buckets that span several components; stored.

    These rows are narrow: what a member is compared by joins them last.
    """
    placed = member.join(roots, F.col("own") == F.col("node"), "left").select(
        "bucket", "own", F.coalesce("root", "own").alias("root")
    )
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialize(placed.join(mixed.select("bucket"), "bucket").join(light.select("own", "size"), "own"), "placed")


def _block_pairs(placed: DataFrame, weight: str, block: int, facts: DataFrame) -> DataFrame:
    """A row for each two blocks of a bucket's members, which are cut at ``block`` times ``weight``."""
    cut = placed.groupBy("bucket").agg(F.sum(F.expr(weight)).alias("n")).selectExpr("bucket", f"(n + {block - 1}) div {block} AS blocks")
    own = F.expr("pmod(xxhash64(own), blocks)")
    # A member meets its own block once (side 2), later blocks as left (0), earlier ones as right (1).
    sides = F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, own).alias("i"), F.greatest(k, own).alias("j"),
            F.when(k == own, 2).when(k > own, 0).otherwise(1).alias("side"),
        ),
    ))
    spread = placed.join(cut, "bucket").withColumn("s", sides)
    carried = [c for c in placed.columns if c != "bucket"] + ["s.side"] + [c for c in facts.columns if c != "own"]
    return spread.join(facts, "own").groupBy("bucket", "s.i", "s.j").agg(
        F.collect_list(F.struct(*carried)).alias("members")
    ).select("bucket", "members")


def _nearest_pairs(placed: DataFrame, light: DataFrame) -> DataFrame:
    """Candidate pairs of different components: the nearest few of each member."""
    lead = F.col("bucket") == F.min("bucket").over(W.partitionBy("own"))
    facts = light.select("own", "sketch")
    return _block_pairs(placed.withColumn("lead", lead), "1", BLOCK, facts).mapInArrow(_closest, "a long, b long").distinct()


def _remaining_links(placed: DataFrame, light: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join the components left over. Members that may have one are found by their
    sketches and then compared exactly, where they meet, by their shingles."""
    lists = placed.groupBy("own").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, KNOWN_BUCKETS).alias("buckets"))
    facts = materialize(light.select("own", "sketch").join(lists, "own"), "open-facts")
    left = _block_pairs(placed, "1", BLOCK, facts).mapInArrow(_open, "bucket long, own long").distinct()
    left = materialize(left, "open")
    sets = _sets(left.select("own"), docs, light).join(light.select("own", "sketch"), "own")
    return _block_pairs(placed.join(left, ["bucket", "own"]), "size", BLOCK_SHINGLES, sets).mapInArrow(_linking, "a long, b long")


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the least ``doc_id`` reachable by links, null for a null ``doc_id``.
    Other columns of ``docs`` are ignored.
    """
    slots = _slots(docs)
    own = docs.select("doc_id", "text")
    found = materialize(
        own.mapInArrow(_send(8 * slots), _SENT).repartition(slots, "slot").drop("slot").mapInArrow(_gather, _FOUND),
        "buckets",
    )
    rows = found.where("members IS NULL").select("doc", "size", "own")
    facts = F.struct("doc", "size", "sketch", "need0", "need1")
    # Every task describes a set once, so one of its rows at least has a sketch.
    described = found.where("members IS NULL AND sketch IS NOT NULL").groupBy("own").agg(F.min(facts).alias("x"))
    light = materialize(described.select("own", "x.*"), "set-facts")

    buckets = materialize(
        found.where("members IS NOT NULL").groupBy("members").agg(F.sum("shared0").alias("s0"), F.sum("shared1").alias("s1")),
        "distinct-buckets",
    )
    exploded = buckets.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("own"), "s0", "s1")
    shared = exploded.groupBy("own").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    kept = shared.join(light, "own").where("s0 >= need0 OR s1 >= need1").select("own")
    member = materialize(exploded.join(kept, "own", "left_semi").select("bucket", "own"), "members")

    least = member.groupBy("bucket").agg(F.min("own").alias("a"))
    hubs = member.join(least, "bucket").where("own <> a").groupBy("own").agg(F.min("a").alias("a"))
    sketched = (
        hubs.select("a", F.col("own").alias("b"))
        .join(light.select(F.col("own").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("size_a")), "a")
        .join(light.select(F.col("own").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("size_b")), "b")
    )
    links = materialize(_verified(sketched.mapInArrow(_plausible, "a long, b long"), own, light), "star-links")
    roots = components(links)
    for step in ("nearest", "remaining"):
        if step == "nearest":
            more = _verified(_nearest_pairs(_placed(member, roots, light), light), own, light)
        else:
            more = _remaining_links(_placed(member, roots, light), light, own)
        links = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "cross-links")
        roots = components(links)

    least = rows.where("own IS NOT NULL").groupBy("own").agg(F.min("doc").alias("doc"))
    grouped = least.join(roots, F.col("own") == F.col("node"), "left").select(
        "own", "doc", F.coalesce("root", "own").alias("root")
    )
    first = grouped.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = grouped.join(first, "root").select("own", "component_id")
    return rows.join(named, "own", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row, the first of those of the least id, of each group of ``docs``; rows with a null id stay.

    The join sees stored row numbers as ids, so rows of one id with different texts are told apart.
    """
    numbered = materialize(packed(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = join_documents(numbered.select(F.col("row").alias("doc_id"), "text"))
    placed = numbered.where("doc_id IS NOT NULL").select("row", "doc_id").join(
        groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "row"
    )
    first = placed.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
    gone = placed.join(first.where("rows > 1"), "group").where("row <> first.row").select("row")
    return unpacked(numbered.join(gone, "row", "left_anti"), docs.columns, "doc_id", "text")


@query("op5_partenum_join")
def _join(spark, folder):
    """The group of near-equal documents that every document belongs to."""
    return join_documents(table(spark, folder, "documents"))
