"""Toxicity by compression distance.

Two Zstandard dictionaries are made: one trained on ordinary text, and the same one with toxic
wording behind it. Windows of a text are compressed with both; what the toxic wording saves is
evidence. Bytes that match nothing stand in the ordinary dictionary for the wording, so matches
before it lie equally far in both and cost the same. How much likelier a saving is on windows
of toxic texts than of ordinary ones is learnt, never falling as the saving grows; a text's
evidence is the sum of the logarithms over its windows, so two weak signs count more than one
and long ordinary texts gain nothing by chance. Calibration turns it into a probability: the
share of toxic labels at that evidence, pooled until it never falls. Of the lengths in MATCHES
the least one that a match may have is that which tells the learnt texts apart best.

Toxic texts are mostly ordinary wording, on which dictionary training by frequency would
spend the toxic dictionary. So its content is what tells the classes apart: the words and
beginnings of words whose document frequency among toxic texts exceeds that among ordinary ones
by a likelihood ratio that chance doesn't give among that many, the strongest of them if they
are more than TOXIC_BYTES. Near copies would count one text many times, so documents count once
per minimum hash of their shingles. Words are lower-case and end at blanks and ASCII punctuation.

Labels are learnt from a bounded sample: rows are drawn by a hash of their id with the
probability that gives SAMPLE_ROWS per class on average. Every text is scored whole, in
windows; scoring shuffles nothing.

Null and empty texts score as texts with the least evidence. Rows whose label or id is null are not
learnt from; of several labels of an id each counts. Without toxic or without ordinary labels
the share of toxic labels is the score of every text, or 0. All columns pass through;
``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.base import held_out, query, table
from tidegauge.llm.langid import sample

SAMPLE_ROWS = 2000
WINDOW_WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 12_288, 4_096
THRESHOLD = 0.3
# Least lengths of a match to choose from, and bytes of the beginnings of words that are looked at.
MATCHES = (4, 5, 6)
BEGINNINGS = range(4, 17)
# Steps of evidence that calibration tells apart: half a nat each.
STEPS = 2
# The sample of one class in the driver's memory: texts beyond it leave the sample whole.
SAMPLE_BYTES = 24 << 20


_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")


def _words(text: bytes) -> list[bytes]:
    return _PUNCTUATION.sub(b" ", text.lower()).split()


def windows(text: bytes) -> list[bytes]:
    """Runs of WINDOW_WORDS lower-case words, with a blank at both ends."""
    words = _words(text)
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def distinctive_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words and beginnings of words that toxic texts hold more often than chance would have it, the strongest last.

    Where one begins with another, the stronger stays, of equally strong ones the longer.
    """
    seen: list[dict[bytes, set[int]]] = [defaultdict(set), defaultdict(set)]
    sizes: list[set[int]] = [set(), set()]
    for k, texts in enumerate((ordinary, toxic)):
        for text in texts:
            words = _words(text)
            shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            own = min(map(xxhash.xxh64_intdigest, shingles))
            sizes[k].add(own)
            for w in set(words):
                seen[k][w].add(own)
    n0, n1 = len(sizes[0]), len(sizes[1])

    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0.0)

    strength: dict[bytes, float] = {}

    def judge(found: dict[bytes, set[int]], plain: dict[bytes, set[int]]) -> int:
        for piece, held in found.items():
            a, b = len(held), len(plain.get(piece, ()))
            if a * n0 > b * n1 and a + b < n0 + n1:
                p = (a + b) / (n0 + n1)
                strength[piece] = max(strength.get(piece, 0.0), 2 * (part(a, n1, p) + part(b, n0, p)))
        return len(found)

    tried = judge(seen[1], seen[0])
    for size in BEGINNINGS:
        begun: list[dict[bytes, set[int]]] = [defaultdict(set), defaultdict(set)]
        for k in (1, 0):
            for word, held in seen[k].items():
                # No character is cut.
                if len(word) >= size and (len(word) == size or word[size] & 0xC0 != 0x80) and (k or word[:size] in begun[1]):
                    begun[k][word[:size]] |= held
        tried += judge(begun[1], begun[0])
    least = 2 * math.log(max(2, tried))
    kept: list[bytes] = []
    taken, within = set(), set()
    for piece in sorted((w for w, s in strength.items() if s >= least), key=lambda w: (strength[w], len(w), w), reverse=True):
        beginnings = {piece[:i] for i in range(1, len(piece))}
        if piece not in within and taken.isdisjoint(beginnings):
            kept.append(piece)
            taken.add(piece)
            within |= beginnings
    return kept[::-1]


def _compressor(content: bytes, least: int) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=3, min_match=least, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters)


class Model:
    """Both dictionaries, what the saving on a window tells, and the calibration.

    ``savings`` and ``tells`` are steps and log-likelihood ratios, ``steps`` and ``values`` those of evidence and its shares.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, steps: np.ndarray, values: np.ndarray, least: int = MATCHES[0]):
        self.ordinary, self.toxic, self.steps, self.values, self.least = ordinary, toxic, steps, values, least
        self.savings, self.tells = np.zeros(1, np.int64), np.zeros(1)
        self.compressors = None

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def saved(self, text: bytes) -> np.ndarray:
        """The bytes that the toxic dictionary saves on each window."""
        if not self.toxic:
            return np.zeros(0, np.int64)
        if self.compressors is None:
            contents = self.ordinary + bytes(len(self.toxic)), self.ordinary + self.toxic
            self.compressors = tuple(_compressor(c, self.least) for c in contents)
        plain, toxic = (c.compress for c in self.compressors)
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], np.int64)

    def saving(self, text: bytes) -> int:
        """The most bytes that the toxic dictionary saves on a window; 0 for no window."""
        return int(self.saved(text).max(initial=0))

    def evidence(self, saved: np.ndarray) -> float:
        """What all savings of a text tell, in steps; no window tells least."""
        if not len(saved):
            return -math.inf
        return float(np.floor(STEPS * self.tells[_at(self.savings, saved)].sum()))

    def score(self, text: bytes) -> float:
        return float(self.values[_at(self.steps, self.evidence(self.saved(text)))])


def _at(steps: np.ndarray, values):
    """The last step that is not above each value, or the first one."""
    return np.maximum(0, np.searchsorted(steps, values, "right") - 1)


def _calibrated(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of toxic labels by value, made monotone by pooling neighbours; smoothed by one row."""
    prior = float((labels * weights).sum() / weights.sum())
    steps, own = np.unique(values, return_inverse=True)
    ones, rows = np.bincount(own, labels * weights), np.bincount(own, weights)
    pools: list[list[float]] = []
    for step, one, n in zip(steps.tolist(), ones.tolist(), rows.tolist(), strict=True):
        pools.append([step, one + prior, n + 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _odds(share):
    return np.log(share / (1 - share))


def train(toxic: list[bytes], ordinary: list[bytes], prior: float) -> Model:
    """Dictionaries and calibration from texts of both classes; ``prior`` is the share of toxic rows."""
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(1), np.array([prior]))
    words = distinctive_words(toxic, ordinary)
    content = (b" " + b" ".join(words) + b" ")[-TOXIC_BYTES:] if words else b""
    pieces = [w for t in ordinary for w in windows(t)]
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: take them as they are
        base = b" ".join(pieces)[:ORDINARY_BYTES]
    labels = np.repeat([0, 1], [len(ordinary), len(toxic)])
    # Classes are sampled apart; weigh ordinary rows back to their share.
    weight = (1 - prior) / prior * len(toxic) / len(ordinary) if prior else 1.0
    weights = np.where(labels == 1, 1.0, max(1.0, weight))
    found = []
    for least in MATCHES:
        model = Model(base, content, np.zeros(1), np.array([prior]), least)
        saved = [model.saved(t) for t in (*ordinary, *toxic)]
        if not sum(map(len, saved)):
            return model
        of = np.repeat(labels, list(map(len, saved)))
        # Both classes weigh alike, so that the odds are likelihood ratios.
        alike = np.where(of == 1, max(1, (of == 0).sum()) / max(1, (of == 1).sum()), 1.0)
        model.savings, shares = _calibrated(np.concatenate(saved), of, alike)
        model.tells = _odds(shares)
        evidence = np.array([model.evidence(x) for x in saved])
        model.steps, model.values = _calibrated(evidence, labels, weights)
        share = model.values[_at(model.steps, evidence)]
        bits = -(weights * np.log2(np.where(labels == 1, share, 1 - share))).sum()
        found.append((bits, len(found), model))
    return min(found)[2]


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``labelled`` (doc_id, text, label 0 or 1); ``rows`` bounds the sample of each class."""
    own = labelled.where("doc_id IS NOT NULL AND label IN (0, 1)").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(b"", b"", np.zeros(1), np.zeros(1))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    held: Counter[int] = Counter()
    for row in sample(own, rows).select("label", "text").toLocalIterator():
        text = row["text"].encode()
        if text.split() and held[row["label"]] + len(text) <= SAMPLE_BYTES:
            held[row["label"]] += len(text)
            texts[row["label"]].append(text)
    return train(texts[1], texts[0], sizes.get(1, 0) / sum(sizes.values()))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    kept = [f for f in df.schema if f.name not in ("score", "predicted")]
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = np.array([own.score((t or "").encode()) for t in batch.column(text).to_pylist()], np.float64)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict(
                columns | {"score": found, "predicted": (found >= threshold).astype(np.int32)}
            )

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *added]))


@query("op9_compression_toxicity")
def _toxicity(spark, folder):
    """The toxicity of every document, learnt from three quarters of the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = learn(docs.where(~held_out(F.col("doc_id"))).join(labels, "doc_id"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
