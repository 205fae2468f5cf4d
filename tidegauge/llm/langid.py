"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes
that followed. The probability of a byte in a context is its count over the context's total
plus the number of its distinct followers; what is left is the escape to the context one byte
shorter, down to a uniform choice (escape method C). Statistics are frozen before scoring, so
a text's code length in a language is a sum of table entries: contexts of all trees are rows
of one table, columns are bytes and languages, and a text is scored by array look-ups of its
bytes. The language that codes the text shortest wins.

The trees are learnt from a bounded sample of the labelled texts: rows are drawn by a hash of
their id with the probability that gives SAMPLE_ROWS per language on average; the counts that
this needs cover all rows. The tables are of bounded size (languages, contexts of a bounded
sample) and travel as a broadcast. Scoring reads every text whole and shuffles nothing.

Null texts, and texts without a letter, get ``und`` and score 0. Rows with a null label or id
are not learnt from. Without any label every text is ``und``. All columns pass through;
``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.base import held_out, packed, query, table, unpacked
from tidegauge.llm.memory import release

ORDER = 3
SAMPLE_ROWS = 400
UNKNOWN = "und"
# Characters of one text that are learnt from; all of them are scored.
SAMPLE_CHARS = 1 << 18
# Twice the bits of a byte that nothing is known about: in none of the languages. Sentences of
# everyday English and German cost 8 to 9 bits under trees of other wording, base64 and letters
# of other scripts 16 to 21; of 6,000 documents of check_s none takes over 7.9.
NO_LANGUAGE = 16.0
# Bytes scored at once; a bound for memory, not for texts.
BLOCK = 1 << 20


class Trees:
    """The frozen trees of all languages, as tables."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        data = {name: samples[name] for name in self.languages}
        seen = np.zeros(256, bool)
        for texts in data.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        # One symbol per byte of the sample, one for the start of a text, one for all other bytes.
        self.symbol = np.full(256, 1, np.int32)
        self.symbol[seen] = np.arange(2, 2 + seen.sum())
        self.size = int(seen.sum()) + 2
        counts = [self._counts(texts) for texts in data.values()]
        self._tables(counts)

    def _codes(self, symbols: np.ndarray, order: int) -> np.ndarray:
        """The ``order`` symbols before each, as a number; texts begin with start symbols."""
        code = np.zeros(len(symbols) - self.order, np.int64)
        for back in range(order, 0, -1):
            code = code * self.size + symbols[self.order - back : len(symbols) - back]
        return code

    def _symbols(self, text: bytes) -> np.ndarray:
        own = np.zeros(len(text) + self.order, np.int32)
        own[self.order :] = self.symbol[np.frombuffer(text, np.uint8)]
        return own

    def _counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the codes of (context, byte) and how often they occur."""
        symbols = [self._symbols(t) for t in texts]
        out = []
        for order in range(self.order + 1):
            codes = [self._codes(s, order) * self.size + s[self.order :] for s in symbols]
            out.append(np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True))
        return out

    def _tables(self, counts) -> None:
        size, languages = self.size, len(self.languages)
        # Uniform over 256 bytes, below order 0. Bytes outside the sample are one symbol.
        lower = np.full((1, size, languages), 1 / 256)
        self.rows = []
        parent = np.zeros(1, np.int64)  # row of the shorter context, by code
        for order in range(self.order + 1):
            contexts = np.unique(np.concatenate([c[order][0] // size for c in counts]))
            # The shorter context of a context is its code without the oldest symbol.
            shorter = contexts % max(1, size ** max(0, order - 1)) if order else np.zeros(len(contexts), np.int64)
            base = lower[parent[shorter] if order else np.zeros(len(contexts), np.int64)]
            own = np.empty_like(base)
            for k, c in enumerate(counts):
                codes, times = c[order]
                at = np.searchsorted(contexts, codes // size)
                table = np.zeros((len(contexts), size))
                table[at, codes % size] = times
                total, kinds = table.sum(axis=1), (table > 0).sum(axis=1)
                known = total > 0
                whole = np.where(known, total + kinds, 1)[:, None]
                escape = np.where(known, kinds, 1)[:, None] / whole
                own[:, :, k] = np.where(table > 0, table / whole, escape * base[:, :, k])
            self.rows.append((contexts, own))
            index = np.full(size**order, -1, np.int64) if order < self.order else None
            if index is not None:
                index[contexts] = np.arange(len(contexts))
                parent, lower = index, own
        self._stack()

    def _stack(self) -> None:
        """One table of code lengths, and a map from the bytes before to its row."""
        firsts = np.cumsum([0, *(len(c) for c, _ in self.rows)])
        self.bits = np.concatenate([-np.log2(t) for _, t in self.rows]).astype(np.float32)
        size, order = self.size, self.order
        where = np.zeros(1, np.int32)
        for k in range(1, order + 1):
            # A context that no tree has stands where the next shorter one stands.
            where = np.tile(where, size)
            contexts = self.rows[k][0]
            where[contexts] = firsts[k] + np.arange(len(contexts), dtype=np.int32)
        self.where = where
        self.bits = self.bits.reshape(-1, len(self.languages))
        del self.rows

    def lengths(self, text: bytes) -> np.ndarray:
        """The code length of ``text`` in each language, in bits."""
        symbols = self._symbols(text)
        total = np.zeros(len(self.languages))
        for start in range(0, len(text), BLOCK):
            own = symbols[start : start + BLOCK + self.order]
            rows = self.where[self._codes(own, self.order)].astype(np.int64)
            total += self.bits[rows * self.size + own[self.order :]].sum(axis=0, dtype=np.float64)
        return total

    def best(self, text: bytes) -> tuple[str, float, float]:
        """The language of the shortest code, ties to the first by name, its share of the odds, and its bits per byte."""
        bits = self.lengths(text)
        k = int(np.argmin(bits))
        share = float(1 / np.exp2(np.clip(bits[k] - bits, -1000, 0)).sum())
        return self.languages[k], share, float(bits[k]) / max(1, len(text))


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", seed: int = 29) -> DataFrame:
    """About ``rows`` rows of every label of ``labelled`` (key, text, label), drawn by a hash of the key."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    part = F.expr(f"shiftrightunsigned(xxhash64(`{key}`, {seed}), 11) * 1.1102230246251565e-16D")
    share = {r["label"]: rows / r["n"] for r in sizes.collect()}
    if not share:
        return labelled.limit(0)
    picked = F.lit(False)
    for label, p in sorted(share.items()):
        picked = picked | ((F.col("label") == F.lit(label)) & (part < F.lit(float(p))))
    return labelled.where(picked)


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER) -> Trees | None:
    """Trees from ``labelled`` (doc_id, text, label); None where nothing is labelled.

    ``rows`` bounds the sample: its expected number of rows per label. Of a text it takes
    SAMPLE_CHARS characters at most.
    """
    own = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    samples: dict[str, list[bytes]] = {}
    text = F.substring("text", 1, SAMPLE_CHARS)
    for row in sample(own, rows).select("label", text.alias("text")).toLocalIterator():
        samples.setdefault(row["label"], []).append(row["text"].encode())
    samples = {k: v for k, v in samples.items() if any(v)}
    return Trees(samples, order) if samples else None



def predict(df: DataFrame, trees: Trees | None, text: str = "text", bits: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the winner's share of the odds.

    With ``bits`` also ``bits``, the winner's code length per byte; null without a letter.
    Without trees every text is unknown. Columns of these names are replaced.
    """
    names = ("lang_pred", "score", "bits") if bits else ("lang_pred", "score")
    types = (T.StringType(), T.DoubleType(), T.DoubleType())
    added = [T.StructField(n, t) for n, t in zip(names, types, strict=False)]
    kept = [f for f in df.schema if f.name not in names]
    own = df.select(*[F.col(f"`{f.name}`") for f in kept])
    if trees is None:
        values = (F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double"))
        return own.select("*", *[v.alias(n) for n, v in zip(names, values, strict=False)])
    shared = df.sparkSession.sparkContext.broadcast(trees)
    lettered = "_lettered"
    while lettered in df.columns:
        lettered += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            found = [
                model.best(t.encode()) if known else (UNKNOWN, 0.0, None)
                for t, known in zip(batch.column(text).to_pylist(), batch.column(lettered).to_pylist(), strict=True)
            ]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != lettered}
            yield pa.RecordBatch.from_pydict(
                columns
                | {n: pa.array([x[k] for x in found], pa.float64() if k else pa.string()) for k, n in enumerate(names)}
            )

    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return own.withColumn(lettered, has_letter).mapInArrow(run, T.StructType([*kept, *added]))


def labelled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may be learnt from."""
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").alias("label"))


def in_a_language(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter whose text some language codes in fewer than NO_LANGUAGE bits a byte.

    Without trees nothing speaks against a text with a letter. Columns stay as they are.
    """
    found = predict(packed(docs, text), trees, text, bits=True)
    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    kept = found.where(has_letter & F.coalesce(F.col("bits") < NO_LANGUAGE, F.lit(True)))
    return unpacked(kept, docs.columns, text)


@query("op6_ppm_language")
def _languages(spark, folder):
    """The language of every document, learnt from three quarters of them."""
    docs = table(spark, folder, "documents")
    found = predict(docs.select("doc_id", "text"), learn(labelled(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
