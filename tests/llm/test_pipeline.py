"""Every stage of the pipeline against a brute-force version of the rows it keeps."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from .test_documents import bag, base_spans, brute_components
from .test_tokens import expected
from tidegauge.llm import langid
from tidegauge.llm.base import materialize

EXTRAS = {
    "score": "cast(doc_id as double)", "lang_pred": "'mine'", "_lettered": "true", "_row": "7L", "row": "doc_id", "spans": "'s'",
    "base_spans": "1", "text_hash": "'h'", "text_hash_": "'h'", "kept": "array(1, 2)", "_": "named_struct('a', 1)", "group": "1", "bits": "0D",
}


def leaked(text, items):
    words = (text or "").lower().split()
    for own in items:
        target = bag(own.lower().split())
        size = len(own.split())
        for start in range(1 - size, len(words)):
            window = bag(words[max(start, 0) : start + size])
            if sum((window & target).values()) >= 0.75 * sum((window | target).values()):
                return True
    return False


def kept_by(name, rows, docs, items):
    """The rows that a stage should keep, of ``rows``."""
    if name == "language":
        trees = langid.learn(langid.labelled(docs))
        sound = lambda t: any(c.isalpha() for c in t) and (trees is None or trees.lengths(t.encode()).min() / len(t.encode()) < langid.NO_LANGUAGE)
        return [r for r in rows if sound(r["text"] or "")]
    if name == "near_copies":
        groups = brute_components([(n, r["text"]) for n, r in enumerate(rows)])
        least = {}
        for n, r in enumerate(rows):
            if r["doc_id"] is not None:
                group = groups.get(n, n)
                least[group] = min(least.get(group, (r["doc_id"], n)), (r["doc_id"], n))
        firsts = {n for _, n in least.values()}
        return [r for n, r in enumerate(rows) if n in firsts or r["doc_id"] is None]
    if name == "benchmark_leaks":
        words = {w for item in items for w in item.lower().split()}
        near = lambda t: len(words & set((t or "").lower().split())) >= 2
        return [r for r in rows if not (near(r["text"]) and leaked(r["text"], items))]
    return rows


def key(row):
    return str(tuple(row))


@pytest.mark.parametrize("labels", ["lang", "none"])
def test_stages(spark, small, labels):
    """Stage by stage on whole rows, with columns of clashing names, and with no label to learn from."""
    plain = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 70 AND (text IS NULL OR length(text) < 2500)")
    secret = "a line of words before password = 'abcdefgh1234' and a few more words after it"
    planted = spark.createDataFrame([(900, secret, "en", "src0", len(secret))], "doc_id long, text string, lang string, source string, n_chars long")
    planted = planted.select(*[F.col(f.name).cast(f.dataType) for f in plain.schema])
    docs = plain.unionByName(planted).withColumns({n: F.expr(e) for n, e in EXTRAS.items()})
    if labels == "none":
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = materialize(docs.coalesce(1), "docs")
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = docs.collect()
        out = materialize(stage(spark, docs, small).coalesce(1), name)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        got, want = out.collect(), kept_by(name, rows, docs, items)
        if name == "secrets":
            # Texts change; what else a row has does not, and no secret is left.
            assert sorted(key(r[:1] + r[2:4]) for r in got) == sorted(key(r[:1] + r[2:4]) for r in want)
            before = {r["doc_id"]: r["text"] for r in rows}
            for r in got:
                assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                assert r["text"] == before[r["doc_id"]] or "[secret]" in r["text"]
                assert r["text"] == before[r["doc_id"]] or not base_spans(before[r["doc_id"]]) or len(r["text"]) < len(before[r["doc_id"]])
            assert any("[secret]" in r["text"] for r in got)
        else:
            assert sorted(map(key, got)) == sorted(map(key, want)), name
        docs = out
    done = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, docs, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert done.keys() == texts.keys()
    assert all(bytes(done[d]["ids"]) == expected(t) and done[d]["n_tokens"] * 4 == len(done[d]["ids"]) for d, t in texts.items())


def test_stages_together(spark, small, odd, tmp_path):
    """Odd rows through all stages: nothing crashes, and an empty table stays empty."""
    for n, rows in enumerate((odd, odd.limit(0))):
        folder = f"{tmp_path}/{n}"
        rows.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        ids = Counter(r["doc_id"] for r in out)
        assert (set(ids) == {1, 7, 9, 11, None}) if n == 0 else not out
        assert all(np.frombuffer(r["ids"], "<u4").size == r["n_tokens"] for r in out)
