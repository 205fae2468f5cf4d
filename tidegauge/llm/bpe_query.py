"""The query of byte-level BPE, and where the public vocabularies are."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidegauge.llm import bpe
from tidegauge.llm.base import query, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@query("op1_bpe_segment_tree")
def _bpe(spark, folder):
    """Ids of every document, and the bytes they decode to, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, bpe.read_ranks(RANKS), PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
