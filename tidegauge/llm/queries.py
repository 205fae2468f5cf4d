"""All queries of this package, each registered by the module of its operator."""

from tidegauge.llm import (  # noqa: F401
    alignment,
    bpe_query,
    decontaminate,
    embeddings,
    huffman,
    langid,
    mixing,
    partenum,
    secret_scan,
    sharding,
    toxicity,
    warc,
    whitening,
)
from tidegauge.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
