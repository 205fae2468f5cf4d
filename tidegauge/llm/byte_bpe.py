"""Byte-level BPE vocabularies of the tokenizers library, encoded at the speed of their ranks.

Where a vocabulary cuts texts by the usual byte-level pattern and its merges come in the order
of their ids, the pair of lowest merge is the pair whose token has the lowest id, so tiktoken
merges alike from the ids alone, several times as fast. Other vocabularies are encoded by the
tokenizers library itself. ``tests/llm`` compares both on every code point.
"""

from __future__ import annotations

import json
import os

import numpy as np

# Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters encoded in one call of the tokenizers library, which keeps much for each token.
CALL_CHARS = 1 << 19


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class ByteBpe:
    """Encodes texts without special tokens, whose strings count as ordinary text."""

    def __init__(self, description: str):
        rules = json.loads(description)
        model, cut = rules["model"], rules["pre_tokenizer"] or {}
        self.vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*self.vocab.values(), *(t["id"] for t in rules["added_tokens"] or [])])
        self._bytes = {name: bytes([b]) for b, name in byte_names().items()}
        plain = (
            rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex")
            and not cut.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
            and not model.get("unk_token") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
        )
        ranks = self._ranks(model["merges"]) if plain else None
        self._merger = self._tokenizer = self._all = None
        if ranks is not None:
            import tiktoken

            self._merger = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(description)
            self._tokenizer.encode_special_tokens = True

    def _ranks(self, merges: list) -> dict[bytes, int] | None:
        """Ids by bytes, if bytes come first and the merges' ids rise in their order."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [self.vocab.get("".join(p)) for p in pairs]
        singles = [self.vocab.get(name) for name in self._bytes]
        if None in ids or None in singles or max(singles) >= min(ids, default=1 << 62) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        own = [*self._bytes, *("".join(p) for p in pairs)]
        return {self.token_bytes(name): self.vocab[name] for name in own}

    def token_bytes(self, name: str) -> bytes:
        """What an entry of the vocabulary stands for; other names stand for themselves."""
        return b"".join(map(self._bytes.__getitem__, name)) if all(c in self._bytes for c in name) else name.encode()

    def tokens(self) -> list[bytes]:
        """The bytes of every id."""
        out = [b""] * self.size
        for name, i in self.vocab.items():
            out[i] = self.token_bytes(name)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if self._merger:
            return self._merger.decode_bytes(ids.tolist())
        if self._all is None:
            self._all = self.tokens()
        return b"".join(map(self._all.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        if self._merger:
            return [self._merger.encode_to_numpy(text, disallowed_special=()) for text in texts]
        out, start = [], 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CALL_CHARS):
                chars += len(texts[stop])
                stop += 1
            found = self._tokenizer.encode_batch_fast(texts[start:stop], add_special_tokens=False)
            out += [np.array(x.ids, np.uint32) for x in found]
            start = stop
        return out
