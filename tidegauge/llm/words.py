"""Ids of whole texts from the ids of their words.

A byte-level pattern cuts a text at single blanks and line feeds between other characters:
the blank begins the match after it, the line feed is one by itself. So where nothing else
parts the words, a text's ids are those of its words one after the other, and since words
repeat, a worker remembers some of them, bounded in bytes. Other texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

from tidegauge.llm.memory import LIMIT, Remembered

# Characters of texts that are encoded together; a longer text is alone.
PART_CHARS = 1 << 20


class WordIds:
    """Encodes texts through ``encode``, which gives the packed ids of each of some strings."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = LIMIT):
        self.encode = encode
        self.known = Remembered(limit)

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The first word, then each with the blank before it left out; None if cut otherwise."""
        words = text.replace("\n", " \n").split(" ")
        if "" in words or "\n" in words:
            return None
        # Blanks and line feeds must be all the white space there is, by the widest definition.
        dense = len("".join(text.split()))
        return words if dense + text.count(" ") + text.count("\n") == len(text) else None

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return self.encode([w if w[0] == "\n" else " " + w for w in words])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text; none for null."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= PART_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            out += self._encode_part(texts[start:stop])
            start = stop
        return out

    def _encode_part(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, whole = [], []
        for i, text in enumerate(texts):
            if text:
                words = self.words(text)
                whole.append(i) if words is None else plain.append((i, words))
        self.known.update(set().union(*(words[1:] for _, words in plain)), self._encode_words)
        known = self.known.young.__getitem__
        heads = self.encode([words[0] for _, words in plain])
        for (i, words), head in zip(plain, heads, strict=True):
            out[i] = head + b"".join(map(known, words[1:]))
        for i, ids in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out
