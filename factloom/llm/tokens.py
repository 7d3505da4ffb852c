"""Counting tokens of a public byte-level BPE tokenizer, whose files lie outside the repository."""

from __future__ import annotations

import base64
import os

import regex

#: Where the vocabulary files lie; a parameter of everything that counts tokens.
TOKENIZER_DIR = os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this vocabulary
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 400_000


class TokenCounter:
    """Counts tokens by split pieces, each encoded once while it is cached (merges never cross pieces)."""

    def __init__(self, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(os.path.join(directory, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encode = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = regex.compile(SPLIT).findall
        self._sizes: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return self._split(text)

    def sizes(self, pieces: list[str]) -> list[int]:
        known = self._sizes
        if len(known) > CACHED:
            known.clear()
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = len(self._encode(p))
            return [known[p] for p in pieces]

    def count(self, text: str | None) -> int:
        return sum(self.sizes(self._split(text))) if text else 0
