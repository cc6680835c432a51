"""Byte-level BPE with byte and character offsets, for tasks on executors."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Where the vocabulary lies on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of byte-level BPE: contractions, words, numbers, signs, spaces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer runs of white space, as the pattern's `\\s` has it, are cut out first: the pattern looks ahead behind them and gives up at about a million.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.end = len(ranks)
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self._lengths[rank] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        parts, at = [], 0
        for run in BLANKS.finditer(text):
            # Before a sign the last blank goes with what follows, as in the pattern; a run at the end is whole.
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += self._encoding.encode_ordinary(text[at : run.start()])
            parts += self._encoding._encode_single_piece(text[run.start() : end])
            at = end
        parts += self._encoding.encode_ordinary(text[at:])
        return np.array(parts, dtype=np.int32)

    def decode(self, ids) -> str:
        return self._encoding.decode(list(ids))

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the UTF-8 text."""
        return np.cumsum(self._lengths[ids])


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)
