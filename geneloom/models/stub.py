"""Deterministic token models for tests and for wiring checks.

A model offers ``dim``, ``tokens(piece) -> (matrix, special_mask)`` and may offer
``token_count(piece)``. Real checkpoints plug in through the same three names.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np


class LetterModel:
    """One-hot vector per letter of an alphabet, framed by two special tokens."""

    def __init__(self, alphabet: str = "ACGT"):
        self.alphabet = alphabet
        self.dim = len(alphabet)

    def tokens(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(piece.encode("ascii", "replace"), dtype=np.uint8)
        hot = (codes[:, None] == np.frombuffer(self.alphabet.encode(), dtype=np.uint8)[None, :]).astype(np.float64)
        frame = np.full((1, self.dim), 9.0)
        special = np.zeros(len(codes) + 2, dtype=bool)
        special[[0, -1]] = True
        return np.vstack([frame, hot, frame]), special

    def token_count(self, piece: str) -> int:
        return len(piece) + 2


@lru_cache(1 << 16)
def _seed(word: str) -> int:
    return zlib.crc32(word.encode())


class WordHashModel:
    """Words of a text as tokens; each word has a fixed pseudo-random vector."""

    def __init__(self, dim: int = 16):
        self.dim = dim
        self._last: tuple[str, list[str]] = ("", [])

    def _words(self, piece: str) -> list[str]:
        """The words are counted first and embedded next, so those of the last piece are kept."""
        if piece != self._last[0]:
            self._last = (piece, re.findall(r"[a-z0-9]+", piece.lower()))
        return self._last[1]

    def tokens(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        words = self._words(piece)
        seeds = np.array([_seed(w) for w in words], dtype=np.uint64).reshape(-1, 1)
        grid = (seeds + 1) * (np.arange(1, self.dim + 1, dtype=np.uint64) * np.uint64(2654435761))
        return (grid % np.uint64(2001)).astype(np.float64) / 1000.0 - 1.0, np.zeros(len(words), dtype=bool)

    def token_count(self, piece: str) -> int:
        return len(self._words(piece))
