"""A model-free encoder for trials and tests: a hashed bag of words.

Each word adds +1 or -1 to one component, both chosen by its MD5 digest, so the
vectors can be recomputed anywhere. It stands in for a model that has to be
supplied by the user.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

DIM = 64


def _component(word: str, dim: int) -> tuple[int, float]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % dim, 1.0 if digest[8] < "8" else -1.0


class HashingModel:
    """Loader and model in one: ``HashingModel()`` is what an Encoder loads."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim

    def __call__(self, texts: list[str], role: str) -> np.ndarray:
        known: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word, n in Counter(text.split()).items():
                if word not in known:
                    known[word] = _component(word, self.dim)
                at, sign = known[word]
                row[at] += sign * n
        return out
