"""Reranking for diversity: each next result is relevant and unlike those chosen before."""

from __future__ import annotations

import numpy as np

from ..functions.metrics import similarity_matrix


def rerank(vectors: np.ndarray, relevance: np.ndarray, distance: str, diversity: float = 0.5, limit: int = 10) -> list[int]:
    """Places of the chosen candidates in order. On equal values the later candidate is chosen."""
    if not 0 <= diversity <= 1:
        raise ValueError("diversity is between 0 and 1")
    if len(vectors) < 2:
        return list(range(len(vectors)))
    weight = 1.0 - diversity
    last = lambda scores: len(scores) - 1 - int(np.argmax(scores[::-1]))
    left, nearest, chosen = np.arange(len(vectors)), np.full(len(vectors), -np.inf), []
    gain = relevance
    while len(left) and len(chosen) < limit:
        at = last(np.asarray(gain))
        chosen.append(int(left[at]))
        left = np.delete(left, at)
        # Only the greatest likeness to what is chosen is kept, not that of all pairs.
        nearest[left] = np.maximum(nearest[left], similarity_matrix(vectors[left], vectors[chosen[-1:]], distance)[:, 0])
        gain = weight * relevance[left] - (1 - weight) * nearest[left]
    return chosen
