"""Defaults of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 6
    min_score: float = 0.70
    candidates: int = 20
    token_budget: int = 700
    exempt: int = 2
    tolerance: float = 0.08
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    guaranteed: int = 2


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 450
    overlap_tokens: int = 60
    min_tokens: int = 40
    chars_per_token: float = 3.5


RETRIEVAL, CHUNKING = Retrieval(), Chunking()
#: Rows of a small side that may be broadcast after its size has been checked.
BROADCAST_ROWS = 500_000
