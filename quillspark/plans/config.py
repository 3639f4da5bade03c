"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.lexicon import ZH_MANUAL, LexiconProfile
from ..operators.fusion import checked_mode


@dataclass(frozen=True)
class EngineConfig:
    lexicon: LexiconProfile = ZH_MANUAL
    chunk_size: int = 800
    overlap: int = 120
    skip_toc_pages: int = 12
    top_k: int = 5
    mode: str = "hybrid"
    dense_candidates: int = 10
    sparse_candidates: int = 10
    rrf_k: int = 60
    rerank: bool = False
    rerank_pool: int = 10
    select_contexts: bool = True
    selection_base: str = "score"
    expand_neighbours: bool = False
    neighbours_per_chunk: int = 1
    max_contexts: int = 5
    max_chars: int = 6000
    embedding_size: int = 64

    def __post_init__(self) -> None:
        checked_mode(self.mode)
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be between 1 and 20")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("the overlap must be at least 0 and less than the chunk size")
