"""Settings of adaptive retrieval, and the named presets that switch parts off."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Retrieval:
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    graph: bool = True
    graph_boost: float = 0.2
    k: int = 5
    max_k: int = 20
    adaptive: bool = True
    min_score: float = 0.0
    token_budget: int = 2000
    half_life_hours: float = 168.0
    over_fetch: int = 3
    summary: bool = True
    episodes: bool = True
    atomic: bool = True

    def __post_init__(self):
        if sum(self.weights) <= 0 or min(self.weights) < 0:
            raise ValueError("weights must not be negative, nor all zero")


PRESETS = {
    "full": Retrieval(),
    "no_atomic_encoder": replace(Retrieval(), atomic=False),
    "semantic_only": replace(Retrieval(), weights=(1.0, 0.0, 0.0), graph=False),
    "no_graph": replace(Retrieval(), weights=(0.625, 0.375, 0.0), graph=False),
    "no_summary": replace(Retrieval(), summary=False),
    "fixed_k": replace(Retrieval(), adaptive=False, k=10),
    "no_episodes": replace(Retrieval(), episodes=False),
    "minimal": replace(Retrieval(), weights=(1.0, 0.0, 0.0), graph=False, adaptive=False, summary=False, episodes=False, atomic=False),
}
