"""Parameters of the analytics, with the defaults that the queries use."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """universe: numbers run from 1 to it; draw_size: numbers in a draw; bins: decade groups; window: draws looked at."""

    universe: int = 80
    draw_size: int = 20
    bins: int = 8
    window: int = 50
    feature_window: int = 120
    recent: int = 40
    decay: float = 0.97
    windows: tuple[int, ...] = (3, 5, 7, 9)
    pick: int = 10
    dirichlet_prior: float = 0.6
    dirichlet_window: int = 120
    dirichlet_variance_weight: float = 0.35
    weights: dict[str, float] = field(default_factory=lambda: {"recency": 0.45, "momentum": 0.25, "cooc": 0.30, "dirichlet": 0.22, "pca": 0.18})
    min_draws: int = 180
    stake: int = 2


DEFAULT = EngineConfig()

#: Prize by numbers picked (key) and hits (from all hits down to none).
PRIZES = {
    10: ("5000000", "8000", "800", "80", "5", "3", "0", "0", "0", "0", "2"),
    9: ("300000", "2000", "200", "20", "5", "3", "0", "0", "0", "2"),
    8: ("50000", "800", "88", "10", "3", "0", "0", "0", "2"),
    7: ("10000", "288", "28", "4", "0", "0", "0", "2"),
    6: ("3000", "30", "10", "3", "0", "0", "0"),
    5: ("1000", "21", "3", "0", "0", "0"),
    4: ("100", "5", "3", "0", "0"),
    3: ("53", "3", "0", "0"),
    2: ("19", "0", "0"),
    1: ("4.6", "0"),
}
