"""Settings of the pain-point analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    sentiment_severity: dict[str, float] = field(default_factory=lambda: {"very_neg": 3.0, "neg": 2.0, "neutral": 1.0, "pos": 1.0})
    signal_weight: dict[str, float] = field(default_factory=lambda: {"churn_intent": 1.0, "financial_harm": 1.0, "safety_legal": 2.0})
    severity_min: float = 1.0
    severity_max: float = 5.0
    baseline_weeks: int = 8
    min_periods: int = 3
    std_floor: float = 0.5
    spike: float = 2.0
    falling: float = -1.0
    weight_volume: float = 0.35
    weight_severity: float = 0.25
    weight_spike: float = 0.25
    weight_value: float = 0.15
    min_support: int = 30
    alpha: float = 0.05
    top_k: int = 10
    bridge_leaves: int = 3
    curated_cap: int = 30
    tiers: tuple[tuple[str, float], ...] = (("very_high", 0.85), ("high", 0.60), ("fair", 0.35))
    top_n: int = 10
    #: Dimension values that the report lists, those of most support.
    hotspots_shown: int = 100
    exemplar_k: int = 3
    compress_sentences: int = 2
    snippet_chars: int = 500
    #: 'table_a' looks for the order value in Table A only; 'joined' takes it from Table B.
    value_source: str = "table_a"


DEFAULT = Config()
SIGNALS = ("churn_intent", "financial_harm", "safety_legal", "repeat_contact", "unresolved")
SENTIMENTS = ("very_neg", "neg", "neutral", "pos")
