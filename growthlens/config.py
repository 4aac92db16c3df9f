"""Operator configuration with the application's code defaults.

The analysed application reads YAML files that are not part of its tree, so
the defaults written in its code are the specification.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ScoringConfig:
    rating_min: float = 1.0
    rating_max: float = 5.0
    recency_half_life_days: float = 180.0
    w_rating: float = 0.4
    w_pop: float = 0.4
    w_recency: float = 0.2
    # Optional candidate cap.  ``None`` ranks the whole catalog; a number
    # reproduces the application's bounded candidate list (ordered by id).
    max_candidates: int | None = None
    # popularity saturates at log1p(pop_saturation)
    pop_saturation: int = 10000


@dataclass(frozen=True)
class GuardrailConfig:
    min_avg_rating: float = 0.0
    min_rating_count: int = 0
    min_review_count: int = 0
    price_min: float = 0.0
    price_max: float = math.inf
    banned_brands: tuple[str, ...] = ()
    banned_asins: tuple[str, ...] = ()
    banned_categories: tuple[str, ...] = ()
    max_days_since_last_review: float = 3650.0

    def override_price_range(self, price_min: float | None = None,
                             price_max: float | None = None) -> "GuardrailConfig":
        """Request-level price bounds replace the configured ones, each on its own."""
        out = self
        if price_min is not None:
            out = replace(out, price_min=float(price_min))
        if price_max is not None:
            out = replace(out, price_max=float(price_max))
        return out


@dataclass(frozen=True)
class PriceRangeRate:
    min_price: float
    max_price: float
    rate: float


@dataclass(frozen=True)
class CommissionConfig:
    default_rate: float = 0.10
    category_rates: dict = field(default_factory=dict)
    price_range_rates: tuple[PriceRangeRate, ...] = ()


# Thresholds of the rule-based diagnosis and the alerts (fixed values of the
# analysed application).
@dataclass(frozen=True)
class AlertConfig:
    cvr_min_clicks: int = 100
    cvr_max_pct: float = 1.0
    refund_min_orders: int = 10
    refund_max_pct: float = 15.0
    lookback_days: int = 7
