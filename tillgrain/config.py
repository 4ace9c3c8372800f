"""Parameters of the analyses. Defaults are the values of the original retail study."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Step:
    """One rung of a ladder: ``label`` applies once the value passes ``bound``."""

    label: str
    bound: float


@dataclass(frozen=True)
class Ladder:
    """Ordered rungs plus the label for everything that passes none of them."""

    steps: tuple[Step, ...]
    otherwise: str


# --- fixed values: labels and thresholds that must read exactly as published ---

CLV_TIERS = Ladder(
    (
        Step("💎 Platinum (£5,000+)", 5000),
        Step("🥇 Gold (£2,000–£4,999)", 2000),
        Step("🥈 Silver (£1,000–£1,999)", 1000),
        Step("🥉 Bronze (£500–£999)", 500),
    ),
    "⚪ Standard (< £500)",
)

REACTIVATION_TIERS = Ladder(
    (
        Step("High Value — Priority Reactivation", 1000),
        Step("Medium Value — Standard Campaign", 500),
    ),
    "Low Value — Bulk Email Only",
)

PRODUCT_TIERS = Ladder(
    (
        Step("Hero Product", 50000),
        Step("Strong Performer", 20000),
        Step("Solid Contributor", 10000),
    ),
    "Standard",
)

EXPORT_TIERS = Ladder(
    (Step("Major Export Market", 50000), Step("Established Export", 10000)),
    "Emerging Market",
)

ACTIVITY_STATUS = Ladder(
    (Step("Active", 30), Step("Cooling", 90), Step("At Risk", 180)), "Lapsed"
)

FOLLOW_UP_URGENCY = Ladder(
    (
        Step("Urgent — follow up this week", 14),
        Step("Soon — follow up this month", 30),
    ),
    "Standard — include in next campaign",
)

COHORT_QUALITY = Ladder((Step("Strong", 30), Step("Average", 15)), "Weak")

RULE_STRENGTH = Ladder(
    (Step("Very Strong", 5), Step("Strong", 3), Step("Moderate", 2)), "Weak"
)

PRICE_EDGES = (0, 1, 5, 10, 50, 1000)
PRICE_LABELS = ("Very Low", "Low", "Medium", "High", "Premium")

MINIMUM_ROWS = {
    "fact_transactions": 390_000,
    "dim_customers": 4_000,
    "dim_products": 3_000,
    "dim_date": 300,
    "dim_geography": 30,
}

# --- end of fixed values ---


@dataclass(frozen=True)
class CleaningConfig:
    cancel_prefix: str = "C"
    quantity_quantile: float = 0.99
    sketch_size: int | None = None
    """Cut outliers by a quantile sketch of this size instead of the exact search."""


@dataclass(frozen=True)
class RfmConfig:
    snapshot_offset_days: int = 1
    bins: int = 5


@dataclass(frozen=True)
class BasketConfig:
    home_market: str | None = "United Kingdom"
    top_products: int = 200
    min_support: float = 0.01
    max_length: int = 3
    min_confidence: float = 0.3
    min_lift: float = 1.0
    top_pairs: int = 20
    sample_rules: int = 500
    sample_seed: int = 42
    chart_pairs: int = 15
    network_pairs: int = 12


@dataclass(frozen=True)
class ReportConfig:
    home_market: str = "United Kingdom"
    home_label: str = "United Kingdom"
    abroad_label: str = "International"
    top_n: int = 20
    clv_tiers: Ladder = CLV_TIERS
    reactivation_tiers: Ladder = REACTIVATION_TIERS
    product_tiers: Ladder = PRODUCT_TIERS
    export_tiers: Ladder = EXPORT_TIERS
    activity_status: Ladder = ACTIVITY_STATUS
    follow_up_urgency: Ladder = FOLLOW_UP_URGENCY
