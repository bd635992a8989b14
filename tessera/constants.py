"""Fixed values of the scoring rules."""

from __future__ import annotations

from dataclasses import dataclass

DIMS = 14
K = 5
THRESHOLD = 0.6
SCALE = 10_000


@dataclass(frozen=True)
class Normalization:
    """Fixed values by which features are divided; another set may be given to `vectorize`."""

    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0


# The risk of a merchant category code, and that of all others.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_MCC_RISK = 0.5

FEATURES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)
V = [f"v{i}" for i in range(DIMS)]
Q = [f"q{i}" for i in range(DIMS)]
