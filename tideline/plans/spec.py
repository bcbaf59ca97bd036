"""The frozen choices of an experiment and their fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

#: The classes and the splits, in this order.
LABELS = (-1, 0, 1)
SPLITS = ("train", "validation", "test")
#: The features, in the order of the model's coefficients. The last three carry no length of the lookback in
#: their names, as it is a parameter here.
FEATURES = (
    "relative_spread", "queue_imbalance", "log_bid_size", "log_ask_size", "delta_bid_size", "delta_ask_size", "mid_return_5", "realized_vol_20",
    "trade_intensity", "signed_count_imbalance", "signed_volume_imbalance",
)
#: The columns of the book's state.
BOOK_STATE = ("bid_price", "ask_price", "bid_size", "ask_size")


@dataclass(frozen=True)
class Spec:
    """Parameters that decide what an experiment computes."""

    horizons: tuple[int, ...] = (10, 20, 50)
    features: tuple[str, ...] = FEATURES
    train_share: float = 0.60
    validation_share: float = 0.20
    embargo: int = 50
    lookback_us: int = 1_000_000
    max_gap_s: float = 60.0
    max_edge_s: float = 60.0
    symbols: tuple[str, ...] | None = None  # None: any

    def __post_init__(self) -> None:
        h = self.horizons
        if not h or any(x <= 0 for x in h) or tuple(sorted(set(h))) != tuple(h):
            raise ValueError(f"horizons must be positive, unique and sorted: {h}")
        if not self.features or len(set(self.features)) != len(self.features):
            raise ValueError("features must be given and unique")
        if not (0 < self.train_share < 1 and 0 < self.validation_share < 1 and self.train_share + self.validation_share < 1):
            raise ValueError("split shares must be positive and leave a part for the test")
        if self.embargo < max(h):
            raise ValueError("the embargo must cover the longest horizon")
        if self.lookback_us <= 0:
            raise ValueError("the lookback must be positive")

    def check_symbol(self, symbol: str) -> str:
        if self.symbols is not None and symbol not in self.symbols:
            raise ValueError(f"symbol {symbol!r} is not one of {self.symbols}")
        return symbol

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
