"""Default parameters of the rules."""

from __future__ import annotations

from dataclasses import dataclass, field

Tiers = tuple[tuple[float, ...], tuple[int, ...]]


@dataclass(frozen=True)
class Weights:
    drop: int = 25
    rsi: int = 20
    volume: int = 15
    support: int = 15
    discount: int = 10
    reversal: int = 10
    trend: int = 5

    def __post_init__(self):
        if sum((self.drop, self.rsi, self.volume, self.support, self.discount, self.reversal, self.trend)) != 100:
            raise ValueError("weights must sum to 100")


@dataclass(frozen=True)
class Scoring:
    """Tier levels and points; every tier is (levels, points)."""

    weights: Weights = Weights()
    min_score: int = 50
    drops: dict[str, Tiers] = field(
        default_factory=lambda: {
            "1h": ((1, 2, 3), (5, 8, 12)),
            "24h": ((3, 5, 8, 12), (8, 12, 18, 22)),
            "7d": ((5, 10, 15, 20), (5, 10, 18, 25)),
            "30d": ((15, 25, 35, 45), (8, 14, 18, 22)),
            "180d": ((30, 45, 60, 75), (6, 10, 14, 18)),
        }
    )
    rsi_1h: Tiers = ((30, 25, 20), (12, 15, 18))
    rsi_4h: Tiers = ((35, 30, 25), (5, 8, 10))
    rel_volume: Tiers = ((1.5, 2, 3, 4), (5, 9, 12, 15))
    support: Tiers = ((0.5, 1.5, 3, 5), (15, 12, 8, 4))
    support_lookback: int = 90
    discount_30d: Tiers = ((10, 20), (2, 5))
    discount_180d: Tiers = ((20, 40), (2, 5))
    divergence: bool = False
    normal: int = 50
    strong: int = 65
    very_strong: int = 80
    max_bars: int = 250


@dataclass(frozen=True)
class Alerts:
    cooldown_minutes: int = 120
    escalation_jump: int = 10
    quiet_start: int = 22
    quiet_end: int = 8
    timezone: str = "America/Sao_Paulo"


@dataclass(frozen=True)
class Verdicts:
    great: float = 10
    good: float = 5
    poor: float = -5
    bad: float = -10


@dataclass(frozen=True)
class Regime:
    ema_short: int = 20
    ema_long: int = 50
    atr_period: int = 14
    lookback: int = 90
    high_percentile: float = 70
    risk_on_adjust: int = -5
    risk_off_adjust: int = 5
    enabled: bool = False


@dataclass(frozen=True)
class Watch:
    floor: int = 35
    hours: int = 48
    enabled: bool = True


@dataclass(frozen=True)
class Sell:
    stop_loss: float = 8
    take_profit: float = 20
    trailing: float = 10
    context: bool = True
    cooldown_hours: float = 6
    enabled: bool = True


#: Bars kept of each interval.
RETENTION: dict[str, int] = {"1h": 2160, "4h": 1080, "1d": 400}
